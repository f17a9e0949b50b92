"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

SQL = {
    "op2_top_k": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_mixture": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS h
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM s),
        f AS (
            SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS pos FROM w),
        c AS (
            SELECT *, (SELECT sum(source_size) FROM s)::BIGINT
                   - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rem,
                   sum(weight) OVER (ORDER BY pos DESC)::BIGINT AS rest
            FROM f),
        level AS (SELECT min_by(rem, pos) AS rem, min_by(rest, pos) AS rest FROM c WHERE cap * rest > weight * rem),
        t AS (
            SELECT source, source_size, least(cap::DOUBLE, coalesce((weight * level.rem)::DOUBLE / level.rest::DOUBLE, cap::DOUBLE)) AS target
            FROM w, (SELECT 3 * source_size AS cap, source AS s2 FROM w) x, level WHERE s2 IS NOT DISTINCT FROM source),
        b AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        g AS (
            SELECT source, h, sum(size)::BIGINT AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto_here
            FROM d GROUP BY source, h),
        k AS (
            SELECT b.source, min_by(struct_pack(h := g.h, n := g.n, u := g.upto_here), g.h) AS x, any_value(b.target - b.whole * b.source_size) AS budget
            FROM b JOIN g ON g.source IS NOT DISTINCT FROM b.source
            WHERE g.upto_here > b.target - b.whole * b.source_size GROUP BY b.source),
        u AS (
            SELECT source, CASE WHEN x.u - budget < budget - (x.u - x.n) THEN x.h ELSE x.h - 1 END AS upto FROM k),
        m AS (
            SELECT b.*, CASE WHEN u.upto IS NULL THEN 1152921504606846975 ELSE u.upto END AS upto
            FROM b LEFT JOIN u ON u.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, d.source, size, source_size, target, least(whole + (h <= upto)::BIGINT, 3)::BIGINT AS copies,
               (size * least(whole + (h <= upto)::BIGINT, 3))::BIGINT AS taken
        FROM d JOIN m ON m.source IS NOT DISTINCT FROM d.source""",
    "op4_embedding_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_line_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS raw FROM documents),
        l AS (
            SELECT r, source, unnest(raw) AS line, unnest(range(len(raw))) AS pos FROM d WHERE text <> ''),
        t AS (
            SELECT r, pos, source, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key FROM l),
        s AS (
            SELECT key FROM t WHERE key <> '' GROUP BY key
            HAVING count(DISTINCT source) + max((source IS NULL)::INTEGER) >= 10),
        m AS (SELECT t.*, s.key IS NOT NULL AS shared FROM t LEFT JOIN s USING (key)),
        g AS (
            SELECT r, (count(*) FILTER (key <> ''))::INTEGER AS n_lines, (count(*) FILTER (shared))::INTEGER AS n_shared,
                   count(*) FILTER (shared) = count(*) FILTER (key <> '') AS copy,
                   string_agg(line, chr(10) ORDER BY pos) FILTER (NOT shared) AS rest
            FROM m GROUP BY r),
        o AS (
            SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_shared, 0) AS n_shared,
                   CASE WHEN copy THEN 0 ELSE coalesce(n_shared, 0) END AS n_removed,
                   CASE WHEN text = '' OR copy OR coalesce(n_shared, 0) = 0 THEN text ELSE coalesce(rest, '') END AS text
            FROM d LEFT JOIN g USING (r))
        SELECT doc_id, n_lines, n_shared, n_removed, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM o""",
    "op11_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
                   min(page_id) OVER (PARTITION BY html) AS first_id
            FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(hex, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM d""",
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
        grams AS (
            SELECT lang, w[i:i + k - 1] AS p, k FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
        total AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, p, k, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
        cuts AS (
            SELECT f.lang, f.p, f.c AS a, t.n, x.k, l.c AS l, r.c AS r,
                   ((1000::HUGEINT * f.c * t.n) // (l.c::HUGEINT * r.c))::BIGINT AS score
            FROM f JOIN total t USING (lang), (SELECT unnest(range(1, 5)) AS k) x, f l, f r
            WHERE f.k >= 2 AND x.k < f.k AND l.lang = f.lang AND l.p = f.p[1:x.k] AND r.lang = f.lang AND r.p = f.p[x.k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        held AS (
            SELECT lang, p, max(c) AS longest FROM (
                SELECT lang, p[1:k - 1] AS p, c FROM f WHERE k >= 3 UNION ALL SELECT lang, p[2:] AS p, c FROM f WHERE k >= 3)
            GROUP BY ALL),
        kept AS (
            SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score
            FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p WHERE h.longest IS NULL OR 100 * h.longest < 100 * a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000""",
    "op13_merkle": r"""
        WITH RECURSIVE enc AS (
            SELECT row_number() OVER () AS row, doc_id, lang,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
            FROM documents),
        docs AS (
            SELECT row, doc_id, lang,
                   sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed
            FROM enc),
        crc AS (
            SELECT row, doc_id::VARCHAR AS t, 0 AS i, 4294967295::UBIGINT AS c FROM docs WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT row, t, i + 1, list_reduce(list_prepend(xor(c, ascii(t[i + 1])::UBIGINT), range(8)::UBIGINT[]),
                       lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)
            FROM crc WHERE i < length(t)),
        hit AS (SELECT row FROM crc WHERE i = length(t) AND xor(c, 4294967295::UBIGINT) % 7 = 0),
        placed AS (
            SELECT docs.*, CASE WHEN hit.row IS NULL THEN leaf ELSE changed END AS seen,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
            FROM docs LEFT JOIN hit USING (row)),
        tree AS (
            SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS width FROM placed
            UNION ALL
            SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(width) + 1) // 2
            FROM tree WHERE width > 1 GROUP BY lang, level, pos // 2),
        subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS pos FROM tree WHERE width = 1),
        top AS (
            SELECT 0 AS level, pos, h, count(*) OVER () AS width FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(width) + 1) // 2
            FROM top WHERE width > 1 GROUP BY level, pos // 2),
        steps AS (
            SELECT p.row, t.level AS level, t.pos < p.pos >> t.level AS is_left, t.h
            FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = xor(p.pos >> t.level, 1)
            UNION ALL
            SELECT p.row, 1000 + t.level, t.pos < s.pos >> t.level, t.h
            FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.pos = xor(s.pos >> t.level, 1)),
        levels AS (
            SELECT p.row, t.level FROM placed p JOIN (SELECT DISTINCT lang, level FROM tree WHERE width > 1) t ON t.lang IS NOT DISTINCT FROM p.lang
            UNION ALL
            SELECT p.row, 1000 + t.level FROM placed p, (SELECT DISTINCT level FROM top WHERE width > 1) t),
        path AS (
            SELECT l.row, row_number() OVER (PARTITION BY l.row ORDER BY l.level) AS step,
                   CASE WHEN is_left THEN h ELSE '' END AS l, CASE WHEN is_left THEN '' ELSE coalesce(h, '') END AS r
            FROM levels l LEFT JOIN steps s ON s.row = l.row AND s.level = l.level),
        proof AS (SELECT row, count(*) AS n, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM path GROUP BY row),
        fold AS (
            SELECT row, 0 AS step, seen AS h FROM placed
            UNION ALL
            SELECT f.row, f.step + 1, sha256(p.l || f.h || p.r) FROM fold f JOIN path p ON p.row = f.row AND p.step = f.step + 1),
        done AS (SELECT row, max_by(h, step) AS folded_root FROM fold GROUP BY row)
        SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top WHERE width = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
               folded_root, folded_root = (SELECT h FROM top WHERE width = 1) AS verified
        FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN proof USING (row) JOIN done ON done.row = p.row""",
}
