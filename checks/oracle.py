"""What the queries must return, as SQL over the same tables."""

from __future__ import annotations

from chatprep.constants import UNK_TEXT, WHITESPACE

BLOCK = 256
NL = "chr(10)"


def strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def clean_keep(x: str) -> str:
    return f"trim(trim({strip(x)}, '\"'), '''')"


def clean(x: str) -> str:
    return strip(clean_keep(x))


def chars(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split({x}, '') END)"


def excerpt(x: str, width: int) -> str:
    return f"left({x}, {width}) || CASE WHEN length({x}) > {width} THEN '...' ELSE '' END"


CONTEXT = f"""
sys AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
nxt AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ctx AS (SELECT nxt.*, system FROM nxt LEFT JOIN sys USING (conv_id))"""

ADJACENT = f"""{CONTEXT},
adj AS (SELECT conv_id, turn,
          {strip(f"CASE WHEN coalesce(system, '') <> '' THEN system || {NL} || text ELSE text END")} AS input,
          {strip("next_text")} AS output
        FROM ctx WHERE role = 'user' AND next_role = 'assistant' AND {strip("next_text")} <> '')"""

HISTORY = f"""{CONTEXT},
ex AS (SELECT conv_id, turn, nullif({strip("system")}, '') AS system, {strip("text")} AS human, {strip("next_text")} AS assistant
       FROM ctx WHERE role = 'user' AND next_role = 'assistant' AND {strip("text")} <> '' AND {strip("next_text")} <> ''),
hist AS (SELECT conv_id, turn,
           concat_ws({NL}, system, string_agg(human || {NL} || assistant, {NL}) OVER
             (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), human) AS input,
           assistant AS output
         FROM ex)"""


def vocab_from(source: str) -> str:
    return f"""vocab AS MATERIALIZED (
  SELECT '<pad>' AS ch, 0 AS id UNION ALL SELECT '<bos>', 1 UNION ALL SELECT '<eos>', 2 UNION ALL SELECT '{UNK_TEXT}', 3
  UNION ALL SELECT ch, CAST(row_number() OVER (ORDER BY ch) + 3 AS INT)
  FROM ({source}) WHERE ch <> '{UNK_TEXT}')"""


VOCAB = f"""{HISTORY},
{vocab_from("SELECT DISTINCT unnest(string_split(input || ' ' || output, '')) AS ch FROM hist")}"""


def ids_of(name: str, source: str, keys: str, tokens: str) -> str:
    """CTE `name(keys, ids)` from the token list `tokens` over `source`."""
    return f"""{name}_tok AS (SELECT {keys}, unnest(t) AS ch, generate_subscripts(t, 1) AS p FROM (SELECT {keys}, {tokens} AS t FROM {source})),
{name} AS MATERIALIZED (SELECT {keys}, list(coalesce(id, 3) ORDER BY p) AS ids FROM {name}_tok LEFT JOIN vocab USING (ch) GROUP BY ALL)"""


def both_sides(block: int) -> str:
    return (
        f"list_slice(list_concat(list_concat(list_concat(['<bos>'], {chars('input')}), ['<eos>', '<bos>']),"
        f" list_concat({chars('output')}, ['<eos>'])), 1, {block})"
    )


SAMPLES = f"""{VOCAB},
{ids_of("samples", "hist", "conv_id, turn", both_sides(BLOCK))}"""

SHIFTED = f"""{SAMPLES},
xy AS (SELECT conv_id, turn, ids[:-2] AS x, ids[2:] AS y FROM samples)"""


def csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


def batched(source: str, key: str, keys: str, epoch: int, rows: int, name: str = "placed") -> str:
    return f"""{name} AS (SELECT *, (r - 1) // {rows} AS batch_id, CAST((r - 1) % {rows} AS INT) AS row_in_batch
  FROM (SELECT *, row_number() OVER (ORDER BY md5('42:{epoch}:' || {key}), {keys}) AS r, count(*) OVER () AS n FROM {source}))"""


BATCHES = f"""{SHIFTED},
{batched("xy", "conv_id || ':' || turn", "conv_id, turn", 1, 16, "every")},
placed AS (SELECT * FROM every WHERE batch_id < n // 16),
padded AS MATERIALIZED (SELECT conv_id, turn, batch_id, row_in_batch, list_resize(x, w, 0) AS x, list_resize(y, w, 0) AS y
  FROM (SELECT *, max(len(x)) OVER (PARTITION BY batch_id) AS w FROM placed))"""

LINES = f"""dl AS (SELECT doc_id, source, lang, unnest(string_split(text, {NL})) AS line,
  CAST(generate_subscripts(string_split(text, {NL}), 1) - 1 AS INT) AS i FROM documents)"""


def neighbours(name: str, where: str) -> str:
    """Adjacent pairs of `{name}_m(rec_id, pos, system, who, text)`."""
    human, model = where.split("|")
    return f"""{name} AS (SELECT rec_id, pos, {strip(f"system || {NL} || text")} AS input, {strip("next_text")} AS output
  FROM (SELECT *, lead(who) OVER w AS next_who, lead(text) OVER w AS next_text FROM {name}_m WINDOW w AS (PARTITION BY rec_id ORDER BY pos))
  WHERE who IN ({human}) AND next_who IN ({model}) AND {strip("next_text")} <> '')"""


MESSAGES = f"""{LINES},
msg_m AS (SELECT doc_id AS rec_id, i AS pos, source AS system, line AS text,
  CASE WHEN length(line) % 5 = 0 THEN 'system' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS who FROM dl),
{neighbours("msg", "'user'|'assistant'")}"""

SHAREGPT = f"""{LINES},
sg_m AS (SELECT doc_id AS rec_id, i AS pos, lang AS system, line AS text,
  CASE WHEN i % 2 = 0 THEN CASE WHEN length(line) % 2 = 0 THEN 'human' ELSE 'user' END
       ELSE ['gpt', 'model', 'chatbot', 'bot'][length(line) % 4 + 1] END AS who FROM dl),
{neighbours("sg", "'human', 'user'|'gpt', 'assistant', 'model', 'chatbot'")}"""

TURN_SIDES = f"""{LINES},
sides AS (SELECT doc_id AS rec_id, i // 2 AS pos, CASE WHEN doc_id % 2 = 0 THEN source END AS system,
  {strip("coalesce(max(CASE WHEN i % 2 = 0 AND length(line) % 7 <> 0 THEN line END), '')")} AS human,
  {strip("coalesce(max(CASE WHEN i % 2 = 1 AND length(line) % 7 <> 0 THEN line END), '')")} AS assistant
  FROM dl GROUP BY ALL)"""

TURN_PAIRS = f"""{TURN_SIDES},
tp AS (SELECT rec_id, pos, concat_ws({NL}, system, string_agg(human || {NL} || assistant, {NL}) OVER
    (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), human) AS input, assistant AS output
  FROM sides WHERE human <> '' AND assistant <> '')"""

TEXT_RAW = f"""raw AS (SELECT doc_id AS rec_id, ' 　"' || string_split(text, {NL})[1] || '"'' ' AS asked,
  array_to_string(string_split(text, {NL})[2:], {NL}) AS rest FROM documents)"""

TEXT_PAIRS = f"""{TEXT_RAW},
rp AS (SELECT rec_id, {clean("asked")} AS input, {clean("rest")} AS output FROM raw
  WHERE {clean("asked")} <> '' AND {clean("rest")} <> '')"""

SCORES = "sc AS (SELECT user_id AS ctx_id, event_id AS token_id, round(value, 0) AS score FROM events)"


def softmax_of(source: str) -> str:
    return f"""pr AS (SELECT ctx_id, token_id, e / sum(e) OVER (PARTITION BY ctx_id) AS prob
  FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY ctx_id)) / 20.0::DOUBLE) AS e FROM {source}))"""


EPOCHS = """ep AS (SELECT user_id AS run_id, CAST(day(ts) AS BIGINT) AS epoch,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT)::DOUBLE / count(*) / 100.0::DOUBLE AS val_loss FROM events GROUP BY ALL)"""

EARLY_STOP = f"""WITH RECURSIVE {EPOCHS},
e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM ep),
f AS (
  SELECT run_id, rn, val_loss AS best, 0::BIGINT AS bad, NULL::BIGINT AS stop FROM e WHERE rn = 1
  UNION ALL
  SELECT e.run_id, e.rn,
    CASE WHEN e.val_loss < f.best - 0.005::DOUBLE THEN e.val_loss ELSE f.best END,
    CASE WHEN e.val_loss < f.best - 0.005::DOUBLE THEN 0 ELSE f.bad + 1 END,
    CASE WHEN NOT (e.val_loss < f.best - 0.005::DOUBLE) AND f.bad + 1 >= 3 THEN e.epoch END
  FROM f JOIN e ON e.run_id = f.run_id AND e.rn = f.rn + 1 WHERE f.stop IS NULL)
SELECT run_id, arg_max(stop, rn) FILTER (stop IS NOT NULL) AS stop_epoch, round(arg_max(best, rn), 9) AS best_val,
  arg_max(bad, rn) AS bad_epochs, max(rn) AS n_epochs FROM f GROUP BY run_id"""

CONTEXT_WINDOW = """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total,
  row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS newest FROM conversations)
SELECT conv_id, turn, role, text, CASE WHEN total > 4 AND role = 'system' THEN 0 ELSE 1 END AS section
FROM n WHERE total <= 4 OR role = 'system' OR newest <= 4"""

ANSWERS = f"""{VOCAB},
answers AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
said_all AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ''), 1) AS step, unnest(string_split(text, '')) AS ch FROM answers WHERE text <> ''),
said AS (SELECT conv_id, turn, step, replace(ch, '~', '\\~') AS ch FROM said_all JOIN vocab USING (ch) WHERE id >= 4)"""


def packed(source: str, order: str, group_rows: int | None, block: int) -> str:
    group = f"(row_number() OVER (ORDER BY {order}) - 1) // {group_rows}" if group_rows else "0"
    return f"""{VOCAB},
g AS (SELECT *, row_number() OVER (ORDER BY {order}) AS r, {group} AS group_id FROM {source}),
t AS (SELECT group_id, r, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS p FROM g WHERE text <> ''),
o AS (SELECT group_id, coalesce(id, 3) AS id, row_number() OVER (PARTITION BY group_id ORDER BY r, p) - 1 AS spot,
  count(*) OVER (PARTITION BY group_id) AS total FROM t LEFT JOIN vocab USING (ch)),
b AS (SELECT group_id, spot // {block} AS block_id, string_agg(id, ',' ORDER BY spot) AS ids FROM o
  WHERE total < {block} OR spot < total // {block} * {block} GROUP BY ALL)"""


def encoded_documents(name: str, tokens: str) -> str:
    return ids_of(name, "documents", "doc_id", tokens)


SAMPLED = f"""WITH {SCORES}, top AS (SELECT ctx_id, token_id, score FROM (SELECT *, rank() OVER (PARTITION BY ctx_id ORDER BY score DESC) AS r FROM sc) WHERE r <= 50),
{softmax_of('top')},
u AS (SELECT *, (CAST('0x' || left(md5('42:' || ctx_id || ':' || token_id), 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM pr)
SELECT ctx_id, arg_max(token_id, ln(prob) - ln(-ln(u))) AS token_id FROM u GROUP BY 1"""


SQL = {
    "samples": f"WITH {SAMPLES} SELECT conv_id, turn, len(ids) AS n_tokens, {csv('ids')} AS ids FROM samples",
    "pairs_adjacent": f"WITH {ADJACENT} SELECT * FROM adj",
    "pairs_history": f"WITH {HISTORY} SELECT *, CAST(length(input) AS BIGINT) AS input_chars FROM hist",
    "pairs_history_cut": f"WITH {HISTORY} SELECT conv_id, turn, left(input, 128) AS input, output, CAST(length(input) AS BIGINT) AS input_chars FROM hist",
    "pairs_messages_nested": f"WITH {MESSAGES} SELECT * FROM msg",
    "pairs_sharegpt_nested": f"WITH {SHAREGPT} SELECT * FROM sg",
    "pairs_sharegpt_named": f"""WITH {SHAREGPT}, {neighbours("named", "'human'|'gpt', 'bot'").replace("named_m", "sg_m")} SELECT * FROM named""",
    "pairs_turns_nested": f"WITH {TURN_PAIRS} SELECT * FROM tp",
    "pairs_records": f"WITH {TEXT_PAIRS} SELECT * FROM rp",
    "pairs_records_numbers": "SELECT event_id AS rec_id, value AS number, 'True' AS output FROM events",
    "pairs_mixed": f"""WITH {MESSAGES}, {SHAREGPT.removeprefix(LINES + ",")}, {TURN_PAIRS.removeprefix(LINES + ",")}, {TEXT_PAIRS}
SELECT rec_id, 'messages' AS layout, pos, input, output FROM msg WHERE rec_id % 4 = 0
UNION ALL SELECT rec_id, 'sharegpt', pos, input, output FROM sg WHERE rec_id % 4 = 1
UNION ALL SELECT rec_id, 'turns', pos, input, output FROM tp WHERE rec_id % 4 = 2
UNION ALL SELECT rec_id, 'paired', 0, input, output FROM rp WHERE rec_id % 4 = 3""",
    "pair_drop_reasons": f"""WITH {CONTEXT} SELECT CASE WHEN role = 'system' THEN 'system' WHEN role <> 'user' THEN 'answer'
  WHEN next_role IS NULL THEN 'user_last' WHEN next_role <> 'assistant' THEN 'user_not_answered'
  WHEN {strip("text")} = '' OR {strip("next_text")} = '' THEN 'blank_side' ELSE 'paired' END AS reason, count(*) AS n_turns
FROM ctx GROUP BY 1""",
    "record_drop_reasons": f"""WITH {MESSAGES}, {SHAREGPT.removeprefix(LINES + ",")}, {TURN_SIDES.removeprefix(LINES + ",")}, {TEXT_RAW},
said AS (SELECT 'messages' AS layout, rec_id, pos, who = 'user' AS asks, who = 'assistant' AS answers, text FROM msg_m WHERE rec_id % 4 = 0
  UNION ALL SELECT 'sharegpt', rec_id, pos, who IN ('human', 'user'), who IN ('gpt', 'assistant', 'model', 'chatbot'), text FROM sg_m WHERE rec_id % 4 = 1),
after AS (SELECT *, lead(answers) OVER w AS next_answers, lead(text) OVER w AS next_text FROM said WINDOW w AS (PARTITION BY layout, rec_id ORDER BY pos)),
r AS (SELECT layout, CASE WHEN next_answers IS NULL THEN 'last' WHEN NOT asks THEN 'not_asked' WHEN NOT next_answers THEN 'not_answered'
    WHEN {strip("next_text")} = '' THEN 'blank_answer' ELSE 'paired' END AS reason FROM after
  UNION ALL SELECT 'turns', CASE WHEN human = '' OR assistant = '' THEN 'blank_side' ELSE 'paired' END FROM sides WHERE rec_id % 4 = 2
  UNION ALL SELECT 'paired', CASE WHEN {clean("asked")} = '' OR {clean("rest")} = '' THEN 'blank_side' ELSE 'paired' END FROM raw WHERE rec_id % 4 = 3)
SELECT layout, reason, count(*) AS n FROM r GROUP BY ALL""",
    "layouts": "SELECT doc_id AS rec_id, ['messages', 'sharegpt', 'turns', 'paired'][doc_id % 4 + 1] AS layout FROM documents",
    "detect_layout": """SELECT * FROM (VALUES ('m', 'messages'), ('s', 'sharegpt'), ('t', 'turns'), ('p', 'paired')) AS t(corpus, layout)
WHERE (SELECT count(*) FROM documents) > 0""",
    "uniform_system": """
SELECT 'by source' AS corpus, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS system FROM documents
UNION ALL SELECT 'one name', CASE WHEN count(DISTINCT regexp_replace(source, '[0-9]+$', '')) = 1 THEN min(regexp_replace(source, '[0-9]+$', '')) END FROM documents""",
    "dataset_summary": f"""WITH {TEXT_PAIRS}, {MESSAGES}
SELECT count(*) AS n_pairs, 'prompt' AS input_key, 'output' AS output_key, NULL::VARCHAR AS system_excerpt FROM rp
UNION ALL SELECT count(*), 'messages', 'messages', left('one system text of more than forty characters', 40) || '...' FROM msg""",
    "preview": f"""WITH {ADJACENT} SELECT conv_id, turn, {excerpt("input", 120)} AS input, {excerpt("output", 120)} AS output
FROM adj ORDER BY conv_id, turn LIMIT 2""",
    "read_jsonl_fields": "SELECT json_extract_string(props, '$.k') AS k FROM events",
    "read_json_documents": f"""WITH {LINES}
SELECT doc_id, CAST(i AS BIGINT) AS line, {clean("line")} AS output FROM dl WHERE doc_id % 4 <> 3 AND {clean("line")} <> ''
UNION ALL SELECT doc_id, doc_id, {clean("text")} FROM documents WHERE doc_id % 4 = 3 AND {clean("text")} <> ''""",
    "read_json_files": f"""SELECT doc_id, {clean("text")} AS output FROM documents WHERE {clean("text")} <> ''""",
    "corpus_facts": f"""WITH {MESSAGES}, {SHAREGPT.removeprefix(LINES + ",")}, {TURN_PAIRS.removeprefix(LINES + ",")}, {TEXT_PAIRS},
said AS (SELECT 'messages' AS corpus, rec_id, pos, who = 'user' AS asks, who = 'assistant' AS answers, text FROM msg_m
  UNION ALL SELECT 'sharegpt', rec_id, pos, who IN ('human', 'user'), who IN ('gpt', 'assistant', 'model', 'chatbot'), text FROM sg_m),
after AS (SELECT *, lead(answers) OVER w AS next_answers, lead(text) OVER w AS next_text FROM said WINDOW w AS (PARTITION BY corpus, rec_id ORDER BY pos)),
r AS (SELECT corpus, CASE WHEN next_answers IS NULL THEN 'last' WHEN NOT asks THEN 'not_asked' WHEN NOT next_answers THEN 'not_answered'
    WHEN {strip("next_text")} = '' THEN 'blank_answer' ELSE 'paired' END AS reason FROM after
  UNION ALL SELECT 'turns', CASE WHEN human = '' OR assistant = '' THEN 'blank_side' ELSE 'paired' END FROM sides
  UNION ALL SELECT 'paired', CASE WHEN {clean("asked")} = '' OR {clean("rest")} = '' THEN 'blank_side' ELSE 'paired' END FROM raw),
p AS (SELECT 'messages' AS corpus, input, output FROM msg UNION ALL SELECT 'sharegpt', input, output FROM sg
  UNION ALL SELECT 'turns', input, output FROM tp UNION ALL SELECT 'paired', input, output FROM rp),
c AS (SELECT corpus, count(*) AS n, max(length(input) + length(output) + 4) AS longest FROM p GROUP BY corpus),
v AS (SELECT corpus, count(DISTINCT ch) + 4 AS n FROM (SELECT corpus, unnest(string_split(input || ' ' || output, '')) AS ch FROM p) WHERE ch <> '{UNK_TEXT}' GROUP BY corpus)
SELECT corpus, reason AS fact, count(*) AS value FROM r GROUP BY ALL
UNION ALL SELECT corpus, 'n_records', (SELECT count(*) FROM documents) FROM c
UNION ALL SELECT corpus, 'n_samples', n FROM c UNION ALL SELECT corpus, 'longest', longest FROM c
UNION ALL SELECT corpus, 'block_size', greatest(128, least(greatest(longest, 16), 2048)) FROM c
UNION ALL SELECT corpus, 'vocabulary', n FROM v
UNION ALL SELECT corpus, 'n_unknown', (SELECT count(*) FROM p AS q WHERE q.corpus = c.corpus AND contains(q.input || q.output, '{UNK_TEXT}')) FROM c""",
    "split_corrupt": "SELECT event_id AS rec_id, CASE WHEN event_id % 3 = 0 THEN 'corrupt' ELSE 'good' END AS part FROM events",
    "vocab": f"WITH {VOCAB} SELECT * FROM vocab",
    "vocab_size": f"WITH {VOCAB} SELECT count(*) AS vocab_size FROM vocab",
    "vocab_round_trip": f"WITH {VOCAB} SELECT * FROM vocab",
    "char_frequency": "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY 1",
    "vocab_pruned": f"""WITH {vocab_from("SELECT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch HAVING count(*) >= 50")}
SELECT * FROM vocab""",
    "oov_report": f"""WITH {VOCAB} SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')
WHERE ch NOT IN (SELECT ch FROM vocab WHERE id >= 4) GROUP BY 1""",
    "encode": f"WITH {VOCAB}, {encoded_documents('enc', f'''list_concat(list_concat(['<bos>'], {chars('text')}), ['<eos>'])''')} SELECT doc_id, {csv('ids')} AS ids FROM enc",
    "encode_joined": f"WITH {VOCAB}, {encoded_documents('enc', chars('text'))} SELECT doc_id, {csv('ids')} AS ids FROM enc",
    "encode_arrow": f"WITH {VOCAB}, {encoded_documents('enc', chars('text'))} SELECT doc_id, {csv('ids')} AS ids FROM enc",
    "encode_plugged": f"SELECT doc_id, {csv("list_transform(string_split(text, ' '), lambda w: length(w))")} AS ids FROM documents",
    "encode_tokenizer_file": "SELECT doc_id, text FROM documents",
    "decode_round_trip": f"""WITH {VOCAB}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS p FROM documents)
SELECT doc_id, coalesce(string_agg(CASE WHEN id >= 4 THEN ch END, '' ORDER BY p), '') AS text FROM c LEFT JOIN vocab USING (ch) GROUP BY 1""",
    "decode_with_specials": f"""WITH {VOCAB}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS p FROM documents)
SELECT doc_id, '<bos>' || string_agg(CASE WHEN id >= 4 THEN ch ELSE '{UNK_TEXT}' END, '' ORDER BY p) || '<eos>' AS text FROM c LEFT JOIN vocab USING (ch) GROUP BY 1""",
    "shift_targets": f"WITH {SHIFTED} SELECT conv_id, turn, {csv('x')} AS x, {csv('y')} AS y FROM xy",
    "length_profile": f"""WITH {HISTORY}, l AS (SELECT length(input) + length(output) + 4 AS n FROM hist)
SELECT count(*) AS n_samples, max(n) AS longest, round(avg(n), 6) AS mean, greatest(least(greatest(max(n), 16), 2048), 512) AS block_size FROM l""",
    "write_samples": f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn)) AS r, count(*) OVER () AS n FROM samples)
SELECT conv_id, turn, CASE WHEN n > 1 AND r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split, {csv('ids')} AS ids FROM r""",
    "train_val_split": f"""WITH {HISTORY}, r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn)) AS r, count(*) OVER () AS n FROM hist)
SELECT conv_id, turn, CASE WHEN n > 1 AND r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r""",
    "assign_batches": f"WITH {BATCHES} SELECT conv_id, turn, 1 AS epoch, batch_id, row_in_batch FROM placed",
    "assign_batches_documents": f"""WITH {batched("(SELECT doc_id FROM documents)", "doc_id", "doc_id", 2, 16)}
SELECT doc_id, 2 AS epoch, batch_id, row_in_batch FROM placed""",
    "pad_batches": f"WITH {BATCHES} SELECT batch_id, row_in_batch, {csv('x')} AS x, {csv('y')} AS y FROM padded",
    "batch_matrices": f"""WITH {BATCHES} SELECT batch_id, CAST(count(*) AS INT) AS n_rows, string_agg({csv('x')}, ',' ORDER BY row_in_batch) AS x,
  string_agg({csv('y')}, ',' ORDER BY row_in_batch) AS y FROM padded GROUP BY 1""",
    "loss_mask": f"""WITH {BATCHES} SELECT batch_id, row_in_batch, CAST(len(list_filter(y, lambda t: t <> 0)) AS INT) AS n_counted,
  array_to_string(list_transform(y, lambda t: CASE WHEN t <> 0 THEN '1' ELSE '0' END), '') AS mask FROM padded""",
    "batch_plan": f"""WITH {HISTORY}, s AS (SELECT count(*) // 16 AS per FROM hist), ids AS (SELECT per, unnest(range(per * 3)) AS id FROM s),
p AS (SELECT id // per + 1 AS epoch, id % per AS batch, ((id % per + 1) % 4 = 0 OR id % per + 1 = per) AS is_step FROM ids)
SELECT *, CAST(count(*) FILTER (is_step) OVER (ORDER BY epoch, batch) AS BIGINT) AS global_step FROM p""",
    "lr_schedule": f"""WITH {HISTORY}, s AS (SELECT count(*) // 16 AS per FROM hist), ids AS (SELECT per, unnest(range(per * 3)) AS id FROM s),
p AS (SELECT id // per + 1 AS epoch, id % per AS batch, true AS is_step, id + 1 AS global_step, greatest(1, per * 3) AS total,
  CAST(floor(greatest(1, per * 3) * 0.05::DOUBLE) AS BIGINT) AS warm FROM ids)
SELECT epoch, batch, is_step, global_step, round(1e6 * 3e-4::DOUBLE * CASE WHEN global_step < warm THEN global_step::DOUBLE / greatest(1, warm)
  ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * (global_step - warm) / greatest(1, total - warm))) END, 6) AS lr FROM p""",
    "chat_messages": f"""WITH {TURN_SIDES},
m AS (SELECT DISTINCT rec_id, -1 AS turn, 0 AS side, 'system' AS role, system AS content FROM sides WHERE system <> ''
  UNION ALL SELECT rec_id, pos, 0, 'user', human FROM sides WHERE human <> '' OR assistant <> ''
  UNION ALL SELECT rec_id, pos, 1, 'assistant', assistant FROM sides WHERE human <> '' OR assistant <> '')
SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY turn, side) - 1 AS INT) AS pos, role, content FROM m""",
    "chat_messages_lists": f"""WITH {SHAREGPT}
SELECT rec_id, pos + 1 AS pos, CASE who WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'bot' THEN 'bot' ELSE 'assistant' END AS role, text AS content FROM sg_m
UNION ALL SELECT doc_id, 0, 'system', lang FROM documents""",
    "render_chat": f"""WITH {TEXT_RAW} SELECT rec_id, '<|im_start|>user' || {NL} || rec_id || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || rest ||
  '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS text FROM raw""",
    "render_turns": f"SELECT conv_id, turn, '<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL} AS piece FROM conversations",
    "render_roles": f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN '[ask] ' || text || {NL} WHEN 'assistant' THEN '[say] ' || text || ' [end]' || {NL}
  ELSE '<' || role || '> ' || text || {NL} END AS piece FROM conversations""",
    "tokenize_truncate": f"WITH {VOCAB}, {encoded_documents('enc', f'''list_slice({chars('text')}, 1, 512)''')} SELECT doc_id, CAST(len(ids) AS INT) AS n, {csv('ids')} AS ids FROM enc",
    "pack_blocks": f"WITH {packed('documents', 'doc_id', 300, 512)} SELECT group_id, block_id, ids FROM b",
    "pack_global": f"WITH {packed('conversations', 'conv_id, turn', None, 1024)} SELECT block_id, ids FROM b",
    "lm_collate": f"""WITH {VOCAB}, {encoded_documents('enc', f'''list_slice({chars('text')}, 1, 64)''')},
{batched("enc", "doc_id", "doc_id", 1, 4)},
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM placed WHERE batch_id < n // 4)
SELECT doc_id, {csv('list_resize(ids, w, 0)')} AS ids, {csv('list_resize(ids, w, -100)')} AS labels FROM w""",
    "finetune_turns": f"""WITH {VOCAB},
pc AS (SELECT conv_id, turn, '<|im_start|>' || role || {NL} || text || '<|im_end|>' || {NL} AS text, (dense_rank() OVER (ORDER BY conv_id) - 1) // 40 AS group_id FROM conversations),
t AS (SELECT group_id, conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS p FROM pc),
o AS (SELECT group_id, coalesce(id, 3) AS id, row_number() OVER (PARTITION BY group_id ORDER BY conv_id, turn, p) - 1 AS spot,
  count(*) OVER (PARTITION BY group_id) AS total FROM t LEFT JOIN vocab USING (ch))
SELECT group_id, spot // 512 AS block_id, string_agg(id, ',' ORDER BY spot) AS ids FROM o WHERE total < 512 OR spot < total // 512 * 512 GROUP BY ALL""",
    "finetune_split": f"""WITH {VOCAB}, {TEXT_RAW},
chat AS (SELECT rec_id, left('<|im_start|>user' || {NL} || rec_id || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} || rest || '<|im_end|>' || {NL}, 48) AS text FROM raw),
{ids_of("enc", "chat", "rec_id", chars("text"))},
s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || rec_id)) AS place, count(*) OVER () AS total FROM enc),
parts AS (SELECT rec_id, ids, CASE WHEN total > 1 AND place <= greatest(1, floor(total * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:1:' || rec_id), rec_id) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM parts),
b AS (SELECT *, r // 2 AS batch_id, CAST(r % 2 AS INT) AS row_in_batch FROM o WHERE split = 'val' OR r // 2 < n // 2),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY split, batch_id) AS w FROM b)
SELECT split, rec_id, batch_id, row_in_batch, {csv('list_resize(ids, w, 0)')} AS ids, {csv('list_resize(ids, w, -100)')} AS labels FROM w""",
    "pack_efficiency": f"""WITH {batched("(SELECT doc_id, length(text) AS len FROM documents)", "doc_id", "doc_id", 1, 16).replace("'42:1:'", "'42:'")},
c AS (SELECT batch_id, count(*) AS k, sum(len) AS re, sum(least(len, 512)) AS cu, max(least(len, 512)) AS wi FROM placed GROUP BY 1),
u AS (SELECT sum(k) AS n_rows, sum(re) AS real_ids, sum(cu) AS cut_ids, sum(k * wi) AS padded_cells FROM c),
g AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS g, length(text) AS len FROM documents),
s AS (SELECT g, sum(len) AS total FROM g GROUP BY 1),
q AS (SELECT sum(CASE WHEN total >= 512 THEN total // 512 * 512 ELSE total END) AS kept, sum(total) AS total FROM s)
SELECT n_rows::BIGINT AS n_rows, real_ids::BIGINT AS real_ids, cut_ids::BIGINT AS cut_ids, padded_cells::BIGINT AS padded_cells,
  kept::BIGINT AS packed_cells, kept::BIGINT AS packed_ids, (total - kept)::BIGINT AS dropped_ids FROM u, q""",
    "context_window_n2": CONTEXT_WINDOW,
    "normalize_history": f"""WITH {CONTEXT}
SELECT conv_id, false AS is_prompt, turn AS pos, 0 AS slot, 'user' AS role, text AS content FROM ctx WHERE role = 'user' AND next_role = 'assistant'
UNION ALL SELECT conv_id, false, turn, 1, 'assistant', next_text FROM ctx WHERE role = 'user' AND next_role = 'assistant' AND next_text <> ''
UNION ALL SELECT conv_id, true, 0, 0, 'user', {clean_keep("text")} FROM ctx WHERE role = 'user' AND next_role IS NULL""",
    "build_prompt": f"""WITH {VOCAB}, pt AS (SELECT conv_id, turn, CASE WHEN coalesce(system, '') <> '' THEN {strip(f"{strip('system')} || {NL} || {strip('text')}")} ELSE {strip('text')} END AS text FROM ctx WHERE role = 'user'),
{ids_of("enc", "pt", "conv_id, turn", f"list_concat(list_concat(['<bos>'], {chars('text')}), ['<eos>', '<bos>'])")}
SELECT conv_id, turn, {csv('ids')} AS ids FROM enc""",
    "truncate_prompt": f"""WITH {VOCAB}, pt AS (SELECT conv_id, turn, CASE WHEN coalesce(system, '') <> '' THEN {strip(f"{strip('system')} || {NL} || {strip('text')}")} ELSE {strip('text')} END AS text FROM ctx WHERE role = 'user'),
{ids_of("enc", "pt", "conv_id, turn", f"list_concat(list_concat(['<bos>'], {chars('text')}), ['<eos>', '<bos>'])")}
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n_full, {csv('ids[:252]')} AS ids FROM enc""",
    "truncate_prompt_ends": f"""WITH {VOCAB}, pt AS (SELECT conv_id, turn, CASE WHEN coalesce(system, '') <> '' THEN {strip(f"{strip('system')} || {NL} || {strip('text')}")} ELSE {strip('text')} END AS text FROM ctx WHERE role = 'user'),
{ids_of("enc", "pt", "conv_id, turn", f"list_concat(list_concat(['<bos>'], {chars('text')}), ['<eos>', '<bos>'])")}
SELECT conv_id, turn, CAST(len(ids) AS INT) AS n_full, {csv('CASE WHEN len(ids) > 101 THEN list_concat(ids[:50], ids[len(ids) - 50:]) ELSE ids END')} AS ids FROM enc""",
    "clean_message": f"""WITH q AS (SELECT conv_id, turn, chr(9) || '"'''' ' || text || ' ''" ' AS q FROM conversations)
SELECT conv_id, turn, {clean("q")} AS cleaned, {clean_keep("q")} AS kept FROM q""",
    "excerpts": f"SELECT doc_id, {excerpt('text', 120)} AS head FROM documents",
    "topk_ties": f"WITH {SCORES} SELECT ctx_id, token_id, score FROM (SELECT *, rank() OVER (PARTITION BY ctx_id ORDER BY score DESC) AS r FROM sc) WHERE r <= 5",
    "softmax": f"WITH {SCORES}, {softmax_of('sc')} SELECT ctx_id, token_id, round(prob, 9) AS prob FROM pr",
    "sample_one": SAMPLED,
    "sample_scores": SAMPLED,
    "nucleus": f"""WITH {SCORES}, {softmax_of('sc')},
c AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY ctx_id ORDER BY prob DESC, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr)
SELECT ctx_id, token_id FROM c WHERE before < 0.9::DOUBLE""",
    "assemble_generation": f"""WITH {ANSWERS} SELECT conv_id, turn, coalesce(string_agg(ch, '' ORDER BY step), '') AS text
FROM answers LEFT JOIN said USING (conv_id, turn) GROUP BY ALL""",
    "running_generation": f"""WITH {ANSWERS} SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INT) AS pos, md5(string_agg(ch, '') OVER w) AS text_md5
FROM said WINDOW w AS (PARTITION BY conv_id, turn ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    "throughput": """WITH t AS (SELECT user_id AS gen_id, count(*) AS n_tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS s FROM events GROUP BY 1)
SELECT gen_id, n_tokens, round(s, 3) AS seconds, round(CASE WHEN s > 0 THEN n_tokens / s ELSE 0 END, 9) AS tokens_per_sec FROM t""",
    "epoch_rollup": """WITH s AS (SELECT user_id AS run_id, CAST(day(ts) AS BIGINT) AS epoch, event_id AS step, event_type <> 'view' AS train, value AS loss,
  1.0::DOUBLE / (event_id + 1) AS lr, CAST(event_id % 7 + 1 AS DOUBLE) AS seconds, event_id % 100 AS n_tokens FROM events)
SELECT run_id, epoch, sum(seconds) AS seconds, count(*) FILTER (train) AS n_steps,
  round(coalesce(avg(loss) FILTER (train), 'NaN'::DOUBLE), 9) AS train_loss, round(coalesce(avg(loss) FILTER (NOT train), 0), 9) AS val_loss,
  round(arg_max(lr, step) FILTER (train), 9) AS lr, round(count(*) FILTER (train) * 2048 / sum(seconds), 9) AS nominal_tokens_per_sec,
  round(coalesce(sum(n_tokens) FILTER (train), 0)::DOUBLE / sum(seconds), 9) AS real_tokens_per_sec FROM s GROUP BY ALL""",
    "early_stop": EARLY_STOP,
    "best_epoch": f"WITH {EPOCHS} SELECT run_id, arg_min(epoch, (val_loss, epoch)) AS epoch, round(min(val_loss), 9) AS val_loss FROM ep GROUP BY 1",
    "pool_embeddings": f"""WITH {VOCAB}, d AS (SELECT label + 4 AS id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
a AS (SELECT id, dim, sum(n * x) / sum(n) AS x FROM d GROUP BY ALL), grid AS (SELECT id, unnest(range(64)) AS dim FROM vocab)
SELECT id, CAST(dim AS INT) AS dim, round(coalesce(x, 0), 6) AS x FROM grid LEFT JOIN a USING (id, dim)""",
    "initial_embeddings": f"""WITH {VOCAB}, d AS (SELECT label + 4 AS id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
a AS (SELECT id, dim, sum(n * x) / sum(n) AS x FROM d GROUP BY ALL), grid AS (SELECT id, unnest(range(80)) AS dim FROM vocab)
SELECT id, CAST(dim AS INT) AS dim, round(coalesce(x, 0), 6) AS x FROM grid LEFT JOIN a USING (id, dim)""",
    "initial_embeddings_projected": f"""WITH {VOCAB}, d AS (SELECT label + 4 AS id, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
a AS (SELECT id, dim, sum(n * x) / sum(n) AS x FROM d GROUP BY ALL), e AS (SELECT id, sum(x * x) AS energy FROM a GROUP BY id)
SELECT id, 48 AS n_dims, round(coalesce(energy, 0), 6) AS energy FROM vocab LEFT JOIN e USING (id)""",
    "pad_dims": """SELECT vec_id, CAST(dim AS INT) AS dim, round(coalesce(embedding[dim + 1]::DOUBLE, 0), 6) AS x
FROM (SELECT vec_id, embedding, unnest(range(80)) AS dim FROM embeddings)""",
    "svd_energy": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS energy FROM embeddings",
    "svd_columns": """SELECT i, j, true AS holds FROM (SELECT unnest(range(8))::INTEGER AS i) a, (SELECT unnest(range(8))::INTEGER AS j) b WHERE j >= i
UNION ALL SELECT -1, -1, count(*) > 0 FROM embeddings""",
    "stream_samples": f"""WITH {TURN_PAIRS}, {VOCAB}, {ids_of("made", "tp", "rec_id, pos", both_sides(BLOCK))}
SELECT rec_id, pos, {csv('ids')} AS ids FROM made""",
    "stream_context_window": CONTEXT_WINDOW,
    "stream_early_stop": EARLY_STOP,
    "stream_throughput": """WITH w AS (SELECT event_type AS source, date_trunc('hour', ts) AS window_start, count(*) AS n_tokens FROM events GROUP BY ALL)
SELECT source, window_start, n_tokens, round(n_tokens / 3600.0::DOUBLE, 9) AS tokens_per_sec FROM w""",
}
