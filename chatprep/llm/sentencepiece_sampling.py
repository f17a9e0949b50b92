"""SentencePiece segmentations: distinct samples by perturbed search over the lattice, and decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.wordpiece import displaced

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 3
ALPHA = 1.0
SEED = 23
_SPACE = "▁"
_CHUNK_CHARS = 100_000  # lattices and ways of a run take much more than its text
_MAX_NOISE = 23.0  # -log of the smallest exponential number that 32 random bits give
_FIRST_REACH = 30.0
_RANK_SHIFT = 2.0


@dataclass
class Pieces:
    """A model as tables: a trie over symbols (characters that pieces use), weights, and what pieces decode to."""

    symbol: np.ndarray  # of each code point; 0: in no piece
    base: np.ndarray
    owner: np.ndarray
    child: np.ndarray
    piece: np.ndarray  # at a node of the trie, or -1
    weight: np.ndarray  # log weight of each piece
    unknown: float  # log weight of a character in no piece
    edge_weight: np.ndarray  # of what an edge can stand for: a piece, or last, such a character
    stand_in: np.ndarray  # what stands on the edge of such a character: by code point, its byte, or from 128 on a mark
    byte_ids: np.ndarray | None
    unknown_id: int
    decoded: list[bytes]
    prefix: bool  # whether normalising puts a space in front
    word: re.Pattern
    model: bytes

    def normalized(self, texts: list[str]) -> list[str]:
        if not hasattr(self, "_processor"):
            self._processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return self._processor.normalize(texts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_processor"}


def load(path: str = MODEL) -> Pieces:
    """The tables of a model file, read on the driver.

    Weights are the scores of a unigram model, which are log probabilities. Scores of a BPE
    model only rank its merges: there, the piece of rank r weighs 1 / (r + 2), as words do
    by Zipf's law. A character in no piece is written in bytes, or as unknown, and weighs
    less than any piece.
    """
    with open(path, "rb") as file:
        proto = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)])
    scores = np.array([model.get_score(i) for i in range(n)])
    normal = np.flatnonzero(~special)
    weight = np.full(n, -np.inf)
    ranked = scores[normal].min() < -1000  # scores of merges, not log probabilities
    if ranked:
        order = normal[np.argsort(-scores[normal], kind="stable")]
        weight[order] = -np.log(np.arange(len(order)) + _RANK_SHIFT)
    else:
        weight[normal] = scores[normal]
    weight[normal] -= np.log(np.exp(weight[normal]).sum())
    letters = sorted({c for i in normal for c in names[i]})
    symbol = np.zeros(0x110000, np.int32)
    symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for i in normal.tolist():
        v = 0
        for c in symbol[[ord(c) for c in names[i]]].tolist():
            if c not in children[v]:
                children[v][c] = len(children)
                children.append({})
                piece.append(-1)
            v = children[v][c]
        piece[v] = i
    base, owner, child = displaced(children, len(letters) + 1)
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]) if any(model.is_byte(i) for i in range(n)) else None
    decoded = [b"" if model.is_control(i) else names[i].replace(_SPACE, " ").encode() for i in range(n)]
    decoded[model.unk_id()] = " ⁇ ".encode()
    if byte_ids is not None:
        for b, i in enumerate(byte_ids.tolist()):
            decoded[i] = bytes([b])
    crosses = any(_SPACE in names[i].lstrip(_SPACE) for i in normal)
    # Pieces have spaces at most in front: a text's lattice falls apart into its words.
    word = re.compile(r"(?s).+") if crosses else re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
    prefix = model.normalize("a").startswith(_SPACE)
    unknown = float(weight[normal].min() - 10)
    edge_weight = np.append(np.where(special, unknown, weight), unknown)
    ascii_ids = byte_ids[:128] if byte_ids is not None else np.full(128, n)
    stand_in = np.append(ascii_ids, n).astype(np.int32)
    trie = (symbol, base, owner, child, np.array(piece, np.int32))
    return Pieces(*trie, weight, unknown, edge_weight, stand_in, byte_ids, model.unk_id(), decoded, prefix, word, proto)


@dataclass
class Lattice:
    """Lattices of many words: nodes are the places between characters, edges are pieces.

    `log_q` is the log probability of an edge given its node, when whole words are drawn in
    proportion to the product of their pieces' weights. Edges are sorted by node, longer
    pieces first; those of node v are `first[v]` up to `first[v + 1]`. `steps` are their
    probabilities summed up within a node, the last one 1.
    """

    start: np.ndarray  # of each word: its first node
    end: np.ndarray
    first: np.ndarray
    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    log_q: np.ndarray
    log_rest: np.ndarray  # of the other edges of its node together
    steps: np.ndarray
    points: np.ndarray  # the code point after each node
    has_odd: bool  # whether some character is written in several bytes

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by a number in (0, 1)."""
        edge = self.first[node]
        on = np.flatnonzero(u >= self.steps[edge])
        while on.size:
            edge[on] += 1
            on = on[u[on] >= self.steps[edge[on]]]
        return edge


def lattice(pieces: Pieces, words: list[str], alpha: float) -> Lattice:
    """The lattices of some words, edge probabilities by one pass backwards."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(lengths + 1) - (lengths + 1)
    end = start + lengths
    n = int(end[-1]) + 1 if len(words) else 0
    points = np.zeros(n, np.int64)
    inner = np.ones(n, bool)
    inner[end] = False
    inner = np.flatnonzero(inner)  # nodes with a character after them
    points[inner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = np.zeros(n + 1, np.int32)
    symbol[inner] = pieces.symbol[points[inner]]
    # All places walk down the trie together.
    at, state, length = inner, np.zeros(len(inner), np.int32), 0
    sources, targets, found = [], [], []
    while at.size:
        s = symbol[at + length]
        slot = pieces.base[state] + s
        ok = np.flatnonzero((s > 0) & (pieces.owner[slot] == state))
        at, state = at[ok], pieces.child[slot[ok]]
        length += 1
        piece = pieces.piece[state]
        hit = np.flatnonzero(piece >= 0)
        sources.append(at[hit])
        targets.append(at[hit] + length)
        found.append(piece[hit])
        if length == 1:  # characters that are no piece
            odd = np.ones(n, bool)
            odd[end] = odd[at[hit]] = False
            odd = np.flatnonzero(odd)
            sources.append(odd)
            targets.append(odd + 1)
            found.append(pieces.stand_in[np.minimum(points[odd], 128)])
    counts = np.zeros(n + 1, np.int64)
    for x in sources:
        counts[x + 1] += 1
    first = np.cumsum(counts)
    total_edges = int(first[-1]) if n else 0
    source, target, piece = (np.empty(total_edges, np.int32) for _ in range(3))
    free = first[:-1].copy() if n else first
    for x, to, p in zip(sources[::-1], targets[::-1], found[::-1]):
        slot = free[x]
        source[slot], target[slot], piece[slot] = x, to, p
        free[x] += 1
    weight = alpha * pieces.edge_weight[piece]
    # Sums over all ways from a node to its word's end, nodes nearest to an end first.
    to_end = np.repeat(end, lengths + 1) - np.arange(n)
    total = np.zeros(n)
    far = to_end[source]
    longest = int(far.max(initial=0))
    # Small integers are sorted by counting.
    turn = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
    cuts = np.cumsum(np.bincount(far, minlength=longest + 1))
    for a, b in zip(cuts, cuts[1:]):
        edges = turn[a:b]
        nodes = source[edges]
        heads = np.concatenate([[0], np.flatnonzero(nodes[1:] != nodes[:-1]) + 1])
        total[nodes[heads]] = np.logaddexp.reduceat(weight[edges] + total[target[edges]], heads)
    log_q = weight + total[target] - total[source]
    # Node by node, so that sums do not depend on what other words are here.
    steps, width = np.exp(log_q), np.diff(first)
    nodes = np.flatnonzero(width > 1)
    for k in range(1, int(width.max(initial=0))):
        nodes = nodes[width[nodes] > k]
        steps[first[nodes] + k] += steps[first[nodes] + k - 1]
    steps[first[1:][width > 0] - 1] = 1.0
    with np.errstate(divide="ignore"):
        log_rest = np.log(np.maximum(-np.expm1(log_q), 0.0)) + 1e-6  # never less than any other's own
    return Lattice(start, end, first, source, target, piece, log_q, log_rest, steps, points, bool((piece >= len(pieces.decoded)).any()))


_ODD = 0x9E3779B97F4A7C15
_LONG = (1 << 64) - 1


def uniform(key: np.ndarray) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key, of 32 random bits."""
    z = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


def stream(*counters: int) -> int:
    """A 64-bit number for some counters; added to a key it gives another key."""
    key = 0
    for c in counters:
        key = (key ^ (c + 1)) * 0xD6E8FEB86659FD93 & _LONG
        key ^= key >> 32
    return key


def place_keys(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key for each word of a text, by the row's seed and the word's place."""
    return seeds + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)


def walked(net: Lattice, node: np.ndarray, end: np.ndarray, keys: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Random ways from nodes to the ends of their words: the edges, way after way, and where each way begins."""
    going, step = np.flatnonzero(node < end), 0
    at = node.copy()
    ways, edges, length = [], [], np.zeros(len(node) + 1, np.int64)
    while going.size:
        here = at[going]
        edge = net.drawn(here, uniform(keys[going] + np.uint64(stream(sample, step))))
        ways.append(going)
        edges.append(edge)
        length[going + 1] += 1
        at[going] = here = net.target[edge]
        going = going[here < end[going]]
        step += 1
    begins = np.cumsum(length)
    whole = np.empty(int(begins[-1]), np.int64)
    for step, (way, edge) in enumerate(zip(ways, edges)):
        whole[begins[way] + step] = edge
    return whole, begins


def finished(net: Lattice, node: int, end: int, key: int, sample: int) -> list[int]:
    """A random way from one node to the end of its word."""
    edges, keys = [], np.array([key], np.uint64)
    while node < end:
        u = float(uniform(keys + np.uint64(stream(sample, len(edges))))[0])
        edge = int(net.first[node])
        while u >= net.steps[edge]:
            edge += 1
        edges.append(edge)
        node = int(net.target[edge])
    return edges


@dataclass
class Way:
    """One segmentation of a text: its edges, the word of each, and its perturbed log probability."""

    edges: np.ndarray
    words: np.ndarray
    before: np.ndarray  # log probability of what precedes each edge
    log_p: float
    perturbed: float


def _way(net: Lattice, edges: np.ndarray, words: np.ndarray, perturbed: float) -> Way:
    sums = np.zeros(len(edges) + 1)
    np.cumsum(net.log_q[edges], out=sums[1:])
    return Way(edges, words, sums[:-1], float(sums[-1]), perturbed)


def others(net: Lattice, taken: np.ndarray, before: np.ndarray, perturbed: np.ndarray, least: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges not taken where an edge was, as far as they can come to `least`: (perturbed, which of the taken, edge).

    Each stands for all ways through it. Their best perturbed log probability is a Gumbel
    number around the log of their mass, given that it is below the way's own, `perturbed`;
    it cannot be more than `_MAX_NOISE` above that log.
    """
    steps = np.flatnonzero(before + net.log_rest[taken] >= least - _MAX_NOISE)
    first = net.first[net.source[taken[steps]]]
    width = net.first[net.source[taken[steps]] + 1] - first
    ordinal = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    step = np.repeat(steps, width)
    edge = np.repeat(first, width) + ordinal
    mass = before[step] + net.log_q[edge]
    free = np.flatnonzero((edge != taken[step]) & (mass >= least[step] - _MAX_NOISE))
    step, ordinal, edge, mass = step[free], ordinal[free], edge[free], mass[free]
    noise = np.log(-np.log(uniform(keys[step] + ordinal.astype(np.uint64) * np.uint64(_ODD))))
    return -np.logaddexp(-perturbed[step], noise - mass), step, edge


@dataclass
class Search:
    """What is known of a text: ways found, and the best edges not taken, (perturbed, way, step, edge), best first."""

    ways: list[Way]
    heap: list[tuple[float, int, int, int]]
    key: int
    begin: int = 0  # step from which the last way is its own
    beyond: float | None = None  # perturbed value of the best way left out, once all are found

    def least(self, wanted: int) -> float:
        return self.heap[wanted - 1][0] if len(self.heap) >= wanted else -np.inf


def look_around(net: Lattice, searches: list[Search], i: int, k: int) -> None:
    """Puts the edges not taken on the texts' way number `i` on their heaps, all texts together."""
    wanted = k - i
    pending = [(s, s.begin) for s in searches]
    while pending:
        parts = []
        for s, lo in pending:
            least = s.least(wanted)
            # What has too little mass cannot matter, whatever its noise.
            near = _MAX_NOISE - least if np.isfinite(least) else _FIRST_REACH if lo == s.begin else np.inf
            hi = max(lo, int(np.searchsorted(-s.ways[i].before, near, side="right")))
            parts.append((s, lo, hi, least))
        sizes = np.array([hi - lo for _, lo, hi, _ in parts])
        number = np.concatenate([np.arange(lo, hi) for _, lo, hi, _ in parts])
        mine = np.array([s.key + stream(999, i) & _LONG for s, _, _, _ in parts], np.uint64)
        value, at, edge = others(
            net,
            np.concatenate([s.ways[i].edges[lo:hi] for s, lo, hi, _ in parts]),
            np.concatenate([s.ways[i].before[lo:hi] for s, lo, hi, _ in parts]),
            np.repeat([s.ways[i].perturbed for s, _, _, _ in parts], sizes),
            np.repeat([least for _, _, _, least in parts], sizes),
            np.repeat(mine, sizes) + number.astype(np.uint64) * np.uint64(64 * _ODD & _LONG),
        )
        cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))
        pending = []
        for (s, lo, hi, least), a, b in zip(parts, cuts.tolist(), cuts[1:].tolist()):
            best = np.arange(a, b)
            if b - a > wanted:
                best = a + np.argpartition(value[a:b], b - a - wanted)[b - a - wanted :]
            found = zip(value[best].tolist(), [i] * len(best), number[at[best]].tolist(), edge[best].tolist())
            s.heap = sorted([*s.heap, *found], reverse=True)[:wanted]
            before, now = s.ways[i].before, s.least(wanted)
            if hi < len(before) and (now == -np.inf or before[hi] >= now - _MAX_NOISE):
                pending.append((s, hi))


def distinct_ways(net: Lattice, types: np.ndarray, begins: np.ndarray, counts: np.ndarray, fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seeds: np.ndarray, k: int) -> list[Search]:
    """For each text the `k` segmentations of largest perturbed log probability, and that of the next.

    Text t has the words `types` from `begins[t]` on; `fresh` are random ways through all
    words, one set for each sample. The best way is a plain sample. Every edge not taken on
    the way to a found one leads to ways not found yet, the best of which is known by its
    perturbed value before it is looked at: the search always goes on with the largest.
    """

    def tail(sample: int, t: int, word: int) -> tuple[np.ndarray, np.ndarray]:
        edges, words, at = fresh[sample]
        cut = slice(int(at[begins[t] + word]), int(at[begins[t] + counts[t]]))
        return edges[cut], words[cut]

    gumbel = (-np.log(-np.log(uniform(seeds + np.uint64(stream(998)))))).tolist()
    searches = [Search([_way(net, *tail(0, t, 0), g)], [], int(seed)) for t, (g, seed) in enumerate(zip(gumbel, seeds))]
    for i in range(k):
        going = [(t, s) for t, s in enumerate(searches) if s.beyond is None]
        look_around(net, [s for _, s in going], i, k)
        for t, s in going:
            if not s.heap or i + 1 == k:
                s.beyond = s.heap[0][0] if s.heap else -np.inf
                continue
            value, parent, step, edge = s.heap.pop(0)
            known = s.ways[parent]
            word = int(known.words[step])
            key = s.key + (word + 1) * _ODD & _LONG
            rest = [edge, *finished(net, int(net.target[edge]), int(net.end[types[begins[t] + word]]), key, i + 501)]
            after, owners = tail(i + 1, t, word + 1)
            path = np.concatenate([known.edges[:step], rest, after])
            owner = np.concatenate([known.words[:step], np.full(len(rest), word), owners])
            s.ways.append(_way(net, path, owner, value))
            s.begin = step + 1
    return searches


def ids_of(pieces: Pieces, net: Lattice, edges: np.ndarray) -> np.ndarray:
    """Piece ids of a way; characters in no piece in bytes."""
    ids = net.piece[edges]
    odd = np.flatnonzero(ids >= len(pieces.decoded)) if net.has_odd else ()
    if not len(odd):
        return ids
    parts, last = [], 0
    for i in odd.tolist():
        letter = chr(int(net.points[net.source[edges[i]]])).encode("utf-8", "replace")
        parts += [ids[last:i], pieces.byte_ids[list(letter)] if pieces.byte_ids is not None else np.array([pieces.unknown_id])]
        last = i + 1
    return np.concatenate([*parts, ids[last:]]).astype(np.int32)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about as many characters."""
    first = size = 0
    for i, length in enumerate(pa.compute.utf8_length(texts).to_pylist()):
        size += length or 0
        if size >= _CHUNK_CHARS or i + 1 == len(texts):
            yield first, i + 1
            first, size = i + 1, 0


def segmentations(pieces: Pieces, texts: list[str], seeds: np.ndarray, k: int, alpha: float) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each normalised text up to `k` distinct segmentations: (ids, log probability, inclusion probability)."""
    found = [pieces.word.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    words = list(chain.from_iterable(found))
    kinds = {word: i for i, word in enumerate(dict.fromkeys(words))}
    net = lattice(pieces, list(kinds), alpha)
    types = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
    del found, words
    begins = np.cumsum(counts) - counts
    place = np.arange(len(types)) - np.repeat(begins, counts)
    keys = place_keys(np.repeat(seeds, counts), place)
    start, end = net.start[types], net.end[types]
    fresh = []
    for sample in range(k):
        edges, ways = walked(net, start, end, keys, sample)
        fresh.append((edges, np.repeat(place, np.diff(ways)), ways))
    out = []
    for search in distinct_ways(net, types, begins, counts, fresh, seeds, k):
        beyond = search.beyond
        inclusions = [-np.expm1(-np.exp(min(700.0, way.log_p - beyond))) if np.isfinite(beyond) else 1.0 for way in search.ways]
        out.append([(ids_of(pieces, net, way.edges), way.log_p, float(p)) for way, p in zip(search.ways, inclusions)])
    return out


def encode(df: DataFrame, pieces: Pieces, k: int = SAMPLES, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Adds `samples`: up to `k` distinct segmentations of the whole text, drawn without replacement.

    Each is a struct of `ids`, `log_probability` (a segmentation is drawn in proportion to
    the product of its pieces' weights to the power `alpha`), `inclusion`, the probability
    that its perturbed log probability exceeds that of the first one left out, which makes
    sums over samples weighted by 1 / inclusion unbiased, and `restored`, whether its
    decoding is the text. They come by falling perturbed log probability. Draws depend on
    the row's id and `seed` alone, so reruns and any partitioning agree; rows without an id
    go by their text, rows that repeat an id and a text get the same samples.

    Null texts have null samples; empty ones have the one segmentation of no pieces. Texts
    with fewer segmentations than `k` have all of them. A column named `samples` is
    replaced. No row moves.
    """
    rows = df.drop("samples", "_seed")
    names = rows.columns
    # As large as the model file, whatever the data.
    held = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for batch in batches:
            seeds = batch["_seed"].to_numpy().view(np.uint64)
            for first, last in text_chunks(batch[text_col]):
                texts = batch[text_col].slice(first, last - first).to_pylist()
                plain = pieces.normalized([t or "" for t in texts])
                found = segmentations(pieces, plain, seeds[first:last], k, alpha)
                same = [[decoded_text(pieces.decoded, pieces.prefix, s[0]) == t for s in samples] for samples, t in zip(found, texts)]
                yield pa.RecordBatch.from_arrays([*[batch[n].slice(first, last - first) for n in names], _samples(found, same, texts)], names=[*names, "samples"])

    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), text_col)).otherwise(F.xxhash64(F.lit(seed), id_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("_seed", key).mapInArrow(run, f"{fields}, samples array<struct<ids: array<int>, log_probability: double, inclusion: double, restored: boolean>>")


def _samples(found: list, same: list, texts: list) -> pa.Array:
    """The column of samples, put together from flat arrays."""
    flat = [s for samples in found for s in samples]
    ids = [s[0] for s in flat]
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    columns = [inner, pa.array([s[1] for s in flat], pa.float64()), pa.array([s[2] for s in flat], pa.float64()), pa.array([x for row in same for x in row], pa.bool_())]
    structs = pa.StructArray.from_arrays(columns, names=["ids", "log_probability", "inclusion", "restored"])
    whole = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
    keep = pa.array([t is not None for t in texts])
    return pa.compute.if_else(keep, whole, pa.scalar(None, whole.type)) if None in texts else whole


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that a list of piece ids stands for.

    Pieces are joined, the space that normalising put in front is taken off, and bytes that
    are not UTF-8 become replacement characters. Null ids, and ids out of range, decode to
    null. A column named like the result is replaced. No row moves.
    """
    rows = df.drop(out) if out != ids_col else df
    names = rows.columns
    held = df.sparkSession.sparkContext.broadcast((pieces.decoded, pieces.prefix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded, prefix = held.value
        for batch in batches:
            column = batch[ids_col]
            texts = []
            for i in range(batch.num_rows):
                ids = column[i].values
                texts.append(None if ids is None else decoded_text(decoded, prefix, ids.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(texts, pa.string())], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{out}` string")


def decoded_text(decoded: list[bytes], prefix: bool, ids: np.ndarray) -> str | None:
    """The text of piece ids."""
    if len(ids) and not (0 <= ids.min() and ids.max() < len(decoded)):
        return None
    parts = itemgetter(*ids.tolist())(decoded) if len(ids) > 1 else [decoded[i] for i in ids]
    text = b"".join(parts).decode("utf-8", "replace")
    return text.removeprefix(" ") if prefix else text
