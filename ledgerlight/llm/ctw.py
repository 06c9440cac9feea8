"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the
DEPTH bytes before it.  Every node keeps a Krichevsky-Trofimov estimate of its
decisions, and a node's weighted probability is half its own estimate's block
probability and half the product of its children's.  The probability of a
decision is therefore a mixture of the estimates at all depths along its
context, with weights that the training text has settled.  A text begins after
DEPTH end marks and closes with one; its score sums its bytes' log10
probabilities, so -score / log10(2) / bytes is the code length per byte.

Counts cover every training text.  Blocks sum up their own contexts and words,
even ranges of the keys sum up the blocks, and trees are built from the sums in
parts of about PART_CODES contexts, whole classes of the two most recent bytes.
Parts meet only in the two shallowest depths, 256 * 255 decisions at most.  Each
block is answered for the contexts and words that it holds, so no task ever
holds the whole model.

Null text is empty: it is one end token and one end mark.  A null doc_id is
in training.  Rows that repeat count as often as they stand.  Without any
training text every decision has probability 1/2.  An empty table gives an
empty table.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import blocks as bl
from .shared import drop, written

DEPTH = 5
#: Stands for the beginning and the end of a text; no UTF-8 text holds this byte.
MARK = 0xFF
HELD_OUT, FOLDS = 2, 7
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_U = np.uint64
_PART = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("value", pa.binary())])
_PART_DDL = "part int, n int, keys binary, value binary"
_MODEL = pa.schema([("rng", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("value", pa.binary())])
_MODEL_DDL = "rng int, n int, keys binary, value binary"
_TOP = pa.schema([("node", pa.int32()), ("zeros", pa.int64()), ("ones", pa.int64()), ("below", pa.float64())])
_TOP_DDL = "node int, zeros long, ones long, below double"


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series after moving x above 8."""
    x = np.asarray(x, float)
    low = np.maximum(0, np.ceil(8 - x))
    shift = np.zeros_like(x)
    y = x.copy()
    while (low > 0).any():
        more = low > 0
        shift[more] += np.log(y[more])
        y[more] += 1
        low[more] -= 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability that the estimate gives to so many zeros and ones in a row."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1.0)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b) - np.log(2)


class Level:
    """The nodes of one depth and one bit of the byte: sorted keys (context, bits so far), counts, weighted log probability."""

    def __init__(self, keys, zeros, ones, below):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = kt_block(zeros, ones)
        self.weighted = own if below is None else _half(own, below)
        # the share of the node's own estimate in its mixture
        self.own = np.ones(len(keys)) if below is None else np.exp(own - np.logaddexp(own, below))

    def estimate(self, keys: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of each bit, given that of the deeper contexts; 1/2 where the node is unknown."""
        if not len(self.keys):
            return np.full(len(keys), 0.5)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        kt = (np.where(bit, self.ones[i], self.zeros[i]) + 0.5) / (self.zeros[i] + self.ones[i] + 1.0)
        return np.where(self.keys[i] == keys, self.own[i] * kt + (1 - self.own[i]) * deeper, 0.5)


def _context(codes: np.ndarray, depth: int, bits: int, full: int) -> np.ndarray:
    """Node keys: the `depth` most recent bytes, then `bits` leading bits of the coded byte."""
    return codes >> _U(8 * (full - depth) + 8) << _U(bits) | (codes & _U(255)) >> _U(8 - bits)


def tree(codes: np.ndarray, counts: np.ndarray, depth: int) -> list[list[Level]]:
    """Levels [d][bit] for depths 2..depth; codes are (recent, ..., oldest, coded) bytes, sorted."""
    out: list[list[Level]] = [[None] * 8 for _ in range(depth + 1)]  # type: ignore[list-item]
    for bits in range(8):
        bit = codes >> _U(7 - bits) & _U(1)
        keys = _context(codes, depth, bits, depth)
        zeros, ones, below = np.where(bit == 0, counts, 0), np.where(bit == 1, counts, 0), None
        for d in range(depth, 1, -1):
            unique, place = np.unique(keys, return_inverse=True)
            z, o = (np.bincount(place, x, len(unique)) for x in (zeros, ones))
            level = Level(unique, z, o, None if below is None else np.bincount(place, below, len(unique)))
            out[d][bits] = level
            zeros, ones, below = z, o, level.weighted
            # the oldest byte leaves the key
            keys = unique >> _U(bits + 8) << _U(bits) | unique & _U((1 << bits) - 1)
    return out


Top = tuple[np.ndarray, np.ndarray]


def top(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[Top]:
    """Depths 0 and 1, by decision (1, then bits so far; before it, at depth 1, the most recent byte).

    For each: the probability of a one, and the share of the node's own estimate; 1/2 and 1 at unknown nodes of depth 1.
    """
    out: list[Top] = []
    z, o, w = (np.bincount(nodes, x, 1 << 16) for x in (zeros, ones, below))
    for size in (1 << 16, 256):
        own = kt_block(z, o)
        out.insert(0, ((o + 0.5) / (z + o + 1), np.exp(own - np.logaddexp(own, w))))
        seen = z + o > 0
        weighted = np.where(seen, _half(own, w), 0.0)
        out[0][1][~seen] = 1.0
        z, o, w = (x.reshape(-1, 256).sum(0) for x in (z, o, weighted)) if size > 256 else (z, o, w)
    return out


def log10_probabilities(codes: np.ndarray, levels: list[list[Level]], tops: list[Top], depth: int) -> np.ndarray:
    """log10 probability of the coded byte of each code."""
    out = np.zeros(len(codes))
    recent = (codes >> _U(8 * depth)).astype(np.int64) << 8
    for bits in range(8):
        bit = (codes >> _U(7 - bits) & _U(1)).astype(bool)
        p = np.full(len(codes), 0.5)
        for d in range(depth, 1, -1):
            p = levels[d][bits].estimate(_context(codes, d, bits, depth), bit, p)
        node = (1 << bits) + ((codes & _U(255)) >> _U(8 - bits)).astype(np.int64)
        for (one, own), at_node in ((tops[1], recent + node), (tops[0], node)):
            p = own[at_node] * np.where(bit, one[at_node], 1 - one[at_node]) + (1 - own[at_node]) * p
        out += np.log10(p)
    return out


def top_nodes(levels: list[list[Level]]) -> pa.Table:
    """What the two shallowest depths need of a part: a row for each recent byte and decision."""
    parts = []
    for bits in range(8):
        level = levels[2][bits]
        recent = (level.keys >> _U(bits + 8)).astype(np.int64)
        parts.append(((recent << 8) + (1 << bits) + (level.keys & _U((1 << bits) - 1)).astype(np.int64), level.zeros, level.ones, level.weighted))
    node, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, place = np.unique(node, return_inverse=True)
    zeros, ones, below = (np.bincount(place, x, len(unique)) for x in sums)
    return pa.Table.from_arrays([pa.array(unique.astype(np.int32)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(below)], schema=_TOP)


class Found:
    """Values of sorted 64-bit keys, found through a hash table that stays in the processor's cache."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, ~_U(0)), np.zeros(1 << bits, values.dtype)
        left, step = np.arange(len(keys)), 0
        free = np.ones(1 << bits, bool)
        while len(left):
            slot = (self._slot(keys[left]) + step) & self.mask
            ok = free[slot]
            first = np.unique(slot[ok], return_index=True)[1]
            put = np.flatnonzero(ok)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            free[slot[put]] = False
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, step = left[stay], step + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be known."""
        slot = self._slot(keys)
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            left = left[self.keys[slot[left]] != keys[left]]
        return self.values[slot]


def coded(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A code for every byte and end mark, and the first code of each text (n + 1)."""
    n = len(offsets) - 1
    size = np.diff(offsets) + depth + 1
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), MARK, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(begin + depth - offsets[:-1], np.diff(offsets))] = raw
    at_byte = at.ranges(begin + depth, np.diff(offsets) + 1)
    code = np.zeros(len(padded), _U)
    code += padded
    for k in range(1, depth + 1):
        code[k:] |= padded[:-k].astype(_U) << _U(8 * (depth + 1 - k))
    return code[at_byte], np.append(0, np.cumsum(np.diff(offsets) + 1))[: n + 1]


def trained(ids: np.ndarray) -> np.ndarray:
    return np.array([i == bl.NULL_ID or zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT for i in ids.tolist()], bool)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _tally(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each stands where learning is allowed."""
    if learns.all():
        unique, n = np.unique(keys, return_counts=True)
        return unique, n
    a, n = np.unique(keys[learns], return_counts=True)
    b = np.unique(keys[~learns])
    return _counted([(a, n), (b, np.zeros(len(b), np.int64))])


def ranged(codes: np.ndarray, ranges: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """How codes are dealt: by range, in order inside each; those with the same older context share a range."""
    rng = (at.fmix(codes >> _U(16)) >> _U(32)) * _U(ranges) >> _U(32)
    order = np.argsort(rng, kind="stable")
    begin = bl.firsts(rng[order])
    return order, [(int(rng[order[a]]), slice(int(a), int(b))) for a, b in zip(begin, np.append(begin[1:], len(order)), strict=True)]


#: Words and codes with their counts; the number of training texts.
WORDS, CODES, TEXTS = 0, 1, 2
KINDS = {WORDS: bl.Kind(reduce=("sum",)), CODES: bl.Kind(reduce=("sum",), real=True, deal=ranged)}


def _tallied(table: pa.Table, learns: np.ndarray, depth: int) -> tuple[tuple, tuple]:
    none = (np.zeros(0, _U), np.zeros(0, np.int64))
    words, codes = none, none
    for row, end, raw, offsets in at.pieces(table.column("text")):
        low, train = at.LOWER[raw], learns[row:end]
        start, stop, first = at.words(low, offsets)
        words = _counted([words, _tally(at.word_names(low, start, stop), np.repeat(train, np.diff(first)))])
        code, first = coded(low, offsets, depth)
        codes = _counted([codes, _tally(code, np.repeat(train, np.diff(first)))])
    return words, codes


def _ask(p: bl.Plan, depth: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        table, block = bl.in_order(table), key[0].as_py()
        learns = trained(bl.doc_ids(table.column("doc_id")))
        (keys, n), (codes, m) = _tallied(table, learns, depth)
        rows = bl.ask(KINDS, WORDS, block, p.first, keys, None, [n]) + bl.ask(KINDS, CODES, block, p.first, codes, None, [m])
        return bl.table([*rows, (TEXTS, -1, block, int(learns.sum()), b"", b"", [])], bl.ASK)

    return ask


def word_sums(words: bl.Merged) -> tuple:
    """Distinct words and, in digits, tokens of the training texts, in a range."""
    n = words.values[0]
    return int((n > 0).sum()), str(int(n.sum())).encode(), b"", []


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All distinct keys of a group's rows with their summed counts."""
    size = table.column("n").to_pylist()
    keys, value = table.column("keys"), table.column("value")
    parts = [(bl.unpacked(keys[i].as_py(), n), bl.unplain(value[i].as_py(), n).astype(np.int64)) for i, n in enumerate(size)]
    return _counted(parts)


#: Distinct codes that a part of the trees holds, about.
PART_CODES = 1 << 20


def _part_of(codes: np.ndarray, depth: int) -> np.ndarray:
    """The two most recent bytes: no node of depth 2 or more lies in two such classes."""
    return (codes >> _U(8 * (depth - 1))).astype(np.int64)


def _summed(table: pa.Table) -> pa.Table:
    m = bl.merged(KINDS[CODES], bl.asked(KINDS[CODES], table))
    return bl.table([(table.column("rng")[0].as_py(), len(m.keys), bl.packed(m.keys), bl.plain(m.values[0]))], _MODEL)


def _sizes(depth: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, keys in zip(batch.column("n").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                part, size = np.unique(_part_of(bl.unpacked(keys, n), depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(size)], ["pair", "codes"])

    return sizes


def parted(sizes: np.ndarray, most: int) -> np.ndarray:
    """A part for each pair of recent bytes: neighbours share one while it has at most so many codes; a larger pair is alone."""
    part, held, out = 0, 0, np.zeros(len(sizes), np.int32)
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            part, held = part + 1, 0
        out[i] = part
        held += n
    return out


def _split(depth: int, part_of_pair: np.ndarray):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, keys, value in zip(*(batch.column(c).to_pylist() for c in ("n", "keys", "value")), strict=True):
                codes, counts = bl.unpacked(keys, n), bl.unplain(value, n)
                part = part_of_pair[_part_of(codes, depth)]  # rises with the codes
                begin = bl.firsts(part)
                rows = [(int(part[a]), int(b - a), bl.packed(codes[a:b]), bl.plain(counts[a:b])) for a, b in zip(begin, np.append(begin[1:], n), strict=True)]
                yield from bl.table(rows, _PART).to_batches()

    return split


def _part_tops(depth: int):
    def part(table: pa.Table) -> pa.Table:
        codes, n = _gathered(table)
        return top_nodes(tree(codes[n > 0], n[n > 0], depth))

    return part


def _model(ranges: int, depth: int, tops: list[Top]):
    def model(table: pa.Table) -> pa.Table:
        codes, n = _gathered(table)
        p = log10_probabilities(codes, tree(codes[n > 0], n[n > 0], depth), tops, depth).astype(np.float32)
        order, cuts = ranged(codes, ranges)
        codes, p = codes[order], p[order]
        return bl.table([(r, x.stop - x.start, bl.packed(codes[x]), p[x].tobytes()) for r, x in cuts], _MODEL)

    return model


def _answer_codes(key: tuple, table: pa.Table, model: pa.Table) -> pa.Table:
    """The probabilities of each piece's codes."""
    own = [(bl.unpacked(x["keys"], x["n"]), np.frombuffer(x["value"], np.float32)) for x in model.to_pylist()]
    codes, p = (np.concatenate(x) for x in zip(*own, strict=True))
    order = np.argsort(codes)
    codes, p = codes[order], p[order]
    rows = []
    for x in table.select(["asker", "n", "keys"]).to_pylist():
        rows.append((CODES, key[0].as_py(), x["asker"], x["n"], b"", b"", [p[np.searchsorted(codes, bl.unpacked(x["keys"], x["n"]))].tobytes()]))
    return bl.table(rows, bl.ASK)


def _score(p: bl.Plan, depth: int, texts: int, tokens: int, distinct: int):
    total, kinds = tokens + texts, distinct + (texts > 0)
    base = np.log10(total + kinds + 1)

    def score(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table = bl.in_order(table)
        ids = bl.doc_ids(table.column("doc_id"))
        told = told.sort_by("rng").to_pylist()
        (word_keys, _), (code_keys, _) = _tallied(table, np.ones(len(ids), bool), depth)
        word_n = np.concatenate([np.zeros(0, np.int64), *(bl.unplain(r["vals"][0], r["n"]).astype(np.int64) for r in told if r["kind"] == WORDS)])
        codes = Found(code_keys[ranged(code_keys, p.first)[0]], np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r["vals"][0], np.float32) for r in told if r["kind"] == CODES)]))
        out = []
        for row, end, raw, offsets in at.pieces(table.column("text")):
            low = at.LOWER[raw]
            start, stop, first = at.words(low, offsets)
            n = word_n[np.searchsorted(word_keys, at.word_names(low, start, stop))]
            run = np.append(0.0, np.cumsum(np.log10(n + 1.0)))
            known = np.append(0, np.cumsum(n > 0))
            n_tokens = np.diff(first) + 1
            code, first_code = coded(low, offsets, depth)
            score = np.add.reduceat(codes.get(code).astype(float), first_code[:-1])
            base_score = run[first[1:]] - run[first[:-1]] + np.log10(texts + 1.0) - n_tokens * base
            out.append((n_tokens, known[first[1:]] - known[first[:-1]] + (texts > 0), base_score, score))
        n_tokens, n_known, base_score, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays(
            [bl.restored(ids), pa.array(~trained(ids)), pa.array(n_tokens), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(ids), total)), pa.array(base_score), pa.array(scores)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    p = bl.plan(bl.block_count(docs))
    by_block = bl.blocked(docs, p.blocks).groupBy("block")
    asks = written(by_block.applyInArrow(_ask(p, depth), bl.ASK_DDL))
    code_asks = asks.filter(F.col("kind") == CODES)
    fine = bl.up(code_asks, KINDS, p)
    fine = written(fine) if p.wide else fine
    summed = written(fine.groupBy("rng").applyInArrow(_summed, _MODEL_DDL))
    # the number of codes of each of 65,536 pairs of recent bytes comes to the driver, which deals them into parts
    found = summed.mapInArrow(_sizes(depth), "pair long, codes long").groupBy("pair").agg(F.sum("codes").alias("codes")).toPandas()
    sizes = np.zeros(1 << 16, np.int64)
    sizes[found["pair"].to_numpy()] = found["codes"].to_numpy()
    parts = written(summed.mapInArrow(_split(depth, parted(sizes, PART_CODES)), _PART_DDL))
    drop(summed)
    # at most 255 decisions for each of 256 recent bytes
    at_top = parts.groupBy("part").applyInArrow(_part_tops(depth), _TOP_DDL).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas()
    tops = top(*(at_top[c].to_numpy() for c in ("node", "zeros", "ones", "below")))
    model = parts.groupBy("part").applyInArrow(_model(p.ranges, depth, tops), _MODEL_DDL)
    for_codes = fine.groupBy("rng").cogroup(model.groupBy("rng")).applyInArrow(_answer_codes, bl.ASK_DDL)
    for_codes = bl.down(code_asks, for_codes, KINDS, p, {CODES: bl.tell_all})
    for_words = written(bl.exchange(asks.filter(F.col("kind") == WORDS), KINDS, p, {WORDS: bl.tell_all}, {WORDS: word_sums}))
    texts = asks.filter(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    sums = for_words.filter("asker = -1").agg(F.sum("n").alias("known"), F.sum(F.col("keys").cast("string").cast("long")).alias("tokens")).first()
    final = _score(p, depth, int(texts), int(sums["tokens"] or 0), int(sums["known"] or 0))
    told = for_words.filter("asker >= 0").unionByName(for_codes)
    return by_block.cogroup(told.groupBy("asker")).applyInArrow(final, RESULT)
