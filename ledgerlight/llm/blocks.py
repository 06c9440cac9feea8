"""Blocks of documents that ask each other about keys.

Documents are dealt by a hash of their identifier into blocks of about
BLOCK_BYTES of text.  Each block sums up its keys first, so a key that a third
of all documents hold is sent once by each block, however often it stands
there.  A block's sorted keys are cut into ranges of the key space and sent as
packed arrays, pieces; a range merges its part of every block and answers each
block.  Ranges are even, because keys are hashes.

One piece for each block and range would be a number that grows with the square
of the data.  Beyond DIRECT ranges the exchange therefore goes by cells: blocks
send to a square root of the ranges, a cell merges such pieces of a batch of
blocks and asks the ranges as if it were a block, and passes the answers on.
Pieces then grow as blocks * sqrt(blocks), and hold as many keys as before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
#: Ranges up to which every block asks every range.
DIRECT = 1 << 11
#: Stands for a null identifier, which counts as the largest.
NULL_ID = np.int64(2**63 - 1)


def block_bytes(spark: SparkSession) -> int:
    """BLOCK_BYTES, or more where executors say that each core has more than 256 times that in memory."""
    conf = spark.sparkContext.getConf()
    memory, cores = conf.get("spark.executor.memory"), conf.get("spark.executor.cores")
    if not memory or not cores:
        return BLOCK_BYTES
    return max(BLOCK_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(memory) // int(cores) // 256)


def block_count(docs: DataFrame, column: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(1, -(-int(size) // block_bytes(docs.sparkSession)))


def blocked(docs: DataFrame, count: int, together: bool = False) -> DataFrame:
    """doc_id, text and block; the exchange by block is the same wherever it is used, so Spark reuses it.

    Rows of one identifier share a block; rows without one spread by their text, unless they must stay `together`.
    """
    ident = F.col("doc_id").cast("long")
    key = F.xxhash64(ident) if together else F.when(ident.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(ident))
    return docs.select(ident.alias("doc_id"), "text", F.pmod(key, F.lit(count)).cast("int").alias("block"))


def doc_ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(int(NULL_ID)).to_numpy().astype(np.int64)


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a block by identifier and text, whatever order they came in."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table


def restored(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, mask=ids == NULL_ID)


def plain(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs; zero bytes compress away."""
    v = np.ascontiguousarray(values, np.uint64)
    planes = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return bytes([planes]) + v.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unplain(data: bytes, n: int) -> np.ndarray:
    planes = data[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(data, np.uint8, offset=1).reshape(planes, n).T
    return out.view(np.uint64).ravel()


def packed(keys: np.ndarray) -> bytes:
    """Sorted numbers as gaps."""
    return plain(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplain(data, n), dtype=np.uint64)


def range_cuts(keys: np.ndarray, ranges: int, first: int, last: int) -> np.ndarray:
    """Where each of the ranges first..last - 1, of `ranges` even parts of the 64-bit key space, begins in sorted keys; then their end."""
    low = [-(-(r << 64) // ranges) for r in range(first + 1, last)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(low, np.uint64)), [len(keys)]]).astype(np.int64)


def even(keys: np.ndarray, ranges: int, first: int, last: int) -> tuple[np.ndarray | None, list[tuple[int, slice]]]:
    """How sorted keys that lie in the ranges first..last - 1 are dealt: an order (None: as it is) and the slice of each range."""
    cuts = range_cuts(keys, ranges, first, last)
    return None, [(first + int(r), slice(int(cuts[r]), int(cuts[r + 1]))) for r in np.flatnonzero(np.diff(cuts))]


@dataclass(frozen=True)
class Kind:
    """What a sort of piece holds: keys (shifted right by `shift`), with `more` another part of the key, and a value for
    each entry of `reduce` (sum, min or max) by which equal keys are merged; with no values sent, a sum counts pieces.

    With `delta` the second value is sent as what it is above the first.  `real` answers are 32-bit floats.
    """

    shift: int = 0
    more: bool = False
    reduce: tuple[str, ...] = ()
    delta: bool = False
    real: bool = False
    deal: Callable = even


@dataclass(frozen=True)
class Plan:
    """Blocks, ranges and, where the exchange goes by cells, how many ranges blocks send to (`wide`) and blocks a batch has."""

    blocks: int
    ranges: int
    wide: int = 0
    batch: int = 0

    @property
    def first(self) -> int:
        return self.wide or self.ranges

    @property
    def pieces(self) -> int:
        """The largest number of pieces that are sent towards the ranges."""
        if not self.wide:
            return self.blocks * self.ranges
        return self.blocks * self.wide + -(-self.blocks // self.batch) * self.ranges


def plan(blocks: int) -> Plan:
    ranges = -(-blocks // 3)  # each sees about as much as three blocks ask
    if ranges <= DIRECT:
        return Plan(blocks, ranges)
    wide = math.isqrt(ranges - 1) + 1
    return Plan(blocks, wide * -(-ranges // wide), wide, wide)


ASK = pa.schema([("kind", pa.int32()), ("rng", pa.int32()), ("asker", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("vals", pa.list_(pa.binary()))])
ASK_DDL = "kind int, rng int, asker int, n int, keys binary, more binary, vals array<binary>"


@dataclass
class Piece:
    asker: int
    keys: np.ndarray
    more: np.ndarray | None
    values: list[np.ndarray]


def ask(kinds: dict[int, Kind], number: int, asker: int, ranges: int, keys: np.ndarray, more: np.ndarray | None = None, values: list[np.ndarray] = (), first: int = 0, last: int | None = None) -> list[tuple]:
    """Rows of ASK for sorted keys that lie in the ranges first..last - 1."""
    kind = kinds[number]
    order, cuts = kind.deal(keys, ranges, first, ranges if last is None else last)
    if order is not None:
        keys, more, values = keys[order], more if more is None else more[order], [v[order] for v in values]
    values = [v.view(np.uint64) if v.dtype != bool else v for v in values]
    if kind.delta:
        values = [values[0], values[1] - values[0]]
    return [(number, r, asker, x.stop - x.start, packed(keys[x] >> np.uint64(kind.shift)), plain(more[x]) if kind.more else b"", [plain(v[x]) for v in values]) for r, x in cuts]


def asked(kind: Kind, rows: pa.Table) -> list[Piece]:
    out = []
    for r in rows.to_pylist():
        n = r["n"]
        values = [unplain(v, n) for v in r["vals"]]
        if kind.delta:
            values = [values[0], values[0] + values[1]]
        if not values and kind.reduce:
            values = [np.ones(n, np.uint64)]
        out.append(Piece(r["asker"], unpacked(r["keys"], n) << np.uint64(kind.shift), unplain(r["more"], n) if kind.more else None, values))
    return out


@dataclass
class Merged:
    """Distinct keys in order with their reduced values, and for all pieces' keys, one piece after another, where each went."""

    keys: np.ndarray
    more: np.ndarray | None
    values: list[np.ndarray]
    place: np.ndarray


def merged(kind: Kind, pieces: list[Piece]) -> Merged:
    keys = np.concatenate([p.keys for p in pieces])
    more = np.concatenate([p.more for p in pieces]) if kind.more else None
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if more is not None:
        more = more[order]
        new[1:] |= more[1:] != more[:-1]
    begin = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    values = []
    for i, name in enumerate(kind.reduce):
        every = np.concatenate([p.values[i] for p in pieces])[order]
        # identifiers may be negative
        values.append(np.add.reduceat(every, begin) if name == "sum" else (np.minimum if name == "min" else np.maximum).reduceat(every.view(np.int64), begin).view(np.uint64))
    return Merged(keys[begin], more if more is None else more[begin], values, place)


#: Makes an answer (n, keys, more, values) from a piece and the reduced values of its keys; None: nothing to tell.
Tell = Callable[[Piece, list[np.ndarray]], tuple | None]


def tell_all(piece: Piece, totals: list[np.ndarray]) -> tuple:
    """Every reduced value of every key."""
    return len(piece.keys), b"", b"", [plain(t) if t.dtype == np.uint64 else t.tobytes() for t in totals]


def _told(number: int, rng: int, pieces: list[Piece], totals: list[np.ndarray], place: np.ndarray, tell: Tell) -> list[tuple]:
    rows, i = [], 0
    for p in pieces:
        mine = place[i : i + len(p.keys)]
        i += len(p.keys)
        if (row := tell(p, [t[mine] for t in totals])) is not None:
            rows.append((number, rng, p.asker, *row))
    return rows


def up(asks: DataFrame, kinds: dict[int, Kind], p: Plan) -> DataFrame:
    """What the ranges are asked: the blocks' pieces themselves, or those of cells."""
    if not p.wide:
        return asks
    per = p.ranges // p.wide

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        number, rng, batch = (k.as_py() for k in key)
        m = merged(kinds[number], asked(kinds[number], rows))
        return table(ask(kinds, number, batch, p.ranges, m.keys, m.more, m.values, rng * per, (rng + 1) * per), ASK)

    return _batched(asks, p).groupBy("kind", "rng", "batch").applyInArrow(_without_batch(merge), ASK_DDL)


def down(asks: DataFrame, told: DataFrame, kinds: dict[int, Kind], p: Plan, tell: dict[int, Tell]) -> DataFrame:
    """What the blocks are told, from what the ranges tell (all values of all keys) where they were asked by cells."""
    if not p.wide:
        return told
    per = p.ranges // p.wide

    def split(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        number, rng, _ = (k.as_py() for k in key)
        kind = kinds[number]
        if not rows.num_rows or not answers.num_rows:  # kinds that are told nothing
            return table([], ASK)
        pieces = asked(kind, rows)
        m = merged(kind, pieces)
        answers = answers.sort_by("fine").to_pylist()
        order, _ = kind.deal(m.keys, p.ranges, rng * per, (rng + 1) * per)
        totals = []
        for i in range(len(answers[0]["vals"])):
            parts = [np.frombuffer(r["vals"][i], np.float32) if kind.real else unplain(r["vals"][i], r["n"]) for r in answers]
            values = np.concatenate(parts)
            if order is not None:
                back = np.empty_like(values)
                back[order] = values
                values = back
            totals.append(values)
        return table(_told(number, rng, pieces, totals, m.place, tell[number]), ASK)

    cells = told.filter("asker >= 0").withColumn("fine", F.col("rng")).withColumn("rng", F.expr(f"rng div {per}").cast("int"))
    left = _batched(asks, p).groupBy("kind", "rng", "batch")
    blocks = left.cogroup(cells.groupBy("kind", "rng", "asker")).applyInArrow(split, ASK_DDL)
    return blocks.unionByName(told.filter("asker < 0"))


def _batched(asks: DataFrame, p: Plan) -> DataFrame:
    return asks.withColumn("batch", F.expr(f"asker div {p.batch}").cast("int"))


def _without_batch(merge: Callable) -> Callable:
    return lambda key, rows: merge(key, rows.drop_columns(["batch"]))


def exchange(asks: DataFrame, kinds: dict[int, Kind], p: Plan, tell: dict[int, Tell], summary: dict[int, Callable[[Merged], tuple | None]] | None = None) -> DataFrame:
    """Merges all pieces of each range and tells every block what the values of its keys come to.

    A kind without an entry in `tell` is told nothing.  `summary` may make one more row of each range, with asker -1.
    The asks are read twice where they go by cells, so they should be written.
    """
    direct = not p.wide

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        number, rng = (k.as_py() for k in key)
        pieces = asked(kinds[number], rows)
        m = merged(kinds[number], pieces)
        out = _told(number, rng, pieces, m.values, m.place, tell[number] if direct else tell_all) if number in tell else []
        if summary and number in summary and (row := summary[number](m)) is not None:
            out.append((number, rng, -1, *row))
        return table(out, ASK)

    told = up(asks, kinds, p).groupBy("kind", "rng").applyInArrow(answer, ASK_DDL)
    return down(asks, told, kinds, p, tell)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)
