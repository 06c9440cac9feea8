"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation.  Every code point gets a class (letter, number, white space,
other).  At each code point the token automaton has a transition function that
either resets the state to "a run began here" or leaves it alone.  Such
functions are closed under composition and composition is associative, so the
state before every code point is one prefix scan (a running maximum over the
reset positions); boundaries then follow from the state and its neighbours.  No
regular expression runs.

Merging.  Distinct slices of a batch are merged together, one lowest-ranked
leftmost pair for each slice and round, and kept in a bounded cache.  Byte
offsets of the tokens are kept, so decoding needs no search.

Null text counts as empty and has no tokens.  Rows are independent: ties,
repeated rows and extra columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

LETTER, NUMBER, SPACE, OTHER = range(4)
NONE = np.int32(2**31 - 1)
#: Slices up to this length are merged side by side, longer ones with a heap.
SIDE_BY_SIDE = 32
CACHE_SLICES = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def class_table() -> np.ndarray:
    """A class for every code point; white space is Unicode's White_Space property."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
        elif kind == "Z":
            table[c] = SPACE
    table[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85]] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions at which a slice begins; first: the first code point of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = table[points]
    opens = np.zeros(n + 1, bool)
    opens[first[first < n]] = True
    opens[n] = True
    reset = opens[:n].copy()
    reset[1:] |= kind[1:] != kind[:-1]
    here = np.arange(n)
    run = np.maximum.accumulate(np.where(reset, here, 0))  # the scan: where the current run began
    ends = np.append(reset[1:], True)
    blank, space = points == 32, kind == SPACE
    after = np.append(~space[1:], False) & ~opens[1:]  # followed by something solid in the same text
    cut = reset.copy()
    # the last white space before a solid run stands for itself, or, if it is a blank, leads that run
    cut |= space & ends & after
    led = np.zeros(n, bool)
    led[1:] = reset[1:] & ~space[1:] & blank[:-1] & ~opens[1:n]
    cut &= ~led
    # an apostrophe alone between runs takes one of seven endings with it
    lone = np.flatnonzero((points == 39) & (run == here) & ends & ~led & ~opens[1:])
    lone = lone[(lone + 1 < n)]
    if len(lone):
        one = points[lone + 1]
        two = np.where(lone + 2 < n, points[np.minimum(lone + 2, n - 1)], 0)
        two = np.where(opens[np.minimum(lone + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[lone[short | long] + 1] = False
        past = np.concatenate([lone[short] + 2, lone[long] + 3])
        cut[past[past < n]] = True
    return np.flatnonzero(cut)


class Codec:
    """Ranks, pair table and the cache of merged slices."""

    def __init__(self, content: bytes):
        ranks = {}
        for line in content.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        key, value = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    key.append(a << 32 | b)
                    value.append(rank)
        order = np.argsort(np.array(key, np.int64))
        self.keys, self.values = np.array(key, np.int64)[order], np.array(value, np.int32)[order]
        self.table = class_table()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = self.known_n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.values[i], NONE)

    def merge_many(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Ids of slices of at most SIDE_BY_SIDE bytes: each round merges one pair of every slice."""
        out: list = [None] * len(start)
        wide = int(size.max())
        column = np.arange(wide)
        inside = column < size[:, None]
        seq = np.where(inside, self.single[raw[np.minimum(start[:, None] + column, len(raw) - 1)]], -1).astype(np.int32)
        rank = np.full((len(start), wide), NONE, np.int32)
        if wide > 1:
            rank[:, :-1] = self.pair_ranks(seq[:, :-1], seq[:, 1:])
        row = np.arange(len(start))
        while len(row):
            best = rank.argmin(1)
            each = np.arange(len(row))
            least = rank[each, best]
            over = least == NONE
            if over.any():
                ended = seq[over]
                full = (ended >= 0).sum(1)
                for r, ids, n in zip(row[over].tolist(), ended, full.tolist(), strict=True):
                    out[r] = ids[:n]
                keep = ~over
                row, seq, rank, best, least = row[keep], seq[keep], rank[keep], best[keep], least[keep]
                each = np.arange(len(row))
                if not len(row):
                    break
            seq[each, best] = least
            mask = np.ones(seq.shape, bool)
            mask[each, best + 1] = False
            seq = seq[mask].reshape(len(row), -1)
            rank = rank[mask].reshape(len(row), -1)
            w = seq.shape[1]
            right = np.where(best + 1 < w, seq[each, np.minimum(best + 1, w - 1)], -1)
            rank[each, best] = self.pair_ranks(least, right)
            left = best > 0
            e, b = each[left], best[left]
            rank[e, b - 1] = self.pair_ranks(seq[e, b - 1], least[left])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one slice of any length, with a heap of pairs."""
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = [1] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := self.ranks.get(piece[i : j + size[j]])) is not None:
                heapq.heappush(heap, (r, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if size[i] else n
            if size[i] != a or j >= n or size[j] != b:
                continue
            ids[i], size[i], size[j] = r, a + b, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([ids[i] for i in range(n) if size[i]], np.int32)

    def learn(self, raw: np.ndarray, name: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        found: list = [None] * len(name)
        for low, high in ((0, 8), (8, 16), (16, SIDE_BY_SIDE)):
            some = np.flatnonzero((size > low) & (size <= high))
            for k in range(0, len(some), 1 << 16):
                part = some[k : k + (1 << 16)]
                for i, ids in zip(part.tolist(), self.merge_many(raw, start[part], size[part]), strict=True):
                    found[i] = ids
        for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
            found[i] = self.merge_long(raw[start[i] : start[i] + size[i]].tobytes())
        n = np.array([len(x) for x in found], np.int64)
        begin = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, *found])
        place = np.searchsorted(self.known, name)
        self.known = np.insert(self.known, place, name)
        self.known_at = np.insert(self.known_at, place, begin)
        self.known_n = np.insert(self.known_n, place, n)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the first id of each text (n + 1), and the byte offset of each id."""
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            first, byte_at = offsets, None
        else:
            byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            first = np.searchsorted(byte_at, offsets)
        cut = boundaries(points, first, self.table)
        if not len(cut):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        start = cut if byte_at is None else byte_at[cut]
        end = np.append(start[1:], len(raw))
        name = at.word_names(raw, start, end)
        unique, index, inverse = np.unique(name, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_SLICES:
            self.forget()
        place = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[place] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            self.learn(raw, unique[new], start[index[new]], (end - start)[index[new]])
        place = np.searchsorted(self.known, unique)
        count = self.known_n[place][inverse]
        ids = self.ids[at.ranges(self.known_at[place][inverse], count)]
        slots = np.append(0, np.cumsum(count))
        byte_end = np.cumsum(self.lengths[ids])
        return ids, slots[np.searchsorted(start, offsets)], byte_end - self.lengths[ids]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[at.ranges(self.starts[ids], self.lengths[ids])]

    def checked(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """encode() and decode(); if two slices ever share a name, the texts are merged anew without it."""
        ids, first, _ = self.encode(raw, offsets)
        out = self.decode(ids)
        if len(out) != len(raw) or not np.array_equal(out, raw):
            self.forget()
            parts = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b]
                points = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
                byte_at = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
                cut = byte_at[boundaries(points, np.zeros(1, np.int64), self.table)]
                parts.append(np.concatenate([np.zeros(0, np.int32), *(self.merge_long(text[x:y].tobytes()) for x, y in zip(cut, np.append(cut[1:], len(text)), strict=True))]))
            ids, first = np.concatenate([np.zeros(0, np.int32), *parts]), np.append(0, np.cumsum([len(p) for p in parts]))
            out = self.decode(ids)
        return ids, first, out


_CODECS: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    """One codec for each worker and rank file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def rank_file(path: str | None = None) -> bytes:
    """Read on the driver and sent along; about 1 MB, fixed by the vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def digests(spark: SparkSession, docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, and the ids if they are asked for."""
    ranks = spark.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                ids, first, out = c.checked(raw, offsets)
                little = ids.astype("<u4")
                columns = [
                    batch.column("doc_id").slice(row, end - row),
                    pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the byte offset at which each token begins."""
    ranks = spark.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                ids, first, _ = c.checked(raw, offsets)
                begin = np.cumsum(c.lengths[ids]) - c.lengths[ids] - np.repeat(offsets[:-1], np.diff(first))
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, begin)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), *lists], ["doc_id", "ids", "token_starts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, token_starts array<int>")


def decode(spark: SparkSession, encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of `ids`; null ids give an empty text, bytes that are no UTF-8 are replaced."""
    ranks = spark.sparkContext.broadcast(rank_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for batch in batches:
            texts = [c.decode(np.asarray(x.as_py() or [], np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


assert sys.byteorder == "little"
