"""Removal of repeated passages by recompression.

Words are symbols.  In each round runs of equal symbols get a name, then every
symbol is a left or a right one by a hash bit and each left symbol joins a
following right symbol in a named pair.  A name is a hash of what it stands for,
so equal substrings get equal symbols except at their ends, where a symbol might
have joined what stands outside.  Per window of WINDOW words those ends are
taken off round by round; what remains, the interior symbols, and what was taken
off depend on the window's words alone, and together they spell the window.

First exchange: ranges of the name space see the names of all words, runs and
pairs of all documents, each with a check of what it stands for.  A name that
stands for two things is told back, and the rounds are repeated with such names
mixed anew, until every name of every round stands for one thing in all
documents (about n * n / 2**65 names clash among n).  The same exchange tells
which interiors stand in more than one document.  Second exchange: of the
windows around shared interiors, the smallest document that holds each; windows
are compared by their symbols, 96 bits of the interior and of each round's ends.
Then each word covered by a window that also starts in a document with a smaller
id goes.

Null text has no words.  A null doc_id counts as the largest; rows that repeat
a doc_id are one document for the comparison and return a row each.  An empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrowtext as at
from . import blocks as bl
from .shared import written

WINDOW, ROUNDS = 13, 2
#: Bytes of text that are recompressed at once.
PART = 1 << 18
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_U = np.uint64
#: Places in a block: what one Arrow column of text can hold.
_I = np.int32
_NONE = np.zeros(0, _U)
#: Names with a check each; interiors; windows with the smallest and the largest document that holds each.
NAMES, INTERIORS, WINDOWS = 0, 1, 2
KINDS = {NAMES: bl.Kind(more=True), INTERIORS: bl.Kind(shift=24, reduce=("sum",)), WINDOWS: bl.Kind(more=True, reduce=("min", "max"), delta=True)}
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


class Names:
    """Names given so far in a block, each with a check of what it stands for; clashing names are mixed with the check."""

    def __init__(self, clashes: np.ndarray, bits: int = 64):
        self.clashes, self.drop, self.names, self.checks = clashes, _U(64 - bits), [], []

    def given(self, names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        names, checks = names >> self.drop << self.drop, checks >> _U(32)
        if len(self.clashes):
            again = self.clashes[np.minimum(np.searchsorted(self.clashes, names), len(self.clashes) - 1)] == names
            names = np.where(again, at.fmix(names + at.fmix(checks + _U(1))), names)
        self.names.append(names)
        self.checks.append(checks)
        return names


class Level:
    """The symbols after some rounds.

    `begin` has the old index at which each symbol begins; `right[i]` is the first symbol that is the same whatever
    stands before old symbol i, `left[i]` ends the symbols that are the same whatever follows old symbol i - 1.
    """

    def __init__(self, names, own, begin=None, right=None, left=None):
        self.names, self.own, self.begin, self.right, self.left = names, own, begin, right, left

    def next(self, number: int, book: Names) -> Level:
        """One round."""
        names, own, n = self.names, self.own, len(self.names)
        seed = _U(0xA5A5_0000 + number)
        same = np.zeros(n + 1, bool)
        same[1:n] = (names[1:] == names[:-1]) & (own[1:] == own[:-1])
        head = np.flatnonzero(~same[:n]).astype(_I)
        length = np.diff(np.append(head, n))
        run = names[head].copy()
        long = length > 1
        times = length[long].astype(_U)
        run[long] = book.given(at.fmix(run[long] * _U(0x9E3779B97F4A7C15) + times + seed), at.fmix(at.fmix(run[long] ^ seed) + times))
        run_own = own[head]
        run_of = np.cumsum(~same[:n], dtype=_I) - _I(1)
        # a run at the end of a substring may go on outside it
        right = np.append(run_of + _I(1), _I(len(run)))
        left = np.append(_I(0), run_of)
        side = (at.fmix(run ^ (seed << _U(32))) & _U(1)).astype(bool)  # True: a right symbol
        joins = np.zeros(len(run), bool)
        joins[:-1] = ~side[:-1] & side[1:] & (run_own[1:] == run_own[:-1])
        second = np.zeros(len(run) + 1, bool)
        second[1:] = joins
        symbol = run.copy()
        a = np.flatnonzero(joins)
        x, y = run[a], run[a + 1]
        symbol[a] = book.given(at.fmix(at.fmix(x + seed) * _U(3) + y), at.fmix((x ^ seed) * _U(0xC2B2AE3D27D4EB4F) + at.fmix(y - seed)))
        keep = ~second[: len(run)]
        index = np.append(np.cumsum(keep, dtype=_I) - keep, keep.sum(dtype=_I))  # the new index at which an old one begins
        # a right symbol at the beginning, a left one at the end may have joined a neighbour outside
        wide = np.append(side, False)
        right = right + wide[right]
        before = np.maximum(left - 1, 0)
        left = left - ((left > 0) & ~side[before]) if len(side) else left
        return Level(symbol[keep], run_own[keep], np.append(head[keep], _I(n)), index[np.minimum(right, _I(len(run)))], index[left])


class Part:
    """The words, windows and recompressed symbols of some whole documents, about PART bytes of text or one longer document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, book: Names, checked: bool):
        self.raw, self.ids = raw, ids
        start, end, self.first = at.words(raw, offsets)
        names = at.word_names(raw, start, end)
        if checked or len(book.clashes):  # else the words' names are as they were
            names = book.given(names, at.word_names(raw, start, end, at.HASH_B))
        self.start, self.end = start.astype(_I), end.astype(_I)
        own = at.owners(self.first).astype(_I)
        n = len(own) - WINDOW + 1
        self.at = np.flatnonzero(own[: max(0, n)] == own[WINDOW - 1 :]).astype(_I) if n > 0 else np.zeros(0, _I)
        self.doc = ids[own[self.at]]
        self.levels = [Level(names, own)]
        for r in range(ROUNDS if len(names) else 0):
            self.levels.append(self.levels[-1].next(r, book))

    def interiors(self) -> np.ndarray:
        """A name for what recompression leaves of each window, from the deepest round that leaves anything."""
        family, start = at.HASH_A, self.at
        first, last = start, start + WINDOW
        key = family.slices(family.prefix(self.levels[0].names), first, last)
        for r, level in enumerate(self.levels[1:], 1):
            first, last = level.right[first], level.left[last]
            some = first < last
            key = np.where(some, at.fmix(family.slices(family.prefix(level.names), np.where(some, first, 0), np.where(some, last, 0)) + _U(r)), key)
            last = np.maximum(first, last)
        return key

    def spelled(self, some: np.ndarray, family: at.Rolling = at.HASH_A) -> np.ndarray:
        """64 bits of each chosen window's symbols: its ends of each round, then its last interior."""
        first, last = self.at[some], self.at[some] + WINDOW
        out = np.zeros(len(first), _U)
        for r in range(len(self.levels)):
            sums, above = family.prefix(self.levels[r].names), self.levels[r + 1] if r + 1 < len(self.levels) else None
            if above is None:
                ends = family.slices(sums, first, last)
            else:
                inner_first, inner_last = above.right[first], above.left[last]
                gone = inner_first >= inner_last  # nothing is left: the ends are all there is
                a, b = np.where(gone, last, above.begin[inner_first]), np.where(gone, last, above.begin[inner_last])
                ends = family.slices(sums, first, a) * _U(3) + family.slices(sums, b, last)
                first, last = np.where(gone, 0, inner_first), np.where(gone, 0, inner_last)
            out = at.fmix(out * _U(0x9E3779B97F4A7C15) + ends)
        return out


    def kept(self, gone: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """For each document its words, how many of them the windows `gone` cover, and the digest of the others."""
        covered = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(covered, self.at[gone], 1)
        np.add.at(covered, self.at[gone] + WINDOW, -1)
        word = np.flatnonzero(np.cumsum(covered)[:-1] == 0)
        bounds = np.searchsorted(word, self.first)
        for i in range(len(self.ids)):
            w = word[bounds[i] : bounds[i + 1]]
            size = (self.end[w] - self.start[w]).astype(np.int64) + 1
            text = self.raw[np.minimum(at.ranges(self.start[w], size), max(0, len(self.raw) - 1))]
            text[np.cumsum(size) - 1] = 32
            n = int(self.first[i + 1] - self.first[i])
            yield n, n - len(w), hashlib.sha256(text[:-1]).hexdigest()


def parts(table: pa.Table, clashes: np.ndarray, bits: int, checked: bool = False) -> Iterator[tuple[Part, Names]]:
    """A block's documents by identifier, part by part, with the names that each part gave."""
    table = bl.in_order(table.select(["doc_id", "text"]))
    ids = bl.doc_ids(table.column("doc_id"))
    for row, end, raw, offsets in at.pieces(table.column("text"), PART):
        book = Names(clashes, bits)
        yield Part(raw, offsets, ids[row:end], book, checked), book


def distinct(names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names with their checks; a name with several checks stands once for each."""
    order = np.lexsort((checks, names))
    names, checks = names[order], checks[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])
    return names[new], checks[new]


def _asked(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 40-bit keys in order, which stand in two documents of the block, and the key number of each window."""
    short = keys & ~_U((1 << 24) - 1)
    order = np.argsort(short, kind="stable")
    begin = bl.firsts(short[order])
    if not len(begin):
        return short, np.zeros(0, bool), np.zeros(0, np.int64)
    number = np.empty(len(order), np.int64)
    size = np.diff(np.append(begin, len(order)))
    number[order] = np.repeat(np.arange(len(begin)), size)
    d = doc[order]
    return short[order][begin], np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin), number


def _covering(part: Part, one: np.ndarray, two: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The part's windows that stand in a smaller document; (one, two) are sorted windows and `least` who holds each first."""
    if not len(one) or not len(part.at):
        return np.zeros(0, np.int64)
    a = part.spelled(np.arange(len(part.at)))
    place = np.searchsorted(one, a)
    hit = np.flatnonzero(one[np.minimum(place, len(one) - 1)] == a)
    place, m, gone = place[hit], part.spelled(hit, at.HASH_B) >> _U(32), np.zeros(len(hit), bool)
    # keys of which the first part is the same stand side by side
    left = np.arange(len(hit))
    while len(left):
        p = place[left]
        gone[left] |= (two[p] == m[left]) & (least[p] < part.doc[hit[left]])
        place[left] += 1
        left = left[place[left] < len(one)]
        left = left[one[place[left]] == a[hit[left]]]
    return hit[gone]


def ask_blocks(docs: DataFrame, p: bl.Plan, clashes: np.ndarray, bits: int) -> DataFrame:
    """What blocks ask: each range of names, and each range of interiors."""
    sent = docs.sparkSession.sparkContext.broadcast(clashes)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        names, keys, doc = [(_NONE, _NONE)], [_NONE], [np.zeros(0, np.int64)]
        for part, book in parts(table, sent.value, bits, checked=True):
            names.append(distinct(np.concatenate(book.names), np.concatenate(book.checks)))
            keys.append(part.interiors())
            doc.append(part.doc)
        block = key[0].as_py()
        rows = bl.ask(KINDS, NAMES, block, p.first, *distinct(*map(np.concatenate, zip(*names, strict=True))))
        del names
        keys, _, _ = _asked(np.concatenate(keys), np.concatenate(doc))
        return bl.table(rows + bl.ask(KINDS, INTERIORS, block, p.first, keys), bl.ASK)

    return bl.blocked(docs, p.blocks).groupBy("block").applyInArrow(ask, bl.ASK_DDL)


def clashing(names: bl.Merged) -> tuple | None:
    """Names that stand for more than one thing: they stand there once for each check."""
    twice = np.unique(names.keys[1:][names.keys[1:] == names.keys[:-1]])
    return (len(twice), twice.tobytes(), b"", []) if len(twice) else None


def tell_shared(piece: bl.Piece, blocks: list[np.ndarray]) -> tuple:
    """Which interiors stand in another block, too."""
    return len(piece.keys), np.packbits(blocks[0] > piece.values[0]).tobytes(), b"", []


def tell_smaller(piece: bl.Piece, of: list[np.ndarray]) -> tuple | None:
    """The windows that stand in a smaller document than the largest of the block that holds them."""
    least, most = of[0].view(np.int64), piece.values[1].view(np.int64)
    need = np.flatnonzero(least < most)
    return (len(need), bl.packed(piece.keys[need]), bl.plain(piece.more[need]), [bl.plain(of[0][need])]) if len(need) else None


def remove_repeats(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; names have so many bits at first."""
    p = bl.plan(bl.block_count(docs))
    by_block = bl.blocked(docs, p.blocks).groupBy("block")
    clashes = np.zeros(0, _U)
    while True:
        asks = ask_blocks(docs, p, clashes, bits)
        told = written(bl.exchange(written(asks) if p.wide else asks, KINDS, p, {INTERIORS: tell_shared}, {NAMES: clashing}))
        # the few names of 64 bits that clash, none below some billions
        more = [np.frombuffer(bytes(r["keys"]), _U) for r in told.filter(f"kind = {NAMES}").select("keys").collect()]
        if not more:
            break
        clashes = np.unique(np.concatenate([clashes, *more]))
    held = told.filter(f"kind = {INTERIORS}")
    sent = docs.sparkSession.sparkContext.broadcast(clashes)

    def compare(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        mine = [part for part, _ in parts(table, sent.value, bits)]
        keys, several, number = _asked(np.concatenate([_NONE, *(m.interiors() for m in mine)]), np.concatenate([np.zeros(0, np.int64), *(m.doc for m in mine)]))
        told = told.sort_by("rng")
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(told.column("keys").to_pylist(), told.column("n").to_pylist(), strict=True)]
        held = (np.concatenate([np.zeros(0, bool), *flags]) | several)[number]
        found, i = [(_NONE, _NONE, np.zeros(0, np.int64))], 0
        for m in mine:
            some = np.flatnonzero(held[i : i + len(m.at)])
            i += len(m.at)
            found.append((m.spelled(some), m.spelled(some, at.HASH_B) >> _U(32), m.doc[some]))
        one, two, doc = map(np.concatenate, zip(*found, strict=True))
        del mine, found
        order = np.lexsort((two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        begin = np.flatnonzero(new)
        if not len(begin):
            return bl.table([], bl.ASK)
        least, most = (f.reduceat(doc, begin).view(_U) for f in (np.minimum, np.maximum))
        return bl.table(bl.ask(KINDS, WINDOWS, key[0].as_py(), p.first, one[begin], two[begin], [least, most]), bl.ASK)

    def keep(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("rng")
        sizes = told.column("n").to_pylist()
        read = lambda c, f: np.concatenate([_NONE, *(f(x, n) for x, n in zip(told.column(c).to_pylist(), sizes, strict=True))])
        least = np.concatenate([_NONE, *(bl.unplain(v[0], n) for v, n in zip(told.column("vals").to_pylist(), sizes, strict=True))]).view(np.int64)
        one, two = read("keys", bl.unpacked), read("more", bl.unplain)
        ids, rows = [np.zeros(0, np.int64)], []
        for part, _ in parts(table, sent.value, bits):
            ids.append(part.ids)
            rows += part.kept(_covering(part, one, two, least))
        n_words, n_removed, digests = zip(*rows, strict=True)
        return pa.Table.from_arrays([bl.restored(np.concatenate(ids)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], schema=_OUT)

    compared = by_block.cogroup(held.groupBy("asker")).applyInArrow(compare, bl.ASK_DDL)
    decided = bl.exchange(written(compared) if p.wide else compared, KINDS, p, {WINDOWS: tell_smaller})
    return by_block.cogroup(decided.groupBy("asker")).applyInArrow(keep, RESULT)
