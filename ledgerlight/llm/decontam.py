"""Benchmark decontamination: rare links as seeds, then Smith-Waterman alignment.

Texts are folded to lower-case words of letters, marks and digits of all
scripts; in scripts without blanks each letter is a word.  The score is the
best local alignment as a share of a perfect one.

What may be a leak is found by links: two words of an item that are neighbours
or have one word between them, which are so in the document too.  Of an
alignment's matched words, each two that follow one another with e errors
between them give 2 - e points besides the first word's, so 2 at most if they
are neighbours on both sides, 1 at most with one word between on either, and
else none.  A leak of an item of n words therefore has links that give
2 * leak * n - 2 points (`need`), in a stretch of at most n * (3 - 2 * leak)
words.  No rarity and no size of the corpus comes into this.

A first pass over all documents counts in how many documents each link stands.
As long as the most frequent ones give at most half of `need`, they are not
looked for: the others must give the rest.  The second pass aligns each item
with every stretch that its links allow.

Items are taken in blocks of about ITEM_BLOCK words, so what is sent to the
executors has a fixed bound and every item meets every document.

Nulls: a null text matches nothing; a null item_id is kept as such.  An item
of fewer than SHORTEST words matches where all of them stand in sequence, and
one without words matches nothing.  With `leak` below 1 / 2, an item
of at most 1 / leak words needs one link.  Items with equal
texts all match; repeated items or documents give repeated pairs only if their
ids differ.  Of equal scores the first place is reported.  Empty tables give an
empty table.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

#: Words of the shortest item that is aligned; points of a match, a mismatch and a gap (the links' bound rests on these).
SHORTEST, MATCH, MISMATCH, GAP = 3, 2, -1, -1
#: Share of a perfect score that counts as a leak.
LEAK = 0.5
ITEM_BLOCK = 1 << 18
PAIRS = "doc_id long, item_id long, score double, first_word long, end_word long"

#: Kinds of characters: between words, part of a word, a word by itself.
BETWEEN, PART, ALONE = 0, 1, 2
#: Scripts written without blanks: from, to (Thai to Myanmar, Khmer, Tai, kana, ideographs).
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point, and a 64-bit name that capitals share with their small letters."""
    kind, small = np.zeros(0x110000, np.uint8), np.arange(0x110000)
    for c in range(0x20000):  # letters, marks and digits; no script with capitals lies above
        sign = chr(c)
        if unicodedata.category(sign)[0] in "LMN":
            kind[c] = PART
            small[c] = next((ord(low) for low in (sign.casefold(), sign.lower()) if len(low) == 1), c)
    for a, b in UNSPACED:
        kind[a : b + 1][kind[a : b + 1] == PART] = ALONE
    kind[0x20000:0x40000] = ALONE
    return kind, at.fmix(small.astype(np.uint64) + at.U64(1))


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts and where each begins; bytes that are not UTF-8 become U+FFFD."""
    try:
        text = raw.tobytes().decode()
        offsets = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets]
    except UnicodeDecodeError:
        each = [raw[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, offsets = "".join(each), np.append(0, np.cumsum([len(t) for t in each]))
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), offsets


def fold_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the folded words and the first word of each text."""
    kinds, folded = characters()
    points, offsets = code_points(raw, offsets)
    kind = kinds[points]
    head, tail = kind > BETWEEN, kind > BETWEEN
    head[1:] &= (kind[:-1] != PART) | (kind[1:] == ALONE)
    cut = offsets[(offsets > 0) & (offsets < len(points))]
    head[cut] = kind[cut] > BETWEEN
    tail[:-1] &= (kind[1:] == BETWEEN) | head[1:]
    tail[cut - 1] = kind[cut - 1] > BETWEEN
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return at.word_names(folded[points], start, end), np.searchsorted(start, offsets)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two lists of word names: points, and where it begins and ends in `words`."""
    n = len(words)
    step = np.arange(n + 1) * -GAP
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for x in item:
        diagonal = row[:-1] + np.where(words == x, MATCH, MISMATCH)
        up = row + GAP
        new, begin = up.copy(), origin.copy()
        better = diagonal >= up[1:]
        new[1:][better] = diagonal[better]
        begin[1:][better] = origin[:-1][better]
        dead = new <= 0
        new[dead] = 0
        begin[dead] = np.flatnonzero(dead)
        raised = new + step
        run = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == run, np.arange(n + 1), 0))
        filled = run - step
        moved = filled > new
        new[moved] = filled[moved]
        begin[moved] = begin[source[moved]]
        row, origin = new, begin
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(origin[k]), k)
    return best


def pairs(names: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and name of every two words of one text that are `step` places apart."""
    own = at.owners(first)
    where = np.flatnonzero(own[:-step] == own[step:]) if len(own) > step else np.zeros(0, np.int64)
    return where, at.fmix(names[where] * at.U64(0x9E3779B97F4A7C15) + names[where + step])


class Items:
    """A block of items with its links, sorted by name."""

    def __init__(self, ids: list, texts: list[str], leak: float = LEAK):
        raw, offsets = at.buffers(pa.array(texts, pa.large_string()))
        names, first = fold_words(raw, offsets)
        self.ids, self.words, self.leak = ids, [names[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], leak
        self.length = np.diff(first)
        self.need = np.maximum(1.0, MATCH * leak * self.length - MATCH - 1e-9)
        own = at.owners(first)
        (at_1, name_1), (at_2, name_2) = (pairs(names, first, step) for step in (1, 2))
        name, item = np.append(name_1, name_2), np.append(own[at_1], own[at_2])
        near = np.arange(len(name)) < len(name_1)
        some = self.length[item] >= SHORTEST
        self.unique, number = np.unique(name, return_inverse=True)
        # numbers of each item's links by place, of neighbours and of those with a word between
        self.links = [np.split(n, np.cumsum(np.maximum(0, self.length - step))[:-1]) for n, step in ((number[near], 1), (number[~near], 2))]
        # for each link and item: what it can give at most where a document has neighbours, and otherwise
        key, entry = np.unique(number[some] * len(ids) + item[some], return_inverse=True)
        self.number, self.item = np.divmod(key, len(ids))
        self.most = np.bincount(entry, np.where(near[some], 2, 1), len(key)).astype(np.int64)
        self.least = np.bincount(entry, minlength=len(key))
        # items of one word and of two, matched whole: sorted names and their items
        self.whole = []
        for size, (place, name) in ((1, (np.arange(len(names)), names)), (2, (at_1, name_1))):
            mine = np.flatnonzero(self.length[own[place]] == size) if size < SHORTEST else np.zeros(0, np.int64)
            mine = mine[np.argsort(name[mine], kind="stable")]
            self.whole.append((name[mine], own[place[mine]]))
        self.marks = np.zeros(1 << 22, bool)
        self.marks[(self.unique >> np.uint64(42)).astype(np.int64)] = True
        self.weigh({})

    def weigh(self, found: dict[int, int]) -> None:
        """found: documents that hold each link.  An item's most frequent links, with up to half of what it needs, need not be looked for."""
        n = np.zeros(len(self.unique), np.int64)
        n[list(found.keys())] = list(found.values())
        order = np.lexsort((self.number, -n[self.number], self.item))
        item, most = self.item[order], self.most[order]
        run = np.append(0, np.cumsum(most))
        before = run[np.searchsorted(item, item)]
        left_out = run[1:] - before <= self.need[item] / 2
        spared = np.bincount(item[left_out], most[left_out], len(self.ids))
        self.open = self.need - spared
        self.sought = np.sort(order[~left_out])
        self.low, self.high = (np.searchsorted(self.number[self.sought], np.arange(len(self.unique)), side) for side in ("left", "right"))

    def hits(self, names: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and link number of every pair of the texts that is a link."""
        where, name = pairs(names, first, step)
        some = np.flatnonzero(self.marks[(name >> np.uint64(42)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.unique, name[some]), len(self.unique) - 1)
        real = self.unique[number] == name[some]
        return where[some][real], number[real]

    def candidates(self, texts: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) whose sought links, each counted once in a text, may be enough."""
        near = np.unique(texts[0] * len(self.unique) + numbers[0])
        far = np.setdiff1d(texts[1] * len(self.unique) + numbers[1], near)
        key = np.append(near, far)
        text, number = np.divmod(key, len(self.unique))
        count = (self.high - self.low)[number]
        entry = self.sought[at.ranges(self.low[number], count)]
        gives = np.where(np.repeat(np.arange(len(key)) < len(near), count), self.most[entry], self.least[entry])
        pair, of = np.unique(np.repeat(text, count) * len(self.ids) + self.item[entry], return_inverse=True)
        text, item = np.divmod(pair, len(self.ids))
        enough = np.bincount(of, gives, len(pair)) >= self.open[item]
        return text[enough], item[enough]

    def copies(self, names: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """As leaks(), of the items of fewer than SHORTEST words."""
        for size, (known, item) in enumerate(self.whole, 1):
            if not len(known):
                continue
            where, name = (np.arange(len(names)), names) if size == 1 else pairs(names, first, 1)
            low = np.searchsorted(known, name)
            count = np.searchsorted(known, name, "right") - low
            where, entry = np.repeat(where, count), at.ranges(low, count)
            text = np.searchsorted(first, where, "right") - 1
            _, once = np.unique(text * len(self.ids) + item[entry], return_index=True)
            for k in once:
                t, x = int(text[k]), int(where[k] - first[text[k]])
                yield t, int(item[entry[k]]), 1.0, x, x + size

    def leaks(self, names: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end word) of the best alignment of each pair."""
        if not len(names):
            return
        yield from self.copies(names, first)
        if not len(self.unique):
            return
        (where_1, number_1), (where_2, number_2) = hits = [self.hits(names, first, step) for step in (1, 2)]
        owners = [np.searchsorted(first, where, "right") - 1 for where, _ in hits]
        near, far = np.zeros((2, len(self.unique)), np.int64)
        for t, i in zip(*self.candidates(owners, [number_1, number_2]), strict=True):
            n, begin, size = int(self.length[i]), int(first[t]), int(first[t + 1] - first[t])
            link_1, link_2 = self.links[0][i], self.links[1][i]
            (a_1, b_1), (a_2, b_2) = (np.searchsorted(where, [first[t], first[t + 1]]) for where, _ in hits)
            place_1, link_at_1 = where_1[a_1:b_1] - begin, number_1[a_1:b_1]
            place_2, link_at_2 = where_2[a_2:b_2] - begin, number_2[a_2:b_2]
            near[link_2] = far[link_2] = far[link_1] = 1
            near[link_1] = 2
            gives = np.zeros(size, np.int64)
            gives[place_1] = near[link_at_1]
            gives[place_2] = np.maximum(gives[place_2], far[link_at_2])
            near[link_1] = near[link_2] = far[link_1] = far[link_2] = 0
            # a leak stands in `span` words
            span = int(n + MATCH * n * (1 - self.leak)) + 1
            run = np.append(0, np.cumsum(gives))
            place = np.flatnonzero(gives)
            place = place[run[np.minimum(place + span, size)] - run[place] >= self.need[i]]
            best = (0.0, 0, 0)
            for part in np.split(place, np.flatnonzero(np.diff(place) > 2 * span) + 1) if len(place) else ():
                a, b = max(0, int(part[0]) - span), min(size, int(part[-1]) + span)
                # and each place of the item gives once
                near[link_at_2[(place_2 >= a) & (place_2 < b)]] = far[link_at_2[(place_2 >= a) & (place_2 < b)]] = 1
                near[link_at_1[(place_1 >= a) & (place_1 < b)]] = 2
                far[link_at_1[(place_1 >= a) & (place_1 < b)]] = 1
                total = near[link_1]
                total[: len(link_2)] = np.maximum(total[: len(link_2)], far[link_2])
                near[link_at_1] = near[link_at_2] = far[link_at_1] = far[link_at_2] = 0
                if total.sum() < self.need[i]:
                    continue
                points, x, y = align(self.words[i], names[begin + a : begin + b])
                if points / (MATCH * n) > best[0]:
                    best = (points / (MATCH * n), a + x, a + y)
            if best[0] >= self.leak:
                yield int(t), int(i), *best


def blocks(benchmark: DataFrame, leak: float = LEAK) -> Iterator[Items]:
    """Items in order of id, at most about ITEM_BLOCK words at once; they reach the driver row by row."""
    ids, texts, size = [], [], 0
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        n = int(fold_words(*at.buffers(pa.array([row["text"]], pa.large_string())))[1][-1])
        if ids and size + n > ITEM_BLOCK:
            yield Items(ids, texts, leak)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield Items(ids, texts, leak)


def _block_pairs(spark: SparkSession, docs: DataFrame, items: Items) -> DataFrame:
    counting = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counting.value
        total = np.zeros(len(held.unique), np.int64)
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                names, first = fold_words(raw, offsets)
                where, number = (np.concatenate(x) for x in zip(*(held.hits(names, first, step) for step in (1, 2)), strict=True))
                text = np.searchsorted(first, where, "right") - 1
                total += np.bincount(np.unique(text * len(total) + number) % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["link", "n"])

    found = dict(docs.select("text").mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
    items.weigh(found)
    aligned = spark.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = aligned.value
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                names, first = fold_words(raw, offsets)
                found = list(held.leaks(names, first))
                if found:
                    text, item, score, x, y = zip(*found, strict=True)
                    doc = batch.column("doc_id").slice(row, end - row).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([held.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "item_id", "score", "first_word", "end_word"])

    return docs.mapInArrow(search, PAIRS)


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, leak: float = LEAK) -> DataFrame:
    """Every (doc_id, item_id) whose alignment scores at least `leak`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    out = None
    for items in blocks(benchmark, leak):
        if items.length.any():
            found = _block_pairs(spark, texts, items)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], PAIRS)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "end_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.score").alias("score"), (-F.col("b.back")).alias("first_word"), F.col("b.end_word").alias("end_word"))
