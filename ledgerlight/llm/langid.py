"""Language identification with bit-sliced Bloom filters of byte n-grams.

One slot array serves each WORD languages: bit l of a slot belongs to the filter
of the array's language l, so k lookups and an AND give every language of the
array whose texts held an n-gram.  Any number of languages may be taught; each
WORD of them take SLOTS * 8 bytes more.
A text's n-grams are counted for each language, the expected number of false
positives, known from how full each filter is, is taken out, and the largest
remainder decides.  The score is its share of all remainders.

Every labelled text teaches, and those held out are all counted for the threshold
of rejection; nothing is sampled.  A filter holds the n-grams that stand in one of
FEW of its language's texts at least, by exact counts: up to 2 * FEW texts that is
every n-gram, and filters don't fill up as texts are added.

Nulls: a null text, or one without a letter, is `und` with score 0.  Rows
without language or text teach nothing; a null doc_id is not held out and
teaches.  Equal scores go to the language that sorts first.  With no labelled
row at all every text is `und`.  Repeated rows teach as often as they stand there;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

#: n-gram length in bytes, slots of the filter, lookups for each n-gram.
GRAM, SLOTS, LOOKUPS = 5, 1 << 21, 3
#: A language holds an n-gram that one of so many of its texts has. n-grams whose counts a task keeps at once.
FEW, HELD = 1500, 1 << 19
#: Languages of one slot array: the bits of a non-negative long.
WORD = 63
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_SEEDS = at.splitmix(LOOKUPS, 0x1A46)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of folded texts (anything but letters is a blank) and the text of each.

    Each text is read with a blank before and GRAM - 1 blanks behind it; n-grams of blanks alone are left out.
    """
    n = len(offsets) - 1
    size = np.diff(offsets) + GRAM
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), 32, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(begin + 1 - offsets[:-1], np.diff(offsets))] = _FOLD[raw]
    code = np.zeros(max(0, len(padded) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        code = code << np.uint64(8) | padded[i : len(code) + i]
    keep = code != np.uint64(int.from_bytes(b" " * GRAM))
    keep[begin[1:, None] - 1 - np.arange(GRAM - 1)] = False  # those that reach into the next text
    own = np.repeat(np.arange(n), size)[: len(code)]
    return code[keep], own[keep]


def slots(code: np.ndarray) -> list[np.ndarray]:
    return [(at.fmix(code + s) >> np.uint64(20)).astype(np.int64) & (SLOTS - 1) for s in _SEEDS]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n[order], begin) if len(key) else n


def _texts_by_gram(texts: DataFrame) -> DataFrame:
    """In how many of a language's texts each n-gram stands: l, code, n, a row for each n-gram of a task's texts."""

    def told(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((key >> np.uint64(40)).astype(np.int32)), pa.array((key & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(n)], ["l", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            l_of = batch.column("l").to_numpy().astype(np.uint64)
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                code, own = grams(raw, offsets)
                once = np.unique(code << np.uint64(24) | own.astype(np.uint64))  # of each text
                del code, own
                which = l_of[row:end][(once & np.uint64(0xFFFFFF)).astype(np.int64)]
                new.append(np.unique(which << np.uint64(40) | once >> np.uint64(24), return_counts=True))
                if sum(len(k) for k, _ in new) > HELD:
                    key, n = _summed(np.concatenate([key, *(k for k, _ in new)]), np.concatenate([n, *(m for _, m in new)]))
                    new = []
                    if len(key) > 8 * HELD:
                        yield told(key, n)
                        key, n = key[:0], n[:0]
        yield told(*_summed(np.concatenate([key, *(k for k, _ in new)]), np.concatenate([n, *(m for _, m in new)])))

    return texts.mapInArrow(run, "l int, code long, n long")


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, slot arrays and false positive rate of each language's filter, from all labelled texts.

    Comes to the driver: a row for each language and at most SLOTS slots for each WORD languages.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    arrays = max(1, -(-len(languages) // WORD))
    filters = np.zeros((arrays, SLOTS), np.uint64)
    if not languages:
        return languages, filters, np.zeros(0)
    taught = F.broadcast(spark.createDataFrame([(name, i, max(1, sizes[name] // FEW)) for i, name in enumerate(languages)], "lang string, l int, least long"))
    counted = _texts_by_gram(labelled.join(taught, "lang").select("l", "text")).groupBy("l", "code").agg(F.sum("n").alias("n"))
    own = counted.join(taught, "l").filter("n >= least").select("l", "code")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots of n-grams, with the bits of their languages."""
        for batch in batches:
            l = np.tile(batch.column("l").to_numpy().astype(np.int64), LOOKUPS)
            where = l // WORD << 32 | np.concatenate(slots(batch.column("code").to_numpy().astype(np.uint64)))
            order = np.argsort(where)
            where, bit = where[order], (np.uint64(1) << (l % WORD).astype(np.uint64))[order]
            begin = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
            mask = np.bitwise_or.reduceat(bit, begin) if len(where) else bit
            yield pa.RecordBatch.from_arrays([pa.array(where[begin] & 0xFFFFFFFF), pa.array(where[begin] >> 32), pa.array(mask.astype(np.int64))], ["slot", "array", "mask"])

    placed = own.mapInArrow(place, "slot long, array long, mask long").groupBy("slot", "array").agg(F.bit_or("mask").alias("mask")).toArrow()
    filters[placed.column("array").to_numpy(), placed.column("slot").to_numpy()] = placed.column("mask").to_numpy().astype(np.uint64)
    full = np.array([np.mean(filters[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) for i in range(len(languages))])
    return languages, filters, full**LOOKUPS


def decide(raw: np.ndarray, offsets: np.ndarray, filters: np.ndarray, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score, and the share of its n-grams that the language holds, of each text."""
    n, languages = len(offsets) - 1, len(wrong)
    code, own = grams(raw, offsets)
    first, second, third = slots(code)
    masks = [f[first] & f[second] & f[third] for f in filters]
    bounds = np.searchsorted(own, np.arange(n + 1))
    total = np.diff(bounds)
    hits = np.empty((languages, n))
    for i in range(languages):
        run = np.append(0, np.cumsum(masks[i // WORD] >> np.uint64(i % WORD) & np.uint64(1), dtype=np.int64))
        hits[i] = run[bounds[1:]] - run[bounds[:-1]]
    right = np.maximum(0, (hits - total * wrong[:, None]) / (1 - np.minimum(wrong, 0.999))[:, None])
    best = right.argmax(0)
    most, everything = right[best, np.arange(n)], right.sum(0)
    return best, np.where(everything > 0, most / np.maximum(everything, 1e-300), 0.0), most / np.maximum(total, 1)


def predict(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    languages, filters, wrong = model
    shared = spark.sparkContext.broadcast((filters, wrong))  # SLOTS * 8 bytes for each WORD languages
    names = np.array([*languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_array, rate = shared.value
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                known = batch.column("letters").slice(row, end - row).to_numpy(zero_copy_only=False) & bool(len(rate))
                best, score, _ = decide(raw, offsets, slot_array, rate) if len(rate) else (np.zeros(end - row, np.int64), np.zeros(end - row), None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), pa.array(names[np.where(known, best, len(languages))], pa.string()), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out, then predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(spark, docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A text is rejected whose winning language holds less than this part of what it holds of nearly all labelled texts
#: that it wasn't taught; of those, all but so many in a thousand count as nearly all.
REJECT_SHARE, STRAY = 0.5, 5
#: Steps in which the share that a language holds is counted for the threshold.
STEPS = 100_000


def floor(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> float:
    """The share of known n-grams below which a text is in no taught language, from all labelled texts that taught nothing.

    Each language counts as much as any other: a text weighs one by the texts of its language.
    """
    languages, filters, wrong = model
    if not languages:
        return 0.0
    spark = docs.sparkSession
    labelled = docs.filter(held_out(F.col("doc_id")) & F.col("lang").isin(*languages) & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    shared = spark.sparkContext.broadcast((filters, wrong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_array, rate = shared.value
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column("text")):
                step = np.floor(decide(raw, offsets, slot_array, rate)[2] * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(row, end - row), pa.array(step)], ["lang", "step"])

    counted = labelled.mapInArrow(run, "lang string, step long").groupBy("lang", "step").agg(F.count("*").alias("n"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("texts"))
    each = counted.join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("texts"))
    found = sorted((r["step"], r["share"]) for r in each.groupBy("step").agg(F.sum("share").alias("share")).collect())
    left = sum(share for _, share in found) * STRAY / 1000
    for step, share in found:
        left -= share
        if left <= 0:
            return REJECT_SHARE * step / STEPS
    return 0.0


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, whose language can be told; fits on the rows that are not held out.

    Texts go that have no letter, no n-gram of any taught language, or too few of the language that wins.
    """
    spark = docs.sparkSession
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    least = floor(docs, model)
    shared = spark.sparkContext.broadcast(model[1:])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_array, rate = shared.value
        for batch in batches:
            for row, end, raw, offsets in at.pieces(batch.column(text_at)):
                part = batch.slice(row, end - row)
                good = part.column(len(batch.schema) - 1).to_numpy(zero_copy_only=False)
                if len(rate):
                    _, score, known = decide(raw, offsets, slot_array, rate)
                    good = good & (score > 0) & (known >= least)
                kept = part.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))

    name = "_letters" + "_" * max(map(len, docs.columns))  # clashes with no column
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(name)
    return docs.select("*", letters).mapInArrow(run, docs.schema)
