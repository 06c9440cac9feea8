"""Exact deduplication by content sort, with DataFrame functions alone.

Texts are normalised (white space `[\\x20\\x09-\\x0D]` deleted), range-partitioned
at splitters that the engine samples, and sorted externally by content inside
each range, so equal texts stand side by side; neighbours are compared in full.
The range key is the content's beginning and two hashes, all of bounded size, so
the samples that reach the driver don't grow with the texts: equal texts have
equal beginnings and first hashes, and different texts with one beginning, such
as a license, spread by them.

The last hash is a salt, 0 for all but large groups of copies: a sample of the
rows tells which groups would fill more than a part of a range, and those are
cut into runs of about that size.  Whatever the sample says, results are the
same: each run is settled by itself, and the few runs of a large group meet by
digest.

Null text is the empty text.  Of equal texts the row with the most code points
in the original text stays, then the smallest doc_id; of rows that repeat both,
all are returned and one is kept.  A null doc_id sorts last.  An empty table
gives an empty table; other columns are ignored, or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Code points of a text's beginning by which texts are dealt into ranges.
HEAD = 32
#: One row in so many is sampled for large groups; a group is large that has more than 1 / PARTS of a range's share of the
#: sample, and at least LEAST rows there.
SAMPLED, PARTS, LEAST = 64, 4, 8
WHITE = " \t\n\x0b\x0c\r"
RUN = ("head", "content", "mixed", "salt")


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row (as `row`) with its identifier, size, normalised text and what its range depends on, but for the salt."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select(
        "row",
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("row.text", F.lit(""))).alias("points"),
        normalised(F.col("row.text")).alias("content"),
    ).select("*", F.left("content", F.lit(HEAD)).alias("head"), F.xxhash64("content").alias("mixed"))


def large_groups(docs: DataFrame) -> DataFrame:
    """The hash of each large group and the runs to cut it into: at most PARTS rows for each shuffle partition."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST, docs.count() // (SAMPLED * PARTS * partitions))
    seen = _keyed(docs.sample(1 / SAMPLED, seed=11)).groupBy("mixed").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return written(seen.select("mixed", F.ceil(F.col("n") / most).cast("int").alias("salts")))


def sorted_runs(docs: DataFrame, carried: str, large: DataFrame) -> DataFrame:
    """Rows with their place in the run of equal neighbours, best first, the run's size and its best row's identifier.

    `carried` is what moves besides: `content`, or `row`, from which the content is made again.
    """
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id", "points"), F.col("salts"))).otherwise(0).cast("int")
    rows = _keyed(docs).join(F.broadcast(large), "mixed", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", salt)
    ranged = rows.select("doc_id", "points", "head", "mixed", "salts", "salt", carried).repartitionByRange("head", "mixed", "salt")
    if carried == "row":
        ranged = ranged.withColumn("content", normalised(F.col("row.text")))
    # in the order of the contents; the hashes behind them only tell the engine that the ranges hold whole runs
    beside = Window.partitionBy(*RUN).orderBy(F.desc("points"), F.asc_nulls_last("doc_id"))
    return ranged.select(
        "*",
        F.row_number().over(beside).alias("place"),
        F.first("doc_id").over(beside).alias("best"),
        F.count(F.lit(1)).over(Window.partitionBy(*RUN)).alias("run"),
    ).withColumn("text_sha256", F.sha2(F.col("content"), 256))


def _settled(heads: DataFrame) -> DataFrame:
    """Of the runs of large groups (a row each, few): each group's best row and size."""
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"))
    return heads.groupBy("text_sha256").agg(F.min(order).alias("whole"), F.sum("run").cast("long").alias("whole_size"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    runs = written(sorted_runs(docs, "content", large_groups(docs)).select("doc_id", "points", "salts", "place", "best", "run", "text_sha256"))
    small = runs.filter("salts = 1").select("doc_id", F.col("best").alias("keep_id"), F.col("run").cast("long").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256")
    cut = runs.filter("salts > 1")
    groups = _settled(cut.filter("place = 1"))
    # rows of one identifier and size share a run
    kept = (F.col("place") == 1) & F.col("doc_id").eqNullSafe(F.col("whole.doc_id")) & (F.col("points") == -F.col("whole.col1"))
    large = cut.join(F.broadcast(groups), "text_sha256").select("doc_id", F.col("whole.doc_id").alias("keep_id"), F.col("whole_size").alias("group_size"), kept.alias("kept"), "text_sha256")
    return small.unionByName(large)


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, that deduplicate() keeps; every row moves once."""
    heads = written(sorted_runs(docs, "row", large_groups(docs)).filter("place = 1").select("row", "doc_id", "points", "salts", "run", "text_sha256"))
    cut = heads.filter("salts > 1")
    best = _settled(cut).select(F.col("text_sha256").alias("_sha"), F.col("whole.doc_id").alias("_id"), (-F.col("whole.col1")).alias("_points"))
    large = cut.join(F.broadcast(best), (F.col("text_sha256") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("points") == F.col("_points")), "left_semi")
    return heads.filter("salts = 1").select("row.*").unionByName(large.select("row.*"))
