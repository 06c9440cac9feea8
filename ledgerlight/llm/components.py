"""Connected components of links between documents, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, written

#: Far above what pointer jumping needs; a loop that runs so long has a fault.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, label): each linked id with the smallest id that it can reach.

    Labels flow along links, then each label is replaced by its own label, so
    paths shorten at least twofold a round.  Each round is written to the shared folder.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges = written(both)
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), F.lit(None).cast("long").alias("old"), "label"))
    for _ in range(MOST_ROUNDS):
        told = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(told, labels["id"] == told["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("id").alias("root"), F.col("label").alias("root_label"))
        new = written(near.join(roots, near["label"] == roots["root"]).select("id", "old", F.least("label", "root_label").alias("label")))
        drop(labels)
        labels = new
        if labels.filter("label <> old").isEmpty():
            drop(edges)
            out = labels.select("id", "label")
            out._written_at = labels._written_at
            return out
    raise RuntimeError("components did not settle")
