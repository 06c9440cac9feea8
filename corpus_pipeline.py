"""From raw documents to token ids, stage by stage.

Every stage takes all rows that its predecessor kept, written and read again,
and lets its decisions take effect; all but the last return the columns of
`documents`, whatever those are: extra columns go along, and names that the
operators use themselves don't clash.

Nulls, ties, repeats: a null or wordless text goes in the first stage; a null
doc_id counts as the largest identifier and may stay.  Of equal texts the one
with the most code points stays, then the smallest identifier; of rows that
repeat identifier and text one stays.  An empty table gives an empty table with
the same columns at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import byte_bpe, content_sort, decontam, langid, ngram_join
from ledgerlight.llm.shared import drop, lasting
from ledgerlight.ship import shipped


@shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null or letterless texts, and those of no taught language.

    Where no row has a language, texts with letters stay: nothing was taught, so nothing is known against them.
    """
    return langid.accepted(docs)


@shipped
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays; null and empty texts are one group."""
    return content_sort.survivors(docs)


@shipped
def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier stays; texts without words are in no group."""
    return ngram_join.keep_first(docs)


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; with an empty benchmark, or without words, none does."""
    leaks = decontam.leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["leaked"]), "left_anti")


@shipped
def byte_bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with what decoding them gives: doc_id, n_tokens, ids, ids_sha256, decoded_sha256; a null text has none."""
    return byte_bpe.digests(spark, docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe_encode),
]

#: Language identification, alignment and token merging are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = lasting(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
