"""Readers (survey S1-S8, S11-S15, S18, S21, A14)."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import identifier
from . import files, sheets

MANIFEST = T.StructType([T.StructField(n, T.IntegerType() if n == "depth" else T.StringType()) for n in ("site", "url", "kind", "status", "meeting_date", "content_type", "local_path", "referrer", "depth", "error")])
SHEETS = (".xls", ".xlsx", ".xlsm")


def csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header row; types from the data unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The chosen sheet of a workbook; the old binary format is read by pandas where it has a reader for it."""
    low = path.lower()
    if not low.endswith(SHEETS):
        raise ValueError(f"{path} is no workbook")
    if not low.endswith(".xls"):
        return sheets.read(spark, path)
    import pandas as pd

    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    book = pd.ExcelFile(io.BytesIO(content))
    return spark.createDataFrame(book.parse(sheets.chosen_sheet(book.sheet_names), dtype=str))


def spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    return workbook(spark, path) if path.lower().endswith(SHEETS) else csv_table(spark, path)


def folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: a frame for each sheet file of a folder by name, without lock files; or for a single file."""
    if not files.is_folder(spark, path):
        return {path.rstrip("/").rsplit("/", 1)[-1]: spreadsheet(spark, path)}
    names = [n for n, _ in files.listed(spark, path) if not n.startswith("~$") and n.lower().endswith((".csv", *SHEETS))]
    if not names:
        raise ValueError(f"{path} holds no sheet files")
    return {n: spreadsheet(spark, files.child(path, n)) for n in names}


def companies(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a Company column."""
    return required(spreadsheet(spark, path), "Company")


def required(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def interests(spark: SparkSession, path: str) -> DataFrame:
    """Interest, keyword and their places by first appearance, counted from 0 through all files in order of their names."""
    rows = required(placed(dictionary(spark, path), "keyword_ord"), "interest", "keyword").select("interest", "keyword", "keyword_ord")
    first = rows.groupBy(F.col("interest").alias("_i")).agg(F.min("keyword_ord").alias("interest_ord"))
    return rows.join(first, F.col("interest").eqNullSafe(F.col("_i"))).drop("_i")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; cells may hold line feeds."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def placed(rows: DataFrame, place: str) -> DataFrame:
    """Rows of files with their place, counted from 0: files by name, then parts of a file, then rows of a part.

    The engine deals parts to its tasks by size, so its own row numbers have gaps and need not follow the files.
    Only a count for each part goes through one task.
    """
    kept = rows.columns
    read = rows.select(*(F.col(f"`{c}`") for c in kept), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    parts = read.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_f", "_b", (before - F.col("_first")).alias("_to"))
    return read.join(F.broadcast(starts), ["_f", "_b"]).select(*(F.col(f"`{c}`") for c in kept), (F.col("_id") + F.col("_to")).alias(place))


def manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The fetch log; malformed lines fail, or are left out where `strict` is off."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def sites(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """Sites below the root that have a manifest, sorted, and warnings for those without."""
    if not files.is_folder(spark, root):
        return [], [f"no such folder: {root}"]
    names = [n for n, is_folder in files.listed(spark, root) if is_folder]
    have = [n for n in names if files.exists(spark, files.child(files.child(root, n), "manifest.jsonl"))]
    return have, [f"no manifest: {n}" for n in names if n not in have]


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Path and text of each file; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"))


def cached_texts(files: DataFrame, cache: DataFrame, url: str = "url", within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Texts that a cache keyed by the URL's digest holds, and the files still to be read.

    Each file comes once, however often its URL is cached; of several texts of a key the first in order counts.
    A cache that is kept apart for each value of columns `within` answers only files with the same values (nulls equal).
    """
    keyed = files.withColumn("cache_key", F.sha1(F.col(url).cast("binary")))
    names = ("cache_key", *within)
    one = cache.groupBy(*(F.col(c).alias(f"_{c}") for c in names)).agg(F.min("text").alias("_text"))
    same = reduce(and_, (keyed[c].eqNullSafe(one[f"_{c}"]) for c in names))
    held = keyed.join(one, same).select(*(keyed[c] for c in keyed.columns), F.col("_text").alias("text"))
    return held, keyed.join(one, same, "left_anti")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Any query; user and password come from the options or the environment, there is no default."""
    login = {k: v for k, v in (("user", os.environ.get("PGUSER")), ("password", os.environ.get("PGPASSWORD"))) if v}
    return spark.read.format("jdbc").options(url=url, query=query, **(login | options)).load()


def base_tables(spark: SparkSession, schema: str, words: Iterable[str] = ()) -> list[str]:
    """Tables of a schema in order; those with one of the words, all if none has."""
    names = sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    some = [n for n in names if any(w in n or w.replace("_", " ") in n.replace("_", " ") for w in words)]
    return some or names


def profile(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below a path of CSV files, and their rows."""
    return files.size(spark, path), spark.read.option("header", True).option("multiLine", True).csv(path).count()


def table_rows(spark: SparkSession, name: str, schema: str | None = None, url: str | None = None, **options: str) -> DataFrame:
    """A table of the catalog, or of a database by JDBC; names are checked first."""
    full = ".".join(map(identifier, [schema, name] if schema else [name]))
    if url is None:
        return spark.table(full)
    return spark.read.format("jdbc").options(url=url, dbtable=full, **options).load()


def first_available(sources: Iterable[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """The first source that can be read, with its name as source_type."""
    failures = []
    for name, read in sources:
        try:
            return read().withColumn("source_type", F.lit(name))
        except Exception as e:  # a missing table, file or driver: the next source is tried
            failures.append(f"{name}: {type(e).__name__}")
    raise FileNotFoundError("; ".join(failures))


def search_responses(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document (JSON text) of the saved search responses."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.coalesce(F.get_json_object("value", "$.d.documents"), F.get_json_object("value", "$.data.documents"), F.get_json_object("value", "$.documents"), F.get_json_object(F.get_json_object("value", "$.d"), "$.documents"))
    each = F.from_json(wrapped, "array<variant>")
    return raw.select(F.explode(each).alias("v")).select(F.to_json("v").alias("document"))


def entity_rows(spark: SparkSession, path: str) -> DataFrame:
    """Entities from JSON, or from CSV with the separator found in its first lines."""
    if path.lower().endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4096]
    try:
        sep = csv.Sniffer().sniff(head, ",;|\t").delimiter
    except csv.Error:
        sep = ","
    return spark.read.option("header", True).option("sep", sep).csv(path)
