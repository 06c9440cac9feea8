"""State tables without MERGE: every change gives a new snapshot (survey D1-D9, J16, J17, A2, A6, T3, K10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, null_to_blank

# States in order.
STATES = ("discovered", "downloaded", "parsed", "error")
PATCHED = (
    "filer_last_name", "filer_first_name", "filer_middle_name", "filer_full_name", "position_title", "agency_name", "entity_name",
    "form_description", "filing_year", "due_date", "filed_date", "filing_type", "page_count", "download_form_url",
)


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("first_seen_at",), seen: str = "last_seen_at") -> DataFrame:
    """New keys come in, known ones take the new values except the columns in `keep`; `seen` is when a key was met last."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    there = F.col(f"b.{key}").isNotNull()
    out = []
    for c in old.columns:
        if c == seen:
            value = F.when(there, now).otherwise(F.col(f"a.{c}"))
        elif c == "first_seen_at":
            value = F.coalesce(f"a.{c}", now)
        elif c in keep or c not in new.columns:
            value = F.coalesce(f"a.{c}", f"b.{c}") if c in new.columns else F.col(f"a.{c}")
        else:
            value = F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def merge_links(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("company_name", "source_url")) -> DataFrame:
    """A longer snippet replaces a shorter one, a path only fills a blank; new keys come in."""
    a, b = old.alias("a"), new.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    both = a.join(b, on, "full")
    was, is_now = null_to_blank("a.snippet"), null_to_blank("b.snippet")
    snippet = F.when((F.trim(is_now) != "") & (F.length(is_now) > F.length(was)), is_now).otherwise(was)
    path = F.coalesce(blank_to_null("a.source_path"), F.col("b.source_path"), F.lit(""))
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), snippet.alias("snippet"), path.alias("source_path"))


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The children of the given parents are replaced, by none where there are none."""
    kept = children.join(parents.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.join(parents.select(key).distinct(), key, "left_semi"), allowMissingColumns=True)


def parsed(parents: DataFrame, children: DataFrame, done: DataFrame, key: str, count: str, now: Column) -> DataFrame:
    """Parents that were parsed, with the number of their children."""
    n = children.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    flag = done.select(key).distinct().withColumn("_done", F.lit(True))
    joined = parents.join(flag, key, "left").join(n, key, "left")
    hit = F.coalesce("_done", F.lit(False))
    changes = {"parse_status": F.lit("parsed"), "error_message": F.lit(""), "parsed_at": now, count: F.coalesce("_n", F.lit(0))}
    return joined.select(*((F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in parents.columns))


def downloaded(parents: DataFrame, files: DataFrame, key: str, now: Column) -> DataFrame:
    """Paths and digest of downloads; the first download's time stays."""
    extra = [c for c in files.columns if c != key]
    joined = parents.join(files.select(key, *(F.col(c).alias(f"_{c}") for c in extra), F.lit(True).alias("_hit")), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changes = {"downloaded_at": F.coalesce("downloaded_at", now), "parse_status": F.lit("downloaded"), "error_message": F.lit("")} | {c: F.col(f"_{c}") for c in extra}
    return joined.select(*((F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in parents.columns))


def failed(parents: DataFrame, errors: DataFrame, key: str) -> DataFrame:
    """Errors has the key and a message."""
    joined = parents.join(errors.select(key, F.col("message").alias("_m")), key, "left")
    hit = F.col("_m").isNotNull()
    changes = {"parse_status": F.lit("error"), "error_message": F.col("_m")}
    return joined.select(*((F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)) for c in parents.columns))


def patched(filings: DataFrame, updates: DataFrame, key: str, parity: bool = False) -> DataFrame:
    """Listed columns take the update's values; with `parity` also blank ones, as the data's origin does."""
    names = [c for c in updates.columns if c in PATCHED]
    joined = filings.join(updates.select(key, *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_hit")), key, "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = lambda c: F.when(hit & (F.lit(parity) | blank_to_null(f"_{c}").isNotNull()), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(new(c) if c in names else F.col(c) for c in filings.columns))


def latest(log: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last entry of each key."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return rows.join(seen.select(key), key, "left_anti")


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """J17, U3"""
    return wanted.subtract(found)


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that aren't there yet come in as nulls."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns))


def written_counts(rows: DataFrame, database: str) -> DataFrame:
    """Rows for each database; the true total."""
    return rows.groupBy(database).agg(F.count("*").alias("written"))
