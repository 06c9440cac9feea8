"""Cleaning and consolidation of spreadsheets (survey P1-P5, A1, F20, U1-U3)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, blank_to_null, null_to_blank

# Fragments of columns to drop; columns that identify a person; columns of the search view.
EXCLUDED = ("employer name", "filing type", "due date", "fair market value", "nature of investment", "unnamed")
PERSON_COLUMNS = ("first name", "middle name", "last name", "email address")
EMAIL_COLUMNS = ("email address", "email")
ENTITY_COLUMNS = ("name of business entity",)
VIEW_COLUMNS = ("first name", "middle name", "last name", "email address", "email", "name of business entity", "interest")


def title(name: str) -> str:
    """line breaks and stretches of white space in a column title as one blank."""
    return re.sub(r"\s+", " ", str(name)).strip()


def sql_name(name: str, empty: str = "dataframe") -> str:
    """letters, digits and single underscores; never a digit first."""
    out = re.sub(r"_+", "_", re.sub(r"\W+", "_", name.strip().lower())).strip("_")
    out = out or empty
    return f"table_{out}" if out[0].isdigit() else out


def sql_names(names: list[str]) -> list[str]:
    """distinct names; repeats are numbered from 1."""
    seen: dict[str, int] = {}
    out = []
    for name in map(sql_name, names):
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def identifier(name: str) -> str:
    """The name itself if it is a plain SQL identifier."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII):
        raise ValueError(f"{name!r} is no identifier")
    return name


def titled(df: DataFrame) -> DataFrame:
    return df.toDF(*map(title, df.columns))


def sql_titled(df: DataFrame) -> DataFrame:
    return df.toDF(*sql_names(df.columns))


def _named(df: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c.strip().lower() in wanted]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def drop_excluded(df: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """P1"""
    return df.select(*(_q(c) for c in df.columns if not any(e in title(c).lower() for e in excluded)))


def view_columns(df: DataFrame, wanted: tuple[str, ...] = VIEW_COLUMNS) -> DataFrame:
    """The wanted columns if there are any, else all."""
    some = _named(df, wanted)
    return df.select(*map(_q, some)) if some else df


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows with nothing at all go, then rows without a name or address."""
    some = _named(df, PERSON_COLUMNS)
    full = df.dropna("all")
    return full.filter(any_of(F.length(F.trim(null_to_blank(_q(c).cast("string")))) > 0 for c in some)) if some else full


def search(sources: dict[str, DataFrame], query: str) -> DataFrame:
    """Rows whose last name or address holds the text, whatever the case, with the name of their source."""
    wanted, out = query.strip().lower(), None
    for name, df in sources.items():
        some = _named(df, ("last name", *EMAIL_COLUMNS))
        if not some:
            continue
        hit = any_of(F.lower(F.trim(null_to_blank(_q(c).cast("string")))).contains(wanted) for c in some)
        found = df.filter(hit).select(F.lit(name).alias("source"), *map(_q, df.columns))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source has a last name or address column")
    return out


def consolidate(df: DataFrame, key: str, entity: str, order: str) -> DataFrame:
    """A1: one row for each address: other columns keep their first non-blank value, entities are listed once each,
    two on a line; rows with a null address stay as they are, rows with a blank one go.

    `order` is the column that says which row comes first.
    """
    name = F.lower(F.trim(_q(key).cast("string")))
    named = df.filter(_q(key).isNotNull()).withColumn("_key", name).filter(F.col("_key") != "")
    first = []
    for c in df.columns:
        if c in (key, entity, order):
            continue
        value = _q(c)
        full = F.length(F.trim(value.cast("string"))) > 0
        first.append(F.min_by(value, F.when(full, _q(order))).alias(c))
    text = F.trim(_q(entity).cast("string"))
    # distinct entities first, so that a hot address never gathers its repeats
    entities = named.filter(F.length(text) > 0).groupBy("_key", text.alias("_e")).agg(F.min(order).alias("_o"))
    pairs = entities.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_e"))), lambda x: x["_e"]).alias("_l"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / 2).cast("int")), lambda i: F.array_join(F.slice("_l", i * 2 + 1, 2), "; "))
    merged = named.groupBy("_key").agg(F.min(order).alias(order), *first).join(pairs.select("_key", F.array_join(lines, "\n").alias(entity)), "_key", "left")
    out = merged.withColumnRenamed("_key", key).select(*map(_q, df.columns))
    return out.unionByName(df.filter(_q(key).isNull()))


def consolidate_sheet(df: DataFrame, order: str) -> DataFrame:
    """A1 with the columns found by name; unchanged where one is missing or no row has an address."""
    keys, entities = _named(df, EMAIL_COLUMNS), _named(df, ENTITY_COLUMNS)
    if not keys or not entities or df.filter(_q(keys[0]).isNotNull()).isEmpty():
        return df
    return consolidate(df, keys[0], entities[0], order)


def sheet(df: DataFrame, order: str, empty_rows: bool = False) -> DataFrame:
    """Titles, empty rows (kept where `empty_rows`), excluded columns, consolidation."""
    out = titled(df)
    out = out if empty_rows else drop_empty(out)
    return consolidate_sheet(drop_excluded(out), order)


def keep_longest(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """A4: of rows with equal keys (nulls equal) the one with the longest text, then the first; `first_seen` is the earliest.

    Rows are compared as they are met, so a key that many rows have is summed up before it moves.
    """
    best = F.min_by(F.struct(*map(_q, df.columns)), F.struct(F.coalesce(-F.length(name), F.lit(1)), order))
    grouped = df.groupBy(*(_q(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(best.alias("_best"), F.min(order).alias("first_seen"))
    return grouped.select("_best.*", "first_seen")


def longest_link(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A5: for each key the longest trimmed snippet and the first non-blank path."""
    text = F.trim(null_to_blank("snippet"))
    return df.groupBy(*keys).agg(
        F.max_by(text, F.struct(F.length(text), (-F.col(order)).alias("o"))).alias("snippet"),
        F.coalesce(F.min_by("source_path", F.when(blank_to_null("source_path").isNotNull(), F.col(order))), F.lit("")).alias("source_path"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    """U1"""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
