"""Where queries register, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import folder  # noqa: F401  queries take it from here

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: search_key and company_key in SQL.
KEY = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
COMPANY = "trim(regexp_replace(" + KEY + ", '((^| )(inc|llc|corp|corporation|co|company|ltd|lp|llp|pllc))+$', ''))"

def token_set(least: int = 0) -> str:
    """From a common table q(x, y) of distinct pairs of texts: scored(x, y, score), the token-set score, of pairs that may have `least`.

    The longest common subsequence comes row by row from the textbook's table; lengths alone rule most pairs out.
    """
    shares = "100 * (1 - {apart} / (n + gap + na + n + gap + nb)), 100 * (1 - (gap + na) / (n + n + gap + na)), 100 * (1 - (gap + nb) / (n + n + gap + nb))"
    score = "CASE WHEN sh <> '' AND (na = 0 OR nb = 0) THEN 100 WHEN sh = '' THEN 100 * (1 - {apart} / (na + nb)) ELSE greatest(" + shares + ") END"
    return f"""
    words AS (SELECT x, y, list_sort(list_distinct(string_split(x, ' '))) AS tx, list_sort(list_distinct(string_split(y, ' '))) AS ty FROM q),
    sides AS (
      SELECT x, y, array_to_string(list_filter(tx, lambda w: list_contains(ty, w)), ' ') AS sh,
             array_to_string(list_filter(tx, lambda w: NOT list_contains(ty, w)), ' ') AS a, array_to_string(list_filter(ty, lambda w: NOT list_contains(tx, w)), ' ') AS b
      FROM words),
    sized AS MATERIALIZED (
      SELECT * FROM (
        SELECT *, CAST(length(sh) AS DOUBLE) AS n, CAST(length(a) AS DOUBLE) AS na, CAST(length(b) AS DOUBLE) AS nb, CASE WHEN sh = '' THEN 0 ELSE 1 END AS gap FROM sides)
      WHERE {score.format(apart="abs(na - nb)")} >= {least}),
    grown AS (
      SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: 0) AS had FROM (SELECT DISTINCT a, b FROM sized)
      UNION ALL
      SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda r, j: list_append(r,
        CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN had[j] + 1 ELSE greatest(r[-1], had[j + 1]) END), [0])
      FROM grown WHERE i < length(a)),
    parts AS (
      SELECT sized.*, CAST(na + nb - 2 * had[-1] AS DOUBLE) AS apart
      FROM sized JOIN grown ON sized.a = grown.a AND sized.b = grown.b AND i = length(grown.a)),
    fine AS (SELECT x, y, {score.format(apart="apart")} AS score FROM parts),
    scored AS (SELECT x, y, CAST(floor(score) AS INT) AS score FROM fine)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
