"""Writers (survey K1-K9, K11-K13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import document_path, extension_for
from ..operators.clean import identifier, sql_name, sql_titled
from . import sheets


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """K1, K11"""
    df.write.mode(mode).json(path)


def json_array(df: DataFrame, *order: Column | str) -> DataFrame:
    """K2: the lines of a JSON array of all rows, in order: a value for each row, the brackets as the first and last lines.

    Written as text in its order, the frame is one JSON array of any length.
    """
    rows = df.select(F.struct(*order).alias("_o"), F.concat(F.lit("  "), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    last = rows.agg(F.max("_o")).scalar()
    told = rows.select(F.lit(1).alias("_part"), "_o", F.when(F.col("_o") < last, F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
    none = F.lit(None).cast(rows.schema["_o"].dataType)
    ends = df.sparkSession.createDataFrame([(0, "["), (2, "]")], "_part int, value string").select("_part", none.alias("_o"), "value")
    return told.unionByName(ends).orderBy("_part", "_o").select("value")


def flat(df: DataFrame) -> DataFrame:
    """K3: lists joined by semicolons."""
    return df.select(*(F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    """K3-K5: a header also where there are no rows."""
    out = flat(df.select(*columns) if columns else df)
    (out.coalesce(1) if out.isEmpty() else out).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def merged_csv(frames: list[DataFrame], path: str, dropped: tuple[str, ...] = ("minutes_text",)) -> None:
    """K4: all columns in order of first appearance, without the dropped ones."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    csv(out.drop(*dropped), path)


def processed(df: DataFrame, source: str, folder: str) -> str:
    """K6: a CSV folder named after its source."""
    path = f"{folder}/{source.rsplit('/', 1)[-1].rsplit('.', 1)[0]}_processed.csv"
    csv(df, path, mode="overwrite")
    return path


def table(df: DataFrame, name: str, exists: str = "fail", schema: str | None = None, **options: str) -> str:
    """K8: with names fit for SQL; `exists` is fail, replace or append."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    full = f"{sql_name(schema)}.{sql_name(name)}" if schema else sql_name(name)
    sql_titled(df).write.mode(modes[exists]).options(**options).saveAsTable(full)
    return full


def jdbc_table(df: DataFrame, url: str, name: str, exists: str = "fail", schema: str | None = None, **options: str) -> str:
    """K8: the same in a database by JDBC."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    full = ".".join(map(identifier, [schema, sql_name(name)] if schema else [sql_name(name)]))
    sql_titled(df).write.format("jdbc").options(url=url, dbtable=full, **options).mode(modes[exists]).save()
    return full


def workbook(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """K7"""
    sheets.write(flat(df), path, sheet)


def database(spark, location: str, path: str | None = None) -> str:
    """A database named for a location, in the warehouse or at a path."""
    name = sql_name(location)
    at = "" if path is None else " LOCATION '" + path.replace("'", "\\'") + "'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{at}")
    return name


def document_rows(fetched: DataFrame) -> DataFrame:
    """Fetched bodies with the path that each is kept under."""
    return fetched.withColumn("local_path", document_path("site", "url", extension_for("content_type")))


def text_index(minutes: DataFrame) -> DataFrame:
    """minutes_cache_key with its entry as JSON; a row for each file, so the index may be of any size."""
    return minutes.select("minutes_cache_key", F.to_json(F.struct("meeting_date", "body", "meeting_title", "minutes_url", "text_path")).alias("entry"))
