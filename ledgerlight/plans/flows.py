"""End-to-end flows, each one lazy plan up to its sinks (survey §3, Q1, Q5)."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.web import years_list
from ..operators import awards, clean, filings, matching, phrase, store, votes
from ..operators.lineage import settled
from ..ship import ship
from ..sources import feed, files, readers, sinks


def votes_and_holdings(minutes: DataFrame, payloads: DataFrame, agency: str | None = None, least: float = 0.75) -> dict[str, DataFrame]:
    """Minutes texts and disclosure payloads to vote rows, entities, enriched votes and minutes matches.

    What several of these need is made once and written to the shared folder.
    """
    rows = votes.vote_rows(minutes).join(minutes.select("minutes_cache_key", "meeting_date", "body"), "minutes_cache_key")
    rows = settled(rows.withColumn("row_id", F.xxhash64("minutes_cache_key", "pos", "name_pos")))
    items = settled(filings.sanitized(filings.payload_rows(payloads)).filter(filings.agency_is("filer_agency_name", agency)))
    found = settled(phrase.entities(items, "ord"))
    matched = settled(phrase.vote_matches(phrase.allowed(rows, items.select(F.col("owner_full_name").alias("full_name"))), found, least=least))
    return {"votes": rows, "entities": items, "enriched": phrase.enriched(rows, matched), "minutes_matches": phrase.minutes_matches(minutes, found, least)}


def award_links(docs: DataFrame, known: DataFrame, database: str = "city") -> tuple[DataFrame, DataFrame]:
    """Agenda documents to awards, and the company links that they add to those known."""
    found = awards.awards(docs)
    linked = found.filter(F.trim(F.coalesce("company_name", F.lit(""))) != "").withColumn("source_url", F.coalesce("source_url", F.lit("")))
    new = clean.longest_link(linked, ["company_name", "source_url"], "ord")
    return found, store.merge_links(known, new)


def compare(people: DataFrame, companies: DataFrame, threshold: int = 90) -> tuple[DataFrame, DataFrame]:
    """Officials' entities against companies: ranked matches, and counts by type."""
    rows = matching.compared(people, companies, threshold)
    return matching.ranked(rows), matching.counts(rows)


def spreadsheets(spark: SparkSession, path: str, out: str | None = None, tables: str | None = None) -> dict[str, DataFrame]:
    """Sheets cleaned and consolidated; written as CSV or tables if asked."""
    done = {}
    for name, df in readers.folder(spark, path).items():
        frame = clean.sheet(df.withColumn("_ord", F.monotonically_increasing_id()), "_ord").drop("_ord")
        done[name] = frame
        if out:
            sinks.processed(frame, name, out)
        if tables:
            sinks.table(frame, name.rsplit(".", 1)[0], tables)
    return done


def statement(spark: SparkSession, sql: str) -> DataFrame | None:
    """Q1: any SQL; None for a statement without a result."""
    df = spark.sql(sql)
    return df if df.columns else None


def vote_run(spark: SparkSession, texts: str, payloads: str, out: str, agency: str = "", least: float = 0.75, known: str | None = None, reparse: bool = False) -> dict[str, int]:
    """One cycle: minutes texts (a file each) and disclosure payloads (JSON lines) to CSV files below `out`; rows of each.

    `known` is a folder of minutes keys that earlier cycles have taken in; those are left out unless `reparse` is set.
    """
    minutes = readers.texts(spark, texts).select(F.sha1(F.encode("path", "UTF-8")).alias("minutes_cache_key"), "text", F.lit("").alias("meeting_date"), F.element_at(F.split("path", "/"), -1).alias("body"))
    if known and not reparse and files.exists(spark, known):
        minutes = store.unseen(minutes, spark.read.parquet(known), "minutes_cache_key")
    found = votes_and_holdings(minutes, spark.read.schema(filings.PAYLOADS).json(payloads), agency or None, least)
    counts = {}
    for name, df in found.items():
        plain = settled(df.select(*(c for c, t in df.dtypes if not t.startswith("struct"))))
        sinks.csv(plain, files.child(out, f"{name}.csv"), mode="overwrite")
        counts[name] = plain.count()
    if known:
        minutes.select("minutes_cache_key").write.mode("append").parquet(known)
    return counts


def cycles(run: Callable[[], object], live: bool, minutes: float = 60.0, pause: Callable[[float], None] = time.sleep, most: int | None = None) -> int:
    """Once, where an error ends the run; or live, again and again with a pause of a second at least, whatever fails."""
    done = 0
    while True:
        try:
            run()
        except Exception as e:
            if not live:
                raise
            print(f"the run failed: {e}", flush=True)
        done += 1
        if not live or most is not None and done >= most:
            return done
        pause(max(minutes * 60, 1))


def keyword_run(spark: SparkSession, companies: str, interests: str, out: str, threshold: int = 90) -> DataFrame:
    """A workbook's companies with their interests, written as a workbook."""
    rows = readers.companies(spark, companies).select(F.col("Company").alias("company"))
    done = matching.keyword_match(rows, readers.interests(spark, interests), threshold)
    sinks.workbook(done, out)
    return done


def compare_run(spark: SparkSession, people: str, companies: str, out: str, threshold: int = 90) -> DataFrame:
    """Officials' sheet against a companies' sheet: ranked matches as CSV."""
    sheet = readers.spreadsheet(spark, people)
    names = {clean.title(c).lower(): F.col(f"`{c}`") for c in sheet.columns}
    of = lambda *wanted: next((names[w] for w in wanted if w in names), F.lit(""))
    left = sheet.select(F.monotonically_increasing_id().alias("row_id"), of(*clean.ENTITY_COLUMNS, "company").alias("entity"), F.concat_ws(" ", of("first name"), of("last name")).alias("name"), of(*clean.EMAIL_COLUMNS).alias("email"), of("position").alias("position"))
    right = readers.companies(spark, companies)
    more = {clean.title(c).lower(): F.col(f"`{c}`") for c in right.columns}
    extra = [more.get(c.replace("_", " "), more.get(c, F.lit(""))).alias(c) for c in ("source_url", "source_path", "snippet")]
    ranked, counted = compare(left, right.select(F.monotonically_increasing_id().alias("ord"), F.col("Company").alias("company"), *extra), threshold)
    sinks.csv(ranked, out, mode="overwrite")
    return counted


def parser() -> argparse.ArgumentParser:
    """Q5: the commands and their options."""
    top = argparse.ArgumentParser(prog="ledgerlight")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("sql").add_argument("statement")
    sheets = sub.add_parser("sheets")
    sheets.add_argument("path")
    sheets.add_argument("--out")
    sheets.add_argument("--tables", choices=("fail", "replace", "append"))
    found = sub.add_parser("awards")
    found.add_argument("path")
    found.add_argument("--out", required=True)
    voted = sub.add_parser("votes")
    voted.add_argument("texts")
    voted.add_argument("payloads")
    voted.add_argument("--out", default="votes")
    voted.add_argument("--agency", default="")
    voted.add_argument("--min-confidence", type=float, default=0.75)
    voted.add_argument("--known")
    voted.add_argument("--reparse", action="store_true")
    voted.add_argument("--live", action="store_true")
    voted.add_argument("--live-interval-minutes", type=float, default=60.0)
    for name in ("compare", "keywords"):
        one = sub.add_parser(name)
        one.add_argument("left")
        one.add_argument("right")
        one.add_argument("--out", required=True)
        one.add_argument("--threshold", type=int, default=90)
    crawled = sub.add_parser("events")
    crawled.add_argument("base")
    crawled.add_argument("--body", required=True)
    crawled.add_argument("--years", required=True)
    crawled.add_argument("--out", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.command == "sql":
        if (df := statement(spark, args.statement)) is not None:
            df.show(250, False)
    elif args.command == "sheets":
        for df in spreadsheets(spark, args.path, args.out, args.tables).values():
            df.show(5)
    elif args.command == "votes":
        cycles(lambda: print(vote_run(spark, args.texts, args.payloads, args.out, args.agency, args.min_confidence, args.known, args.reparse), flush=True), args.live, args.live_interval_minutes)
    elif args.command == "compare":
        compare_run(spark, args.left, args.right, args.out, args.threshold).show()
    elif args.command == "keywords":
        keyword_run(spark, args.left, args.right, args.out, args.threshold)
    elif args.command == "events":
        found = [feed.events(spark, args.base, args.body, year) for year in years_list(args.years) or []]
        sinks.csv(clean.union_all(*found), args.out, mode="overwrite")
    else:
        docs = readers.texts(spark, args.path).select(F.col("path").alias("doc_key"), F.lit("").alias("site"), F.lit("document").alias("source_kind"), F.col("path").alias("source_path"), F.lit(None).cast("string").alias("source_url"), "text")
        sinks.csv(awards.awards(docs).drop("ord"), args.out)


if __name__ == "__main__":
    main()
