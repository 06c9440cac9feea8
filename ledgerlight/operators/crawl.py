"""Crawl state and portal feeds (survey P5, P6, S16, S17, T6, K11, K12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import null_to_blank
from ..functions.web import allowed_host, document_url, normal_date, normal_url, recent_enough, skipped_url, strip_controls, years_in

FETCHED = ("fetched", "saved")


def entries(manifest: DataFrame, kind: str, statuses: tuple[str, ...] = FETCHED) -> DataFrame:
    """P5: log entries of a kind in one of the states."""
    return manifest.filter((F.col("kind") == kind) & F.col("status").isin(*statuses))


def legislation_pages(manifest: DataFrame, token: str = "legislationdetail") -> DataFrame:
    """P5: fetched pages whose URL holds the token."""
    return entries(manifest, "page").filter(F.lower("url").contains(token))


def eligible(urls: DataFrame, url: str, hosts: list[str], least_year: int, latest_year: int) -> DataFrame:
    """Allowed host, no skipped word, no year before the window."""
    return urls.filter(allowed_host(url, hosts) & ~skipped_url(url) & recent_enough(url, least_year, latest_year))


def events(feed: DataFrame, body: str, year: int, most: int = 500) -> DataFrame:
    """A body's events of a year, latest first, at most so many (the feed's page size)."""
    return feed.filter((F.col("EventBodyName") == body) & (F.year(F.to_timestamp("EventDate")) == year)).orderBy(F.desc("EventDate"), "EventId").limit(most)


def meetings(archived: DataFrame, upcoming: DataFrame, portal: str, years: list[int], latest_year: int) -> DataFrame:
    """Both feeds' meetings with a compiled document, one for each template (later feed wins), latest year first.

    Feeds have title, date, documentList array<struct<templateId, templateName, compileOutputType>>.
    """
    both = archived.withColumn("_rank", F.lit(0)).unionByName(upcoming.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    ready = F.filter("documentList", lambda d: (d["compileOutputType"] == 1) & (null_to_blank(d["templateId"].cast("string")) != ""))
    wanted = F.filter(ready, lambda d: F.lower(null_to_blank(d["templateName"])).rlike("agenda|notice"))
    doc = F.coalesce(F.try_element_at(wanted, F.lit(1)), F.try_element_at(ready, F.lit(1)))
    when = F.trim(strip_controls("date"))
    title = F.trim(strip_controls("title"))
    named = both.select("_rank", doc.alias("d"), title.alias("title"), when.alias("date"), F.array_max(years_in(when, latest_year)).alias("year")).filter("d is not null and year is not null")
    ident = F.col("d.templateId").cast("string")
    out = named.select(
        "_rank", ident.alias("meeting_template_id"), F.concat(F.lit(f"{portal}/Portal/Meeting?meetingTemplateId="), ident).alias("meeting_url"),
        F.concat(F.lit(f"{portal}/Public/CompiledDocument?meetingTemplateId="), ident, F.lit("&compileOutputType="), F.col("d.compileOutputType").cast("string")).alias("compiled_document_url"),
        F.trim(F.concat_ws(" ", "title", "date")).alias("label"), normal_date("date").alias("meeting_date"), "year",
    ).filter(F.col("year").isin(*years))
    best = Window.partitionBy("meeting_template_id").orderBy(F.desc("_rank"), F.desc("label"))
    return out.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_rank").orderBy(F.desc("year"), F.desc("label"))


def reachable(starts: DataFrame, edges: DataFrame, most_depth: int, keep=lambda df: df, most_pages: int | None = None, most_documents: int | None = None) -> DataFrame:
    """Pages by breadth-first search: url, depth, referrer. `edges` has source and target; `keep` cuts each round's lineage.

    Documents (by URL) lead nowhere.  With caps, pages and documents count in order of depth, then URL.
    """
    seen = keep(starts.select(normal_url("url").alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer")).dropDuplicates(["url"]))
    seen = front = _capped(seen, None, most_pages, most_documents, keep)
    for depth in range(1, most_depth + 1):
        met = front.filter(~document_url("url")).join(edges, F.col("url") == edges["source"]).groupBy(normal_url("target").alias("url")).agg(F.min("source").alias("referrer"))
        front = keep(met.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "referrer"))
        front = _capped(front, seen, most_pages, most_documents, keep)
        if front.isEmpty():
            break
        seen = keep(seen.unionByName(front))
    return seen


def _capped(front: DataFrame, seen: DataFrame | None, most_pages: int | None, most_documents: int | None, keep) -> DataFrame:
    """The part of a front that the caps leave room for; the caps are the crawl's own."""
    if most_pages is None and most_documents is None:
        return front
    is_document = document_url("url")
    used = dict.fromkeys((False, True), 0)
    if seen is not None:
        used |= {r["d"]: r["n"] for r in seen.groupBy(is_document.alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for flag, most in ((False, most_pages), (True, most_documents)):
        part = front.filter(is_document if flag else ~is_document)
        parts.append(part if most is None else part.orderBy("url").limit(max(0, most - used[flag])))
    return keep(parts[0].unionByName(parts[1]))


def first_per_url(rows: DataFrame, url: Column | str, *order: Column | str) -> DataFrame:
    """The first entry of each URL."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(*order))).filter("_n = 1").drop("_n")
