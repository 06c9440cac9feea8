"""Votes from minutes text (survey X2, X3, X9, P15, W1, W2, A12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, collapse, contains_name, likely_vote_line, null_to_blank, person_canonical, split_names

# Entries that are no names, and phrases of lines that list none.
NOT_NAMES = ("none", "ne", "n e", "n/a", "na", "unknown", "present", "absent", "ayes", "aye", "no", "noes", "abstain", "abstained")
NAME_FRAGMENTS = ("approved", "recommended", "resolution", "ordinance", "notice", "exemption", "summary", "report", "attachment", "board action", "public comment")
LINE_PHRASES = (
    "approved as", "recommended", "resolution", "ordinance", "informational only", "board action", "department or agency", "summary report",
    "attachments", "attachment", "presenters", "speakers", "public comment", "moved by", "seconded by", "adopt a resolution", "adopt an ordinance",
)
# Line patterns.
MATTER = r"(?i)\b(File No\.?|File #|File)\s*([A-Z0-9\-]+)"
RESULT = r"(?i)\b(ADOPTED|FINALLY PASSED|HEARD AND FILED|CONTINUED|PASSED|APPROVED|FAILED)\b"
VOTE = r"(?i)^(Aye|Ayes|No|Noes|Absent|Abstain|Abstained)\s*[:\-]?\s*(.*)$"
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def name_list_line(x: Column) -> Column:
    """A line of letters and name signs, not too long, without a phrase that rules it out."""
    phrases = any_of(F.lower(x).contains(p) for p in LINE_PHRASES)
    return (x != "") & ~phrases & (F.length(x) <= 120) & x.rlike(r"^[A-Za-z.\-'\s,;&]+$")


def person_name(x: Column) -> Column:
    """Up to four capitalised words or initials, none of which is a vote word."""
    canonical = person_canonical(x)
    parts = F.filter(F.transform(F.split(collapse(x), " "), lambda p: F.regexp_replace(p, "^[,;]+|[,;]+$", "")), lambda p: p != "")
    word = lambda p: p.rlike(r"^[A-Z][a-zA-Z'\-]+$")
    each = F.forall(parts, lambda p: ~F.lower(p).isin(*NOT_NAMES) & (word(p) | (F.size(parts) > 1) & p.rlike(r"^[A-Z]\.$")))
    fragments = any_of(canonical.contains(f) for f in NAME_FRAGMENTS)
    return (canonical != "") & ~canonical.isin(*NOT_NAMES) & ~fragments & (F.size(F.split(canonical, " ")) <= 4) & (F.size(parts) > 0) & each


def bucket(word: Column) -> Column:
    low = F.lower(word)
    return F.when(low.isin("aye", "ayes"), "Ayes").when(low.isin("no", "noes"), "Noes").when(low.isin("abstain", "abstained"), "Abstain").otherwise("Absent")


def lines(minutes: DataFrame, key: str, text: str) -> DataFrame:
    """Non-blank lines of each text in order, white space collapsed."""
    each = minutes.select(key, F.posexplode(F.split(null_to_blank(text), LINE_ENDS)).alias("pos", "_raw"))
    return each.select(key, "pos", collapse("_raw").alias("line")).filter("line <> ''")


def vote_rows(minutes: DataFrame, key: str = "minutes_cache_key", text: str = "text") -> DataFrame:
    """Key, pos, matter_id, matter_title, result, vote_bucket, politician_name; order of names in name_pos.

    A vote label opens a segment, which goes on over lines that list names.  The matter is that of the label's
    line; the result is what holds when the segment ends.  A document's lines are ordered by windows, so no
    text is gathered.
    """
    at = Window.partitionBy(key).orderBy("pos")
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    matter, result = F.regexp_extract(line, MATTER, 2), F.upper(F.regexp_extract(line, RESULT, 1))
    marked = lines(minutes, key, text).select(
        key, "pos", "line",
        F.when(line.rlike(MATTER), matter).alias("m_id"), F.when(line.rlike(MATTER), line).alias("m_title"), F.when(result != "", result).alias("r"),
        F.when(line.rlike(VOTE), F.regexp_extract(line, VOTE, 1)).alias("label"), F.trim(F.regexp_extract(line, VOTE, 2)).alias("rest"), name_list_line(line).alias("listed"),
    )
    carried = marked.select(
        "*",
        F.last("m_id", True).over(so_far).alias("matter_id"), F.last("m_title", True).over(so_far).alias("matter_title"),
        F.coalesce(F.last("r", True).over(so_far), F.lit("")).alias("now"),
        (F.col("label").isNotNull() | F.col("m_id").isNotNull() | ~F.col("listed")).alias("breaks"),
    ).withColumn("seg", F.sum(F.col("breaks").cast("int")).over(so_far))
    before = carried.withColumn("earlier", F.coalesce(F.lag("now").over(at), F.lit("")))
    # each segment's head knows the result at the next head: after its line, or before it where that is a matter
    heads = before.filter("breaks").withColumn("held", F.when(F.col("m_id").isNotNull(), F.col("earlier")).otherwise(F.col("now")))
    heads = heads.withColumn("next_held", F.lead("held").over(at))
    final = before.groupBy(key).agg(F.max_by("now", "pos").alias("final"))
    opened = heads.filter("label is not null").join(final, key).select(key, "seg", F.col("pos").alias("head"), bucket(F.col("label")).alias("vote_bucket"), F.coalesce("matter_id", F.lit("")).alias("matter_id"), F.coalesce("matter_title", F.lit("")).alias("matter_title"), F.coalesce("next_held", "final").alias("result"))
    said = F.when(F.col("label").isNotNull(), F.when(name_list_line(F.col("rest")), F.col("rest"))).otherwise(F.col("line"))
    parts = before.select(key, "seg", "pos", said.alias("said")).filter("said is not null")
    joined = parts.join(opened, [key, "seg"]).groupBy(key, "head", "vote_bucket", "matter_id", "matter_title", "result").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("names"))
    each = joined.select("*", F.posexplode(F.split("names", ",|;| and ")).alias("name_pos", "_name")).withColumn("politician_name", F.trim("_name"))
    return each.filter(F.col("politician_name") != "").filter(person_name(F.col("politician_name"))).select(key, F.col("head").alias("pos"), "name_pos", "matter_id", "matter_title", "result", "vote_bucket", "politician_name")


def vote_block(text: Column) -> Column:
    """Names by label from the first vote block, or from the whole window where there is none."""
    block = F.regexp_extract(text, r"(?is)(?:VOTE:|Motion carried.*?)(.{0,500})", 1)
    source = F.when(text.rlike(r"(?is)VOTE:|Motion carried"), block).otherwise(text)
    return F.struct(*(split_names(F.regexp_extract(source, rf"(?i)\b{label.upper()}:\s*(.+?)(?:\n|$)", 1)).alias(label) for label in ("ayes", "noes", "abstain", "absent")))


def line_votes(texts: DataFrame, key: str, text: str, politician: str, confidence: float = 0.45) -> DataFrame:
    """Lines with a vote word that name the politician; one marker of a fixed order gives the label."""
    each = lines(texts, key, text).filter(likely_vote_line("line") & contains_name("line", F.lit(politician)))
    vote = F.lit("Unknown")
    # Markers with their labels; of several the last listed wins.
    for marker, label in (("recused", "Recused"), ("absent", "Absent"), ("abstain", "Abstain"), ("nay", "No"), ("no", "No"), ("yes", "Aye"), ("aye", "Aye")):
        vote = F.when(F.lower("line").contains(marker), label).otherwise(vote)
    return each.select(key, "pos", F.lit(politician).alias("member_name"), vote.alias("vote"), F.col("line").alias("snippet"), F.lit(confidence).alias("confidence"))
