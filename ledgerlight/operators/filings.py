"""Disclosure filings (survey X4, X5, P9, P11-P14, F28, F29, F33, A13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_key, any_of, collapse, first_nonblank, null_to_blank, strip_signs
from ..functions.web import download_request, download_urls, index_id, portal_date

# Labels of the form that are no entities, and keys that are none.
LABELS = (
    r"\bNAME\s+OF\s+BUSINESS\s+ENTITY\b", r"\bAME\s+OF\s+BUSINESS\s+ENTITY\b", r"\bNAME\s+OF\s+BUSINESS\s+ENTITY\s+OR\s+TRUST\b",
    r"\bNAME\s+OF\s+SOURCE\s+OF\s+INCOME\b", r"\bNAME\s+OF\s+LENDER\b", r"\bBUSINESS\s+ACTIVITY\b", r"\bIF\s+INVESTMENT\b",
    r"\bFILER.?S\s+VERIFICATION\b", r"\bVERIFICATION\b", r"\bSCHEDULE\b", r"\bFAIR\s+MARKET\s+VALUE\b", r"\bGROSS\s+INCOME\b",
    r"\bACQUIRED\b", r"\bDISPOSED\b", r"\bNATURE\s+OF\s+INVESTMENT\b", r"\bOFFICIAL\s+USE\s+ONLY\b", r"\bPUBLIC\s+DOCUMENT\b",
    r"\bCOUNTY\s+OF\s+DESCRIPTION\b", r"\bDATE\s+SIGNED\b", r"\bGENERAL\s+DESCRIPTION\b", r"\bPROPERTY\s+OWNERSHIP\s*/?\s*DEED\b",
    r"\bREPRESENTS\b", r"\bLEGISLATURE\b", r"\bFEDERAL\s+GOV\b", r"\bFOR\s+HOLDING\s+REAL\s+PROPERTY\b",
    r"\bINVESTMENT\s+HOLDING\s+COMPANY\b", r"\bSPOUSE\s+TITLE\b",
)
NOT_ENTITIES = ("", "arial narrow", "co owner", "commission", "general description", "non traded bdc", "of busine", "of real", "over", "personal", "president", "real", "signature")
NOT_CONTEXT = ("", "s", "s name", "s.", "title", "agency", "position", "first name", "middle name", "last name", "filing type", "filing year", "due date", "filed date")
EXCLUDED_SCHEDULES = ("D", "E")


def valid_entity(x: Column | str) -> Column:
    """P11"""
    text, key = collapse(x), alnum_key(x)
    labels = any_of(text.rlike(f"(?i){p}") for p in LABELS)
    return (F.length(key) >= 3) & ~key.isin(*NOT_ENTITIES) & (F.length(text) <= 180) & (F.size(F.split(text, " ")) <= 18) & ~text.rlike(r"(?U)^[\W\d_ ]+$") & ~labels


def context(x: Column | str) -> Column:
    """A form's own words as blanks."""
    text = collapse(x)
    own = alnum_key(x).isin(*NOT_CONTEXT) | text.rlike(r"(?i)\b(do not use acronyms|public document|official use only)\b")
    return F.when(own, "").otherwise(text)


def clean_entity(x: Column | str) -> Column:
    """F28"""
    text = F.regexp_replace(F.replace(collapse(x), F.lit("►"), F.lit("")), r"\{\s*0\s*\}", " ")
    text = F.regexp_replace(text, r"(?i)^(?:name of business entity or trust|name of business entity|name of lender|name of source of income)\s*[:\-]?\s*", "")
    return strip_signs(collapse(text), " -:;,()[]{}")


def agency_is(column: str, agency: str | None) -> Column:
    """Equal whatever the case; a blank wish passes all."""
    return F.lit(True) if not (agency or "").strip() else F.lower(collapse(column)) == agency.strip().lower()


#: A filing's payload as it is delivered, in JSON lines.
PAYLOADS = (
    "form700_cache_key string, payload struct<coverPage:struct<firstName:string,middleName:string,lastName:string,agencyName:string,position:string>,"
    "a1Investments:array<struct<name:string>>,a2Entities:array<struct<name:string,realPropertyNameOrAddress:string,realPropertyDescription:string,singleSourceNames:array<string>>>,"
    "bProperties:array<struct<parcelNumberOrAddress:string>>,cIncomes:array<struct<sourceName:string>>>"
)
# What each schedule's items are called.
KINDS = {"A1": "investment", "A2": "business_entity", "A2_property": "business_entity_property", "A2_source": "business_entity_source", "B": "real_property", "C": "income"}


def payload_rows(payloads: DataFrame, key: str = "form700_cache_key") -> DataFrame:
    """A row for each item of a payload's schedules, in order, with the owner from its cover page."""
    c = F.col("payload.coverPage")
    full = collapse(F.concat_ws(" ", c["firstName"], c["middleName"], c["lastName"]))
    owner = payloads.select(
        key, context(c["firstName"]).alias("owner_first_name"), context(c["middleName"]).alias("owner_middle_name"), context(c["lastName"]).alias("owner_last_name"), full.alias("owner_full_name"),
        context(c["agencyName"]).alias("filer_agency_name"), context(c["position"]).alias("filer_position_title"), "payload",
    )
    cover = [x for x in owner.columns if x != "payload"]

    def rows(array: str, schedule: str, kind: str, values: list[str], ord_: int, inner: str | None = None) -> DataFrame:
        each = owner.select(*cover, F.posexplode(f"payload.{array}").alias("i", "item"))
        if inner:
            each = each.select(*cover, "i", F.posexplode(f"item.{inner}").alias("j", "value"))
        else:
            each = each.select(*cover, "i", F.lit(0).alias("j"), first_nonblank([F.col(f"item.{v}") for v in values]).alias("value"))
        return each.select(*cover, F.lit(schedule).alias("schedule"), F.lit(KINDS[kind]).alias("record_type"), F.struct(F.lit(0 if ord_ == 0 else 1 if ord_ < 4 else ord_).alias("s"), "i", F.lit(ord_).alias("k"), "j").alias("ord"), F.col("value").alias("raw_value"))

    out = rows("a1Investments", "A-1", "A1", ["name"], 0)
    out = out.unionByName(rows("a2Entities", "A-2", "A2", ["name"], 1))
    out = out.unionByName(rows("a2Entities", "A-2", "A2_property", ["realPropertyNameOrAddress", "realPropertyDescription"], 2))
    out = out.unionByName(rows("a2Entities", "A-2", "A2_source", [], 3, "singleSourceNames"))
    out = out.unionByName(rows("bProperties", "B", "B", ["parcelNumberOrAddress"], 4))
    out = out.unionByName(rows("cIncomes", "C", "C", ["sourceName"], 5))
    return out.withColumn("entity_name", clean_entity("raw_value")).filter("entity_name <> ''")


def sanitized(rows: DataFrame, key: str = "form700_cache_key") -> DataFrame:
    """Schedules D and E, labels and owners' own names go; of equal (file, owner, type, entity) the first stays."""
    own = F.transform(F.array("owner_full_name", F.concat_ws(" ", "owner_first_name", "owner_last_name"), F.concat_ws(" ", "owner_last_name", "owner_first_name"), F.concat_ws(" ", "owner_first_name", "owner_middle_name", "owner_last_name"), F.concat_ws(" ", "owner_last_name", "owner_first_name", "owner_middle_name")), alnum_key)
    kept = rows.filter(~F.upper(F.trim(null_to_blank("schedule"))).isin(*EXCLUDED_SCHEDULES)).filter(valid_entity("entity_name")).filter(~F.array_contains(own, alnum_key("entity_name")))
    names = [c for c in rows.columns if c not in (key, "ord", "record_type")]
    grouped = kept.groupBy(key, alnum_key("owner_full_name").alias("_o"), "record_type", alnum_key("entity_name").alias("_e")).agg(F.min_by(F.struct(*names), "ord").alias("r"), F.min("ord").alias("ord"))
    return grouped.select(key, "record_type", "ord", "r.*")


def search_documents(responses: DataFrame, base: str) -> DataFrame:
    """search responses (column `document`, JSON) with their first position's metadata and download URLs."""
    d = F.col("document")
    at = lambda path: collapse(F.get_json_object(d, f"$.{path}"))
    identifier = index_id(d)
    position = F.struct(*(at(f"filingPositions[0].{n}").alias(n) for n in ("filingYear", "agency", "position", "filingType")))
    filer = F.struct(*(at(f"filer.{n}").alias(n) for n in ("lastName", "firstName", "middleName")))
    return responses.select(
        identifier.alias("index_id"), at("filer.lastName").alias("filer_last_name"), at("filer.firstName").alias("filer_first_name"), at("filer.middleName").alias("filer_middle_name"),
        collapse(F.concat_ws(" ", at("filer.firstName"), at("filer.middleName"), at("filer.lastName"))).alias("filer_full_name"),
        at("filingPositions[0].agency").alias("agency_name"), at("filingPositions[0].position").alias("position_title"), at("filingPositions[0].filingYear").alias("filing_year"), at("filingPositions[0].filingType").alias("filing_type"),
        portal_date(at("filingInfo.dueDate")).alias("due_date"), portal_date(at("filingInfo.filedDate")).alias("filed_date"),
        download_urls(base, identifier).alias("alternate_urls"), download_request(identifier, filer, position).alias("download_request"),
    ).filter("index_id <> ''").dropDuplicates(["index_id"])


def normal_filings(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """each wanted column from the first of its aliases that has a value."""
    have = {c.lower(): c for c in df.columns}
    return df.select("*", *(first_nonblank([F.col(f"`{have[a.lower()]}`") for a in names if a.lower() in have] or [F.lit("")]).alias(want) for want, names in aliases.items() if want not in df.columns))


def run_statistics(filings: DataFrame) -> DataFrame:
    """A13"""
    status = F.col("parse_status")
    return filings.agg(F.countDistinct(F.nullif(collapse("filer_full_name"), F.lit(""))).alias("filers"), F.count("*").alias("filings"), F.count_if(status.isin("downloaded", "parsed")).alias("downloads"), F.count_if(status == "parsed").alias("parses"), F.count_if(F.col("first_seen_at") == F.col("last_seen_at")).alias("new"))
