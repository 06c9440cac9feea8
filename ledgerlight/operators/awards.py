"""Contract awards from agenda text (survey X1, X7, F11-F19, P16, W3-W5).

Only the search itself, which needs match offsets, runs in Arrow batches; names,
identifiers, votes and the suppression of overlaps are columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEGAL_WRITTEN, any_of, null_to_blank, split_companies, strip_signs, tidy_lines
from .clean import keep_longest
from .lineage import settled
from .matching import less_complete
from .votes import vote_block

# Phrases that announce an award, in order of precedence; the number is the pattern's name.
AWARDS = (
    r"\bAward a construction contract to\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAward a contract to\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAward the contract to\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAward a purchase order contract to\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bPurchase order contract to\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAward the construction contract for\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAward the contract for\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAccepting bids and awarding a contract(?:\s+to\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the City Manager to execute a construction contract(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the City Manager(?: and Clerk of the Council)? to execute an agreement with\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAuthorize the General Manager to execute (?:a|an)\s+.+?\s+agreement(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the General Manager to execute (?:a|an)\s+.+?\s+contract(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the Director to execute (?:a|an)\s+.+?\s+agreement(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the Director to execute (?:a|an)\s+.+?\s+contract(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bAuthorize the Chair to execute (?:a|an)\s+.+?\s+agreement(?:\s+with\s+(?P<company>.+?))?(?:,|\.|\n)",
    r"\bApprove Agreement\s+with(?!\s+the\s+following\b)\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bApprove Agreements\s+with(?!\s+the\s+following\b)\s+(?P<company>.+?)(?:\.|\n)",
    r"\b(?:[A-Za-z0-9()/-]+\s+){0,6}Agreements?\s+with\s+the\s+following\b[^:\n]{0,120}:\s+(?P<company>.+?)(?=\nDepartment or Agency Name|\n\d+\.\s|$)",
    r"\bAgreement with(?!\s+the\s+following\b)\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bAgreements with(?!\s+the\s+following\b)\s+(?P<company>.+?)(?:\.|\n)",
    r"\bProfessional Service Agreement with\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bService Agreement with\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bPurchase order contract with\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bApprove (?:a|an)\s+.+?\s+agreement with\s+(?P<company>.+?)(?:,|\.|\n)",
    r"\bApprove (?:a|an)\s+.+?\s+contract with\s+(?P<company>.+?)(?:,|\.|\n)",
)
#: Which of them name several companies, and which announce a list.
SEVERAL, LISTED = (16, 19), (17,)
# Phrases around an award that speak against a new one.
NEGATIVE = r"(?i)\bamend(?:ment)? to (?:the )?agreement\b|\brenewal\b|\bextension\b|\bchange order\b|\bfirst amendment\b|\bsecond amendment\b|\bpersonal services agreement\b|\breject all bids\b"
# Single words that are companies, and that are none.
ONE_WORD = (
    "advocates", "caltrans", "carollo", "cynet", "docupet", "equitable", "governmentjobs", "homeaway", "hope", "horne", "iem",
    "interfaith", "ksvy", "landpaths", "maxim", "mission", "parcelquest", "placeworks", "proterra", "reach", "rxbenefits", "zetron",
)
NOT_ONE_WORD = (
    "bertrand", "burke", "dr", "eastern", "evelyn", "face", "first", "four", "gigi", "harris", "hooper", "john", "lee", "local",
    "neighboring", "other", "per", "progress", "requesting", "robbins", "santa", "solano", "st", "sultana", "the", "three",
)
# Beginnings and parts of names that rule them out.
BAD_BEGINNINGS = (
    "the ihcp", "the california", "the commission", "the county", "the board", "the city of", "the state of", "department of",
    "the district", "the proposed", "in substantially", "in a form", "the following entities:", "the following grantees:",
)
BAD_PARTS = ("city", "college", "university", "department of", "district", "county", "to ensure that", "for administration and distribution", "tax proceeds", "claim is processed")
# Legal forms as they follow a name.
FORM = r"Inc\.?|L\.L\.C\.?|LLC|Corp\.?|Corporation|Co\.?|Company|Ltd\.?|L\.P\.?|LP|L\.L\.P\.?|LLP|PLLC\.?"
# Item identifiers by site, a matter's file number, an agenda file's name, section headings.
ITEM = {"santa_ana": r"(?i)\b(?:\d{1,2}[A-Z]|AGMT\.?\s*NO\.?\s*\d{4}-\d+)\b", "": r"\b\d{1,2}\.\d{1,2}\b"}
FILE_NUMBER = r"(?i)\b(?:File\s*#|File\s*No\.?|Matter\s*File)\s*:?\s*([A-Z0-9]+-\d+)\b"
TRACKER = r"(?i)(\d{3,5})_A_.*?_(\d{2})-\d{2}-\d{2}_BOS_Agenda"
SECTIONS, NEXT_SECTIONS = ("Title:", "Recommended Action:"), ("Executive Summary:", "Discussion:", "Fiscal Summary", "Attachments:", "Summary Report", "end")
COUNTY, PAGE, DOCUMENT = "sonoma", "legislation_page", "document"
HELD = "~"  # stands for a full stop inside an abbreviation
EDGES = " ,.;:-"


def protect(x: Column) -> Column:
    """full stops of abbreviations don't end a name."""
    # each stop of two or more single letters in a row, then one before a capitalised word
    runs = F.regexp_replace(x, r"(?<=\b[A-Za-z])\.(?=[A-Za-z]\.)|(?<=\b[A-Za-z][.~][A-Za-z])\.", HELD)
    return F.regexp_replace(runs, r"\b([A-Za-z])\.(?=\s+[A-Z])", f"$1{HELD}")


def sections(x: Column) -> Column:
    """title and recommended action, each up to the next heading; the whole text where neither stands."""

    def part(label: str) -> Column:
        rest = F.substring(x, F.locate(label, x), F.length(x))
        ends = [F.when(F.locate(h, rest) > len(label) + 1, F.locate(h, rest) - 1) for h in NEXT_SECTIONS]
        return F.when(F.locate(label, x) > 0, F.substring(rest, F.lit(1), F.coalesce(F.least(*ends), F.length(rest))))

    both = F.concat_ws("\n", *map(part, SECTIONS))
    return F.when(both == "", x).otherwise(both)


def clean_company(x: Column) -> Column:
    """F14"""
    tidy = lambda c: strip_signs(c, EDGES)
    out = tidy(F.regexp_replace(F.replace(null_to_blank(x), F.lit(HELD), F.lit(".")), r"\s+", " "))
    for pattern, new in (
        (rf"(?i)\b({FORM}),\s+in\b.*$", "$1"),
        (r"(?i)\b(?:to|for)\b.*$", ""),
        (r"(?i)\b(?:for a term|subject to|in an amount|which includes|beginning on|for the period).*$", ""),
        (r"(?i)\s*\(Property No.*$", ""),
        (r"(?i)\s+with a contract amount.*$", ""),
    ):
        out = tidy(F.regexp_replace(out, pattern, new))
    return out


def rejected(x: Column) -> Column:
    """P16"""
    low = F.lower(F.trim(x))
    core = F.regexp_replace(low, r"\.+$", "")
    single = ~core.rlike(r"\S\s+\S")
    bad = (core == "in") | core.isin(*{w.rstrip(".") for w in LEGAL_WRITTEN}) | any_of(low.startswith(b) for b in BAD_BEGINNINGS) | any_of(low.contains(p) for p in BAD_PARTS)
    return F.when(single & core.isin(*ONE_WORD), False).when(single & core.isin(*NOT_ONE_WORD), True).otherwise(bad)


def listed_companies(x: Column) -> Column:
    """The companies of a list, without amounts, purposes and remarks."""
    cut = r"(?is)(?:,?\s+to\s+provide\b[\s\S]*|,?\s+for\s+(?:a|an|the)\b[\s\S]*|,?\s+for\s+[A-Za-z][\s\S]*|,?\s+with\s+an\s+option\b[\s\S]*)$"
    flat = F.trim(F.regexp_replace(F.replace(null_to_blank(x), F.lit(HELD), F.lit(".")), cut, ""))
    entries = F.flatten(F.transform(F.split(flat, r"\s*;\s*"), lambda e: F.split(e, r"(?i),\s+and\s+", 2)))

    def plain(e: Column) -> Column:
        for pattern in (r"(?i)^\s*and\s+", r"(?is)\s+to\s+provide\b[\s\S]*$", r"\([^)]*\)", r",\s*\$\s*[\d,]+(?:\.\d{2})?\s*\.?$", r"\s+\$\s*[\d,]+(?:\.\d{2})?\s*\.?$"):
            e = F.trim(F.regexp_replace(F.trim(e), pattern, ""))
        return e

    named = F.filter(F.transform(entries, plain), lambda e: e.rlike("[A-Za-z]") & ~e.rlike(r"(?i)^(?:\d|per\b|through\b|during\b|effective\b|option\b|term\b|up\b)"))
    return F.filter(F.transform(named, clean_company), lambda c: c.rlike("[A-Za-z]") & ~rejected(c))


def companies(raw: Column, one: Column, pattern_no: Column) -> Column:
    """The names that a match gives; none if it gives only rejected ones. `one` is the cleaned match."""
    parts = F.filter(F.transform(split_companies(F.regexp_replace(one, r"(?i)\s+(?:and|&)\s+", ", ")), clean_company), lambda c: (c != "") & ~rejected(c))
    whole = F.when((one == "") | rejected(one), F.array().cast("array<string>")).otherwise(F.array(one))
    return F.when(pattern_no.isin(*LISTED), listed_companies(raw)).when(pattern_no.isin(*SEVERAL) & (F.size(parts) > 0), parts).otherwise(whole)


_FOUND = [re.compile(p, re.IGNORECASE | re.DOTALL) for p in AWARDS]
#: What a text must hold for a pattern to match: its beginning, where that is plain.
_NEEDED = [m[1].casefold() if (m := re.match(r"\\b([A-Za-z ]+)", p)) else "agreement" for p in AWARDS]
#: Words of which every pattern has one.
ANY_AWARD = "(?i)contract|agreement"


def _continued(text: str, raw: str, end: int) -> str:
    """A name that goes on behind its match: very short ones over the next pieces, wrapped ones over the next line, and a legal form."""
    name, rest = raw, text[end : end + 200]
    if len(re.findall(r"\w", name)) < 3 and rest.startswith("\n"):
        name = name.strip()
        for piece in re.findall(r"\s+([^,.\n]+)", rest):
            name = f"{name} {piece.strip()}".strip()
            if len(re.findall(r"\w", name)) >= 3:
                break
    if rest.startswith("\n"):
        line = rest[:120].lstrip("\n").partition("\n")[0].strip()
        if re.fullmatch(r"[A-Z][A-Za-z&'().,/\- ]+", line) and not re.match(r"[A-Z]\)", line):
            name = f"{name.rstrip()} {line}".strip()
    if (form := re.match(rf"\s*,\s*({FORM})\b", rest[:20], re.IGNORECASE)) and form[1].lower() in LEGAL_WRITTEN:
        name = f"{name}, {form[1]}"
    return name


def _snippet(text: str, start: int, end: int) -> str:
    """the lines around a match, from the first "to" or "for" on."""
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    line = text[a : b if b >= 0 else len(text)].strip()
    lead = re.search(r"\b(to|for)\b", line, re.IGNORECASE)
    return re.sub(r"\s+", " ", line[lead.start() :] if lead else line).strip()[:400]


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text in zip(frame["doc_key"], frame["searched"], strict=True):
            seq, folded = 0, text.casefold()
            for number, pattern in enumerate(_FOUND):
                for m in pattern.finditer(text) if _NEEDED[number] in folded else ():
                    if m["company"]:
                        a, b = m.span()
                        rows.append((doc, seq, number, a, b, _continued(text, m["company"], m.end("company")), _snippet(text, a, b), text[max(0, a - 800) : b + 1200], text[max(0, a - 600) : a + 200]))
                        seq += 1
        yield pd.DataFrame(rows, columns=["doc_key", "seq", "pattern_no", "start", "end", "raw_company", "snippet", "window", "near"])


def merged_id(a: Column, b: Column) -> Column:
    """F18"""
    return F.when(F.coalesce(b, F.lit("")) == "", a).when(a.isNull(), b).when(F.lower(a).contains(F.lower(b)), a).otherwise(F.concat_ws(" | ", a, b))


def tracker(path: Column, url: Column) -> Column:
    """from the file's name, else the URL's."""
    names = [F.regexp_extract(null_to_blank(x), r"([^/\\?#]*)(?:[?#].*)?$", 1) for x in (path, url)]
    return F.coalesce(*(F.when(n.rlike(TRACKER), F.concat(F.lit("20"), F.regexp_extract(n, TRACKER, 2), F.lit("-"), F.regexp_extract(n, TRACKER, 1))) for n in names))


def candidates(docs: DataFrame) -> DataFrame:
    """X1 for each document by itself: docs has doc_key, site, source_kind, source_path, source_url, text."""
    tidy = docs.withColumn("text", tidy_lines("text"))
    county_page = (F.col("site") == COUNTY) & (F.col("source_kind") == PAGE)
    searched = protect(F.when(county_page, sections(F.col("text"))).otherwise(F.col("text")))
    found = tidy.filter(F.col("text").rlike(ANY_AWARD)).select("doc_key", searched.alias("searched")).mapInPandas(_search, "doc_key string, seq int, pattern_no int, start int, end int, raw_company string, snippet string, window string, near string")
    meta = tidy.select(
        "doc_key", "site", "source_path", "source_url",
        F.when(county_page, F.upper(F.regexp_extract("text", FILE_NUMBER, 1))).alias("file_number"),
        F.when((F.col("site") == COUNTY) & (F.col("source_kind") == DOCUMENT), tracker(F.col("source_path"), F.col("source_url"))).alias("tracker"),
    )
    item = lambda site: F.trim(F.try_element_at(F.regexp_extract_all("near", F.lit(ITEM[site]), F.lit(0)), F.lit(-1)))
    near = F.when(F.col("site") == "santa_ana", item("santa_ana")).otherwise(item(""))
    each = (
        found.join(meta, "doc_key")
        .withColumn("item_id", merged_id(merged_id(near, F.col("file_number")), F.col("tracker")))
        .withColumn("votes", vote_block(F.col("window")))
        .withColumn("has_negative_context", F.col("window").rlike(NEGATIVE))
        .withColumn("cleaned", clean_company(F.col("raw_company")))
        .withColumn("names", companies(F.col("raw_company"), F.col("cleaned"), F.col("pattern_no")))
        .select("*", F.posexplode("names").alias("name_no", "company_name"))
    )
    return suppressed(each).select(
        "doc_key", F.when(F.col("site") == "santa_ana", "Santa Ana").otherwise("Sonoma").alias("city"), "site", "source_path", "source_url", "pattern_no", "seq", "name_no", "item_id", "company_name", "snippet", "has_negative_context",
        F.col("votes.ayes").alias("vote_ayes"), F.col("votes.noes").alias("vote_noes"), F.col("votes.abstain").alias("vote_abstain"), F.col("votes.absent").alias("vote_absent"),
    )


def suppressed(matches: DataFrame) -> DataFrame:
    """In order, a match of a company goes that lies within 120 signs of a kept one of the same company and document."""
    carried = [c for c in matches.columns if c not in ("doc_key", "company_name", "seq", "name_no", "window", "near", "names")]
    # matches of one company in one document: bounded by the document
    rows = matches.groupBy("doc_key", "company_name").agg(F.array_sort(F.collect_list(F.struct("seq", "name_no", *carried))).alias("m"))
    clear = lambda i, j: (F.col("m")[j]["start"] > F.col("m")[i]["end"] + 120) | (F.col("m")[j]["end"] < F.col("m")[i]["start"] - 120)
    kept = F.aggregate(
        F.sequence(F.lit(0), F.size("m") - 1), F.array().cast("array<int>"),
        lambda done, j: F.when(F.forall(done, lambda i: clear(i, j)), F.concat(done, F.array(j))).otherwise(done),
    )
    return rows.select("doc_key", "company_name", F.explode(F.transform(kept, lambda i: F.col("m")[i])).alias("x")).select("doc_key", "company_name", "x.*")


def awards(docs: DataFrame) -> DataFrame:
    """Candidates of all documents, longest snippets, without less complete names."""
    found = settled(candidates(docs)).withColumn("ord", F.struct("doc_key", "seq", "name_no")).withColumn("_c", F.lower("company_name"))
    best = keep_longest(found, ["source_url", "item_id", "_c"], "snippet", "ord").drop("_c").withColumn("row", F.to_json("ord"))
    return best.join(less_complete(best, "row", ["source_url", "item_id"], "company_name"), "row", "left_anti").drop("row")
