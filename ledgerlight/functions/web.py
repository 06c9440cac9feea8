"""URLs, dates, keys and file names as Column functions (survey P6, F19-F27, F32-F35)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, _c, collapse, null_to_blank

# File name endings and path parts of documents; date formats in order of trial.
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".txt", ".rtf")
DOCUMENT_PATHS = ("/document/", "/edoc/", "docview.aspx")
DATE_FORMATS = ("M/d/yyyy", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm", "MMMM d, yyyy", "MMM d, yyyy")
SKIPPED_WORDS = ("cancelled",)
# Names of a document's identifier and the URLs under which a portal serves it.
INDEX_NAMES = ("indexID", "indexId", "documentID", "documentId", "id")
DOWNLOAD_PATHS = (
    "/Home/DownloadDocument?indexID={id}",
    "/Home/DownloadDocument?id={id}",
    "/Home/DownloadDocument/{id}",
    "/Home/GetDocument?indexID={id}",
    "/Home/GetDocument?id={id}",
    "/Home/GetDocument/{id}",
    "/Home/ViewDocument?indexID={id}",
    "/Home/ViewDocument?id={id}",
    "/Home/DownloadForm?indexID={id}",
    "/Home/ViewForm?indexID={id}",
)


def years_in(x: Text, latest: int) -> Column:
    """years 2000..latest that stand alone among digits."""
    found = F.regexp_extract_all(null_to_blank(x), F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y <= latest)


def recent_enough(url: Text, least: int, latest: int) -> Column:
    """A URL without a year passes."""
    years = years_in(url, latest)
    return (F.size(years) == 0) | (F.array_max(years) >= least)


def host(url: Text) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(_c(url), F.lit("HOST")), F.lit("")))


def allowed_host(url: Text, hosts: Iterable[str]) -> Column:
    return host(url).isin(*[h.lower() for h in hosts])


def skipped_url(url: Text, words: Iterable[str] = SKIPPED_WORDS) -> Column:
    low = F.lower(null_to_blank(url))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def document_url(url: Text, fragments: Sequence[str] = DOCUMENT_PATHS) -> Column:
    """A file of a document type, or a path that serves documents."""
    path = F.lower(F.regexp_replace(null_to_blank(url), r"[?#].*$", ""))
    out = F.lit(False)
    for e in DOCUMENT_ENDINGS:
        out = out | path.endswith(e)
    for f in fragments:
        out = out | path.contains(f)
    return out


def html_type(content_type: Text) -> Column:
    return null_to_blank(content_type).rlike(r"^(text/html|application/xhtml\+xml)")


def strip_controls(x: Text) -> Column:
    """control and direction signs removed."""
    return F.regexp_replace(null_to_blank(x), r"[\p{Cc}\p{Cf}]", "")


def _escaped(x: Column, safe: str) -> Column:
    """Percent-escapes of the UTF-8 bytes of all signs but letters, digits and those in `safe`; `safe` is part of a pattern."""
    parts = F.regexp_extract_all(x, F.lit(rf"([A-Za-z0-9{safe}]+|[^A-Za-z0-9{safe}]+)"), F.lit(1))
    quoted = F.transform(parts, lambda p: F.when(p.rlike(rf"^[A-Za-z0-9{safe}]"), p).otherwise(F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")))
    return F.array_join(quoted, "")


def normal_url(x: Text) -> Column:
    """no fragment, single slashes in the path, path and query escaped but for the signs that may stand there."""
    plain = F.trim(F.regexp_replace(F.trim(strip_controls(x)), "#.*$", ""))
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?]*)?([^?]*)(\?.*)?$"
    scheme, host_part, path, query = (F.regexp_extract(plain, whole, i) for i in range(1, 5))
    single = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/+", "/")
    marks = r"/%:@!$&'()*+,;=\-._~"
    asked = F.when(F.length(query) > 1, F.concat(F.lit("?"), _escaped(F.substring(query, F.lit(2), F.length(query)), marks + "?"))).otherwise("")
    return F.concat(F.lower(scheme), host_part, _escaped(single, marks), asked)


def link_scheme(href: Text) -> Column:
    """whether an href leads anywhere that can be fetched."""
    return ~F.lower(F.trim(null_to_blank(href))).rlike("^(mailto:|tel:|javascript:|#|$)")


def joined_url(base: Text, href: Text) -> Column:
    """An href against its page, without dot segments."""
    b, h = null_to_blank(base), F.trim(null_to_blank(href))
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(F.regexp_replace(b, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(F.regexp_replace(b, r"[?#].*$", ""), h))
        .otherwise(F.concat(folder, h))
    )


def normal_date(x: Text) -> Column:
    """ISO day of an ISO text, of one of the formats, or of an ISO day inside; else the text."""
    raw = F.trim(null_to_blank(x))
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    tried = [F.date_format(F.try_to_timestamp(raw, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS]
    inside = F.regexp_extract(raw, r"(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.when(iso != "", iso), *tried, F.when(inside != "", inside), raw)


def date_field(x: Text) -> Column:
    """m/d/yyyy with an optional time, else a year, else the text."""
    text = collapse(x)
    day = F.regexp_extract(text, r"(?i)\b(\d{1,2}/\d{1,2}/\d{4}(?:\s+\d{1,2}:\d{2}\s+[AP]M)?)\b", 1)
    year = F.regexp_extract(text, r"\b(20\d{2}|19\d{2})\b", 1)
    return F.when(day != "", day).when(year != "", year).otherwise(text)


def portal_date(x: Text) -> Column:
    """an ISO time as m/d/yyyy h:mm AM."""
    raw = F.trim(null_to_blank(x))
    at = F.coalesce(F.try_to_timestamp(F.substring(F.replace(raw, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(at, "M/d/yyyy h:mm a"), raw)


def display_size(x: Text) -> Column:
    """bytes in the largest unit that leaves 1 or more, one decimal from KB on; null is Missing."""
    n, out = _c(x).cast("double"), None
    units = ("B", "KB", "MB", "GB", "TB")
    for i, unit in reversed(list(enumerate(units))):
        said = F.concat(F.call_function("format_number", n / 1024**i, F.lit("0.0" if i else "0")), F.lit(f" {unit}"))
        out = said if out is None else F.when(n < 1024 ** (i + 1), said).otherwise(out)
    return F.when(n.isNull(), "Missing").otherwise(out)


def years_list(text: str) -> list[int] | None:
    """years written with blanks or commas between them; none for an empty text."""
    words = text.replace(",", " ").split()
    if not all(w.removeprefix("-").isdigit() for w in words):
        raise ValueError("years must be whole numbers with blanks or commas between them")
    return [int(w) for w in words] or None


def slug(x: Text, size: int = 80) -> Column:
    """F26"""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(null_to_blank(x)), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, size)


def safe_name(x: Text, size: int = 180) -> Column:
    """F26"""
    return F.substring(F.regexp_replace(F.regexp_replace(null_to_blank(x), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, size)


def meeting_key(date: Text, body: Text, url: Text) -> Column:
    """from date, body and the URL's ID and GUID, or from the URL."""
    part = lambda k: F.coalesce(F.try_parse_url(_c(url), F.lit("QUERY"), F.lit(k)), F.lit(""))
    named = F.concat_ws("|", null_to_blank(date), null_to_blank(body), part("ID"), part("GUID"))
    source = F.when((part("ID") != "") | (part("GUID") != ""), named).otherwise(null_to_blank(url))
    return F.substring(F.sha1(source.cast("binary")), 1, 20)


def filing_key(*columns: Text) -> Column:
    """F27"""
    return F.substring(F.sha1(F.concat_ws("|", *(null_to_blank(c) for c in columns)).cast("binary")), 1, 24)


def document_path(site: Text, url: Text, extension: Text) -> Column:
    """Site, the stem of the URL's last part, a digest of the URL, an extension."""
    last = F.element_at(F.split(F.regexp_replace(null_to_blank(url), r"[?#].*$", ""), "/"), -1)
    stem = F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", "")
    stem = F.when(safe_name(stem) == "", "document").otherwise(safe_name(stem))
    return F.concat(safe_name(site), F.lit("/"), stem, F.lit("_"), F.substring(F.sha2(null_to_blank(url), 256), 1, 12), _c(extension))


def extension_for(content_type: Text) -> Column:
    """From the MIME type, .bin if it is unknown."""
    # Extensions of MIME types.
    known = {"application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt", "application/msword": ".doc", "application/json": ".json", "text/csv": ".csv"}
    low = F.trim(F.regexp_replace(F.lower(null_to_blank(content_type)), ";.*$", ""))
    out = F.lit(".bin")
    for mime, ext in known.items():
        out = F.when(low == mime, ext).otherwise(out)
    return out


def index_id(json: Text) -> Column:
    """F32: the first identifier of a search document under one of five names."""
    found = (F.nullif(F.trim(F.get_json_object(_c(json), f"$.{k}")), F.lit("")) for k in INDEX_NAMES)
    return F.coalesce(*found, F.lit(""))


def unwrapped_json(json: Text) -> Column:
    """F32: the payload inside d, result, data or value, also where it is a JSON text itself."""
    out = _c(json)
    for _ in range(2):
        inner = F.coalesce(*(F.get_json_object(out, f"$.{k}") for k in ("d", "result", "data", "value")))
        out = F.coalesce(inner, out)
    return out


def urls_in_json(json: Text) -> Column:
    """F32: every string that looks like a URL, wherever it stands."""
    found = F.regexp_extract_all(F.replace(null_to_blank(json), F.lit("\\/"), F.lit("/")), F.lit(r'"((?:https?://|/)[^"\s]+)"'), F.lit(1))
    return F.array_distinct(found)


def pdf_urls(text: Text) -> Column:
    """anchors that speak of a PDF or a download, bare PDF URLs and PDF attributes; once each, whatever the case."""
    t = null_to_blank(text)
    anchors = F.regexp_extract_all(t, F.lit(r'(?is)<a\b[^>]*href=["\']([^"\']+)["\'][^>]*>'), F.lit(1))
    labelled = F.regexp_extract_all(t, F.lit(r'(?is)<a\b[^>]*href=["\']([^"\']+)["\'][^>]*>(?=[^<]*(?:pdf|download))'), F.lit(1))
    named = F.filter(anchors, lambda u: F.lower(u).rlike("pdf|download"))
    bare = F.regexp_extract_all(t, F.lit(r"(?i)(https?://[^\s\"'<>]+?\.pdf[^\s\"'<>]*)"), F.lit(1))
    attributes = F.regexp_extract_all(t, F.lit(r'(?i)(?:href|src)=["\']([^"\']+?\.pdf[^"\']*)["\']'), F.lit(1))
    every = F.concat(named, labelled, bare, attributes)
    return F.filter(every, lambda u, i: F.array_position(F.transform(every, lambda v: F.lower(v)), F.lower(u)) == i + 1)


def download_urls(base: str, identifier: Text, templates: Sequence[str] = DOWNLOAD_PATHS) -> Column:
    """one URL for each template, `{id}` replaced; none without an identifier."""
    every = F.array(*(F.replace(F.lit(base + t), F.lit("{id}"), _c(identifier)) for t in templates))
    return F.when(F.length(null_to_blank(identifier)) > 0, every).otherwise(F.array().cast("array<string>"))


def download_request(identifier: Text, filer: Text, position: Text) -> Column:
    """the JSON body that asks for a filing; a middle name only if there is one."""
    f, p = _c(filer), _c(position)
    middle = collapse(f["middleName"])
    form = F.struct(
        collapse(f["lastName"]).alias("LastName"),
        collapse(f["firstName"]).alias("FirstName"),
        null_to_blank(p["filingYear"].cast("string")).alias("FilingYear"),
        collapse(p["agency"]).alias("Agency"),
        collapse(p["position"]).alias("Position"),
        collapse(p["filingType"]).alias("FilingType"),
        F.when(middle != "", middle).alias("MiddleName"),
    )
    return F.to_json(F.struct(_c(identifier).alias("indexID"), form.alias("formInfo")))
