"""Text, links and tables of HTML (survey S9, S19, S20, X8, X10)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, collapse, null_to_blank
from ..functions.web import joined_url, link_scheme, normal_url

ANCHOR = r'(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|\'([^\']*)\')[^>]*>(.*?)</a\s*>'
# Words of labels that lead to votes, and of URLs that lead to meetings.
VOTE_LABELS = ("minutes", "summary minutes", "action minutes", "results", "vote")
MEETING_TOKENS = ("meeting", "agenda", "minutes", ".pdf")
# Patterns of a consent item's row, its mark and its matter, of the table of attachments and its links.
ROW, CONSENT = r"(?is)<tr[^>]*>(.*?)</tr>", "Consent Calendar Item"
MATTER_LINK = r'(?i)href="([^"]*LegislationDetail\.aspx[^"]*)"[^>]*>([^<]+)</a>'
ATTACHMENTS, HREF = r'(?is)<table[^>]+id="ctl00_ContentPlaceHolder1_tblAttachments"[^>]*>(.*?)</table>', r'(?i)href="([^"]+)"'
# Headings of a meeting grid.
GRID = {"name": "body", "meeting date": "meeting_date", "meeting time": "meeting_time", "meeting location": "location"}
GRID_LINKS = {"meeting details": "meeting_url", "agenda": "agenda_url", "minutes": "minutes_url"}
# An ampersand that begins no reference with a semicolon.
OPEN_REFERENCE = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


def text_of(page: str | None, closed: bool = False) -> str:
    """Text nodes with more than white space, as they stand, one after another on lines of their own.

    Scripts and styles count as text; references are resolved in the nodes and once more in the whole.  Where `closed`
    is set, only references that a semicolon ends are: a page's text may be cut off within one.
    """
    page = page or ""
    mark = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in page) if closed else ""
    held = (lambda t: OPEN_REFERENCE.sub(mark, t)) if closed else str
    nodes: list[str] = []
    reader = HTMLParser()
    reader.handle_data = nodes.append
    reader.feed(held(page))
    text = unescape(held("\n".join(n for n in nodes if not n.isspace())))
    return text.replace(mark, "&") if closed else text


def html_text(html: Column | str, closed: bool = False) -> Column:
    """S9 as a column."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: text_of(page, closed))

    return run(html)


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Anchors of each page in order, with absolute URL and label; those that can't be fetched go."""
    source = null_to_blank(html)
    hits = F.regexp_extract_all(source, F.lit(ANCHOR), F.lit(0))
    each = pages.select(key, F.col(url).alias("_base"), F.posexplode(hits).alias("pos", "_a"))
    href = F.concat(F.regexp_extract("_a", ANCHOR, 1), F.regexp_extract("_a", ANCHOR, 2))
    label = collapse(F.regexp_replace(F.regexp_extract("_a", ANCHOR, 3), "<[^>]*>", " "))
    found = each.select(key, "pos", "_base", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"), label.alias("label")).filter(link_scheme("href"))
    return found.select(key, "pos", "href", joined_url("_base", "href").alias("url"), "label")


def _once(found: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key, "url").orderBy("pos")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def vote_links(found: DataFrame, key: str) -> DataFrame:
    """Links whose label speaks of minutes or votes, once for each page and URL."""
    hit = found.filter(any_of(F.lower("label").contains(w) for w in VOTE_LABELS))
    kind = F.when(F.lower("url").endswith(".pdf") | F.lower("url").contains("view.ashx"), "pdf").otherwise("html")
    return _once(hit, key).withColumn("kind", kind)


def meeting_links(found: DataFrame, key: str, most: int = 25) -> DataFrame:
    """The first `most` links of a page whose URL speaks of a meeting, then once each."""
    hit = found.filter(any_of(F.lower("url").contains(w) for w in MEETING_TOKENS))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).filter(F.col("_n") <= most).drop("_n")
    title = F.when(F.col("label") != "", F.col("label")).otherwise(F.element_at(F.split("url", "/"), -1))
    return _once(first, key).withColumn("meeting_title", title)


def consent_items(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """rows of consent items with the URL and number of their matter, once each."""
    marked = F.filter(F.regexp_extract_all(null_to_blank(html), F.lit(ROW), F.lit(1)), lambda r: r.contains(CONSENT))
    each = pages.select(key, F.col(url).alias("_base"), F.posexplode(marked).alias("pos", "_r")).filter(F.col("_r").rlike(MATTER_LINK))
    number = F.nullif(F.trim(F.regexp_extract("_r", MATTER_LINK, 2)), F.lit(""))
    found = each.select(key, "pos", _followed(F.regexp_extract("_r", MATTER_LINK, 1)).alias("url"), number.alias("matter_file"))
    return found.groupBy(key, "url", "matter_file").agg(F.min("pos").alias("pos"))


def attachment_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """links of a page's table of attachments, once each."""
    part = F.regexp_extract(null_to_blank(html), ATTACHMENTS, 1)
    each = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(part, F.lit(HREF), F.lit(1))).alias("pos", "_h"))
    return each.groupBy(key, _followed(F.col("_h")).alias("url")).agg(F.min("pos").alias("pos"))


def _followed(href: Column) -> Column:
    """Where an href leads from the page in _base."""
    return normal_url(joined_url("_base", F.replace(href, F.lit("&amp;"), F.lit("&"))))


def first_meetings(found: DataFrame, key: str, most_pages: int | None = None, most_meetings: int | None = None) -> DataFrame:
    """A grid's meetings (page_no, row_no) up to a number of pages and of meetings; None sets no limit."""
    some = found if not most_pages else found.filter(F.col("page_no") <= most_pages)
    if not most_meetings:
        return some
    place = F.row_number().over(Window.partitionBy(key).orderBy("page_no", "row_no"))
    return some.withColumn("_n", place).filter(F.col("_n") <= most_meetings).drop("_n")


class _Grid(HTMLParser):
    """Rows of a table: each a class and a list of (text, first link)."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[str, list[list]]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "tr":
            self.rows.append((named.get("class") or "", []))
        elif tag in ("td", "th") and self.rows:
            self.rows[-1][1].append([[], None])
            self.open = True
        elif tag == "a" and self.open and self.rows[-1][1] and named.get("href") and self.rows[-1][1][-1][1] is None:
            self.rows[-1][1][-1][1] = named["href"]

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = False

    def handle_data(self, data):
        if self.open and data.strip():
            self.rows[-1][1][-1][0].append(data)


_ROW = ["body", "meeting_date", "meeting_time", "location", "meeting_url", "agenda_url", "minutes_url"]


def grid_rows(html: str, base: str, positional: bool = False) -> list[dict]:
    """Data rows by the names of their columns; S20 (`positional`): rows of eight cells or more by place."""
    reader = _Grid()
    reader.feed(html or "")
    reader.close()
    plain = [(css.split(), [(" ".join(" ".join(t).replace(" ", " ").split()), a) for t, a in cells]) for css, cells in reader.rows]
    place: dict[str, int] = {}
    if positional:
        place = {"body": 0, "meeting_date": 1, "meeting_time": 3, "location": 4, "meeting_url": 5, "agenda_url": 6, "minutes_url": 7}
    else:
        for _, cells in plain:
            names = [t.lower() for t, _ in cells]
            if "minutes" in names and "meeting details" in names:
                place = {(GRID | GRID_LINKS)[n]: i for i, n in enumerate(names) if n in GRID or n in GRID_LINKS}
                break
    out = []
    for css, cells in plain:
        if not {"rgRow", "rgAltRow"} & set(css) or not cells or positional and len(cells) < 8:
            continue
        cell = lambda c: cells[place[c]] if place.get(c, len(cells)) < len(cells) else ("", None)  # noqa: B023, E731
        row = {c: cell(c)[0] for c in _ROW[:4]} | {c: urljoin(base, cell(c)[1]) if cell(c)[1] else None for c in _ROW[4:]}
        if not positional or row["meeting_url"]:
            out.append(row)
    return out


def meetings(grids: DataFrame, key: str, positional: bool = False) -> DataFrame:
    """Rows of meeting grids: `grids` has the key, `url` and `html`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *(r[c] for c in _ROW)) for k, u, h in frame.itertuples(index=False, name=None) for i, r in enumerate(grid_rows(h, u, positional))]
            yield pd.DataFrame(rows, columns=[key, "row_no", *_ROW])

    kind = dict(grids.dtypes)[key]
    return grids.select(key, "url", "html").mapInPandas(run, f"{key} {kind}, row_no int, " + ", ".join(f"{c} string" for c in _ROW))


def usable(text: Column) -> Column:
    """A text of at least 200 signs with at least 80 letters or digits."""
    flat = collapse(text)
    return (F.length(flat) >= 200) & (F.length(F.regexp_replace(flat, r"(?U)[^\p{Alnum}]", "")) >= 80)


def chosen_text(tries: DataFrame, key: str) -> DataFrame:
    """Of each document's texts (in order `attempt`) the first usable one, else the longest with anything, else the last error."""
    good = F.min_by("text", F.when(usable(F.col("text")), F.col("attempt")))
    longest = F.max_by("text", F.when(F.length(collapse("text")) > 0, F.struct(F.length("text"), -F.col("attempt"))))
    return tries.groupBy(key).agg(F.coalesce(good, longest).alias("text"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("attempt"))).alias("_e")).select(key, "text", F.when(F.col("text").isNull(), F.col("_e")).alias("error"))
