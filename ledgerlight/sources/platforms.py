"""Platforms that meetings are published on: what each needs to find meetings and votes (survey Q4)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import html, votes


@dataclass(frozen=True)
class Platform:
    """`detects`: whether a page's URL or HTML belongs to it; `meetings`: pages (key, url, html) to meetings;
    `votes`: texts (key, text) and a politician to vote rows."""

    name: str
    detects: Callable[[Column, Column], Column]
    meetings: Callable[[DataFrame, str], DataFrame]
    votes: Callable[[DataFrame, str, str], DataFrame]


_KNOWN: dict[str, Platform] = {}


def register(platform: Platform) -> Platform:
    """A platform of the same name is replaced; those registered last are tried first."""
    _KNOWN.pop(platform.name, None)
    _KNOWN[platform.name] = platform
    return platform


def known() -> tuple[Platform, ...]:
    return tuple(reversed(_KNOWN.values()))


def named(name: str) -> Platform:
    if name not in _KNOWN:
        raise KeyError(f"no platform {name!r}; there are {', '.join(_KNOWN)}")
    return _KNOWN[name]


def detected(url: str, page: str) -> Column:
    """The name of the first platform that a page belongs to."""
    out = None
    for p in _KNOWN.values():  # the last registered ends up outermost
        hit = p.detects(F.lower(F.coalesce(F.col(url), F.lit(""))), F.lower(F.coalesce(F.col(page), F.lit(""))))
        out = F.when(hit, p.name) if out is None else F.when(hit, p.name).otherwise(out)
    return F.lit(None).cast("string") if out is None else out


def meetings(pages: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each platform's meetings, of the pages that belong to it."""
    marked = pages.withColumn("_platform", detected("url", "html"))
    return {p.name: p.meetings(marked.filter(F.col("_platform") == p.name).drop("_platform"), key) for p in known()}


register(Platform("generic", lambda url, page: F.lit(True), lambda pages, key: html.meeting_links(html.links(pages, key, "url", "html"), key), lambda texts, key, who: votes.line_votes(texts, key, "text", who)))
register(Platform("legistar", lambda url, page: url.contains("legistar") | page.contains("legistar"), lambda pages, key: html.meetings(pages, key), lambda texts, key, who: votes.line_votes(texts, key, "text", who)))
