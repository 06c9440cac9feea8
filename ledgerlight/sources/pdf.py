"""Text of PDF files, by the readers that are installed and a plain one of our own (survey S10, S11)."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.html import chosen_text

_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_SHOWN = re.compile(rb"(\[(?:[^\]\\(]|\\.|\((?:[^()\\]|\\.)*\))*\]\s*TJ)|(\((?:[^()\\]|\\.)*\)\s*(?:Tj|'|\"))|(T\*|Td|TD|ET)", re.DOTALL)
_PIECE = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|(-?\d+(?:\.\d+)?)", re.DOTALL)
# Escapes of the format's strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> str:
    plain = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), raw, flags=re.DOTALL)
    return plain.decode("utf-16") if plain.startswith((b"\xfe\xff", b"\xff\xfe")) else plain.decode("cp1252", "replace")


def plain_text(content: bytes) -> str:
    """Strings shown by the content streams, a line for each line move; fonts with their own codes aren't decoded."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF file")
    out = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        for array, single, _ in _SHOWN.findall(body):
            if array:
                out += [_string(s) if not gap else " " if float(gap) < -200 else "" for s, gap in _PIECE.findall(array)]
            elif single:
                out.append(_string(_PIECE.match(single)[1]))
            else:
                out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


def _pypdf(content: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def _mupdf(content: bytes) -> str:
    import fitz

    return "\n".join(page.get_text("text") for page in fitz.open(stream=content, filetype="pdf"))


#: In order of trial; those whose library is missing give an error, which the choice passes over.
READERS = (_pypdf, _mupdf, plain_text)


def tries(documents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """For each document the text or error of each reader, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, raw in frame.itertuples(index=False, name=None):
                for i, reader in enumerate(READERS):
                    try:
                        rows.append((k, i, reader(bytes(raw or b"")), None))
                    except Exception as e:  # a broken file or a missing library: the next reader is tried
                        rows.append((k, i, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "attempt", "text", "error"])

    return documents.select(key, content).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, attempt int, text string, error string")


def texts(documents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The key, the chosen text, and the last error where there is none."""
    return chosen_text(tries(documents, key, content), key)


def cached(documents: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """cache_key and text of all documents (url, content); only those that the cache lacks are read."""
    keyed = documents.withColumn("cache_key", F.sha1(F.col(url).cast("binary")))
    new = keyed.join(cache, "cache_key", "left_anti")
    return cache.select("cache_key", "text").join(keyed.select("cache_key").distinct(), "cache_key", "left_semi").unionByName(texts(new, "cache_key").select("cache_key", "text"))
