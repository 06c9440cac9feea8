"""WARC archives, index first.

Every record's length follows from small columns (payload size, URL, type), so
the index (archive, offset, length, URL, digest) is computed and written before
any archive exists.  There are as many archives as ARCHIVE_BYTES asks for, and
no fewer than the engine has shuffle partitions.  They are then written by the
engine's own text writer, one record a row, with the record separator as line
separator: a lost executor's archives are written again and committed once, on
any file system.  Records are dealt by page, URL and size, so rows that share
a page_id or have none spread; pages with one payload meet their response by
salted sums.
Reading takes selected index rows, sorts them by place, joins byte ranges that
lie close together into one read each, and checks URL, length and digest.

Nulls: a null html is an empty payload, a null url an empty URL.  Rows that
repeat a page_id are records of their own; of equal payloads those with the
smallest page_id are responses, all others revisit it.  A null page_id sorts
last and is never referred to unless all are null.  An empty table writes
nothing and returns an empty table.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop, folder, releasing, written

CRLF = "\r\n"
END = CRLF * 2
DATE = "2000-01-01T00:00:00Z"
NAME = "urn:x-page:"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ranges closer than this are read at once, up to so many bytes.
GAP, READ = 1 << 16, 8 << 20
#: Archives are written in so many waves, so that only a part of the payloads is in shuffle files at once.
WAVES = 2
#: Bytes of an archive, about.
ARCHIVE_BYTES = 256 << 20
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight groups of 20 bits, four signs each."""
    digest = F.sha1(payload)
    signs = []
    for group in range(8):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        for k in (15, 10, 5, 0):
            signs.append(F.lit(ALPHABET).substr(F.shiftright(bits, k).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*signs)


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(END))


def _head(kind: Column, page: Column, url: Column, digest: Column, refers: Column, size: Column) -> Column:
    """Everything of a record before its payload."""
    http = _http(size)
    revisit = kind == "revisit"
    name = lambda x: F.concat(F.lit(f"<{NAME}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: "), kind,
        F.lit(f"{CRLF}WARC-Record-ID: "), name(page),
        F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name(refers))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string"),
        F.lit(END), http,
    )


def _rows(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))


def _number(archives: int) -> Column:
    """The archive of a record, by a hash of page, URL and size, which cost no digest."""
    return F.pmod(F.hash("key"), F.lit(archives))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("page_id", "url", "size"))


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row for each record, in small columns only: what it is, and its length."""
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(pages).select("page_id", "url", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")))
    # the pages of one payload are summed up by salt, then their few sums meet
    some = rows.groupBy("digest", "size", "salt").agg(F.min("page_id").alias("first"))
    first = some.withColumn("first", F.min("first").over(Window.partitionBy("digest", "size")))
    typed = rows.join(first, ["digest", "size", "salt"]).withColumn("kind", F.when((F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    typed = typed.withColumn("refers_to", F.when(F.col("kind") == "revisit", F.col("first"))).drop("first", "salt")
    head = _head(F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("refers_to"), F.col("size"))
    length = F.octet_length(head) + F.when(F.col("kind") == "revisit", 0).otherwise(F.col("size")) + len(END)
    return _keyed(typed.withColumn("length", length.cast("long")))


def placed(planned: DataFrame, archives: int) -> DataFrame:
    """The index: the planned records with archive and offset."""
    before = Window.partitionBy("archive").orderBy("page_id", "digest", "url").rowsBetween(Window.unboundedPreceding, -1)
    dealt = planned.withColumn("archive", _number(archives))
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def write(pages: DataFrame, index: DataFrame, path: str, archives: int) -> None:
    """Writes the archives that the index describes; moves every payload once."""
    known = index.select("key", F.col("digest").alias("of"), "refers_to", "kind")
    # both sides are dealt by the same number of the same hash as the archives, so the join keeps each archive in one task
    number = _number(archives)
    all_rows = _keyed(_rows(pages).withColumn("size", F.octet_length("html").cast("long"))).drop("size")
    for wave in range(WAVES):
        now = all_rows.filter(number % WAVES == wave).withColumn("digest", base32_sha1(F.col("html"))).repartition(archives, "key")
        both = now.join(known.filter(number % WAVES == wave).repartition(archives, "key").distinct().hint("merge"), "key")
        # rows that share a key are told apart by digest; by order, since one more equality would deal both sides anew
        with releasing(pages.sparkSession):
            _write_wave(both.filter((F.col("of") >= F.col("digest")) & (F.col("of") <= F.col("digest"))), number, path)


def _write_wave(both: DataFrame, number: Column, path: str) -> None:
    head = _head(F.col("kind"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("refers_to"), F.octet_length("html"))
    record = F.concat(head, F.when(F.col("kind") == "revisit", "").otherwise(F.col("html")))
    out = both.select(record.alias("value"), number.alias("archive"), "page_id", "digest", "url")
    ordered = out.sortWithinPartitions("archive", "page_id", "digest", "url").select("value", "archive")
    ordered.write.mode("append").option("lineSep", END).partitionBy("archive").text(path)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of each archive; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return found.select("path", F.col("length").alias("file_length"), F.regexp_extract("path", r"archive=(\d+)", 1).cast("int").alias("archive"))


def _open(path: str):
    from pyarrow import fs

    if ":/" in path and "://" not in path:
        path = path.replace(":/", ":///", 1)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _parse(record: memoryview, url: str, digest: str) -> tuple:
    raw = bytes(record)
    head, _, block = raw.partition(END.encode())
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(END.encode())
    size = int(http.rpartition(b"Content-Length: ")[2])
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else named
    if fields["WARC-Target-URI"] != url or not named == found == digest or kind == "response" and len(payload) != size or raw[-len(END) :] != END.encode():
        raise ValueError(f"record of {url} doesn't match the index")
    number = lambda s: int(s) if (s := s.removeprefix(f"<{NAME}").removesuffix(">")) else None
    return number(fields["WARC-Record-ID"]), size, named, kind, number(fields["WARC-Refers-To"]) if kind == "revisit" else None, payload


def read(selected: DataFrame, files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the selected index rows, by coalesced byte-range reads."""
    places = selected.join(files.select("archive", "path"), "archive").select("path", "offset", "length", "url", "digest")
    ordered = places.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "url", "digest")), strict=True))
                i = 0
                while i < len(rows):
                    path, begin = rows[i][:2]
                    end, j = begin, i
                    while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= GAP and (j == i or rows[j][1] + rows[j][2] - begin <= READ):
                        end, j = rows[j][1] + rows[j][2], j + 1
                    if opened != path:
                        if source is not None:
                            source.close()
                        opened, source = path, _open(path)
                    block = memoryview(source.read_at(end - begin, begin))
                    got = [_parse(block[o - begin : o - begin + n], url, digest) for _, o, n, url, digest in rows[i:j]]
                    columns = list(zip(*got, strict=True))
                    out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64())]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    if payloads:
                        out.append(pa.array(columns[5], pa.binary()))
                        names.append("payload")
                    yield pa.RecordBatch.from_arrays(out, names)
                    i = j
        finally:
            if source is not None:
                source.close()

    return ordered.mapInArrow(run, RESULT + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, path: str | None = None, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes index and archives below `path`; returns the index and the list of archives."""
    spark = pages.sparkSession
    path = path or folder(spark)
    planned = written(plan(pages, least))
    size = planned.agg(F.sum("length")).first()[0] or 0
    archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // ARCHIVE_BYTES))
    with releasing(spark):
        placed(planned, archives).write.parquet(f"{path}/index")
    drop(planned)
    index = spark.read.parquet(f"{path}/index")
    write(pages, index, f"{path}/archives", archives)
    files = archive_files(spark, f"{path}/archives")
    wrong = index.groupBy("archive").agg(F.sum("length").alias("planned")).join(files.groupBy("archive").agg(F.sum("file_length").alias("there"), F.count("*").alias("n")), "archive", "full").filter("planned is distinct from there or n <> 1")
    if not wrong.isEmpty():
        raise RuntimeError("archives differ from their index")
    return index, files


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives every page, then reads every record back."""
    index, files = archive(pages)
    return read(index, files)
