"""Web archives: writing pages as WARC records, and a Spark data source that reads them.

Writing is Spark's own text writer, so it works in any store Spark can write to: each row is one record and the
line separator is the blank line that ends a record.  Repeated payloads of at least ``REVISIT_BYTES`` are written
once, by the largest page id; the other pages become revisit records that refer to it.

Reading is a PySpark Python data source.  The driver plans partitions of whole files; record-type and header
predicates that Spark pushes down are checked as soon as a record's header block is parsed; the payload of a record
that is not wanted is skipped undecoded, and a wanted one is only decoded if ``payload`` asks for it.

Edge cases: a null page is an empty payload; a null url or id writes no value and reads as null; line breaks in a
url are percent-encoded; rows of equal id and payload that name the largest id are all responses; if a repeated payload
has no id at all, all its rows are responses; an empty table writes an empty archive that reads as no rows.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .scratch import table
from .skew import join_skewed

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 50_000
DATE = "2000-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
PLANNED_BYTES = 32 << 20


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes and refers_to (null for a response) of each page."""
    payload = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    many = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
    # Of each repeated payload: the page that keeps it.  The payloads of a much repeated page stay where they are.
    key = F.concat_ws(":", "payload_digest", "payload_bytes").alias("key")
    many = table(many.where("n > 1").select(key, "n", "first"), "warc-repeated")
    keyed = own.select(key, "*")
    joined = join_skewed(keyed, many, "key", "n", "left").drop("key")
    other = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return joined.withColumn("refers_to", F.when(other, F.col("first"))).drop("first")


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``pages`` (page_id, url, html) as gzip-compressed WARC files under ``path``."""
    rows = revisits(pages)
    revisit = F.col("refers_to").isNotNull()
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes") + len(HTTP))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", identity(F.col("page_id"))),
        _line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Payload-Bytes", F.col("payload_bytes").cast("string")),
        _line("WARC-Refers-To", F.when(revisit, identity(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
        block,
    )
    options = {"lineSep": "\r\n\r\n", "compression": "gzip", "maxRecordsPerFile": RECORDS_PER_FILE, "zlib.compress.level": "BEST_SPEED"}
    rows.select(record.alias("value")).write.options(**options).text(path)


@dataclass
class Files(InputPartition):
    """A few whole archive files."""

    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _store(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _holds(test: Filter, value: object) -> bool:
    if value is None:
        return False
    if isinstance(test, In):
        return value in test.value
    against = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}[type(test)]
    return getattr(value, against)(test.value) is True


class WarcReader(DataSourceReader):
    """Plans files, then streams their records, headers first."""

    HEADERS = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "check")
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            name = getattr(one, "attribute", ())
            if isinstance(one, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(name) == 1 and name[0] in self.HEADERS:
                self.tests.append((name[0], one))
            else:
                yield one

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, top = _store(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.type == fs.FileType.File]
        found = sorted((x for x in found if not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        out, held = [], PLANNED_BYTES
        for x in found:
            if held + x.size > PLANNED_BYTES:
                out.append([])
                held = 0
            out[-1].append(x.path)
            held += x.size
        return [Files(paths) for paths in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)[0]
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw as stream:
                for row in records(stream, self.tests, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 5000 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = (*WarcReader.HEADERS, "payload")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=list(names))


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records(stream, tests: list[tuple[str, Filter]], payload: str = "check") -> Iterator[tuple]:
    """The rows of one archive.  payload: "skip" trusts the headers, "check" verifies the digest, "bytes" returns the payload."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        digest, length = head.get("warc-payload-digest"), head.get("warc-payload-bytes")
        row = {"page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "payload_digest": digest and digest.removeprefix("sha1:"), "payload_bytes": int(length) if length else None, "refers_to": _page(head.get("warc-refers-to"))}
        if payload == "skip" or row["record_type"] != "response" or not all(_holds(test, row[name]) for name, test in tests):
            left = size
            while left > 0:
                left -= len(stream.read(min(left, 1 << 20))) or left
            body = None
        else:
            body = stream.read(size)
            if len(body) < size:
                raise ValueError("a record is cut short")
            if head.get("content-type", "").startswith("application/http"):
                body = body[body.index(b"\r\n\r\n") + 4 :]
            row["payload_bytes"] = len(body)
            found = hashlib.sha1(body).hexdigest()
            if row["payload_digest"] not in (None, found):
                raise ValueError(f"page {row['page_id']}: the payload does not match its digest")
            row["payload_digest"] = found
        if all(_holds(test, row[name]) for name, test in tests):
            yield (*(row[name] for name in WarcReader.HEADERS), body if payload == "bytes" else None)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload``: skip, check (default) or bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, path: str, payload: str = "check") -> DataFrame:
    """The records of the archives under ``path``: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)
