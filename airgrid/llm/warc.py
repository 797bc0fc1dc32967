"""WARC archives: a writer of DataFrame functions and a Python data source that reads.

Writing makes one record of each page.  Of pages with equal payloads of at least
``least`` bytes, one is stored as ``response`` and the others as ``revisit`` records
that refer to it (profile identical-payload-digest) and hold HTTP headers only.  Only
digests are grouped, so payloads of a large group of copies never meet in one task;
text files are written by Spark's committer to any store, one record a row.

Reading plans file partitions (small files together), takes over filters on record
type and header fields, parses a record's headers first and seeks over payloads that
a filter rejects or that the caller doesn't want.  Archives in a store that only Spark's own
readers open (viewfs, HDFS without its native library) come as whole files of less than 2 GB from
Spark and are parsed alike; there filters are applied behind the parser.

Defined results: a null payload is empty; a null url has no target header; control
characters in a url are dropped from its header; a null page_id never is the smallest
unless it is the only one; of repeated rows one is the response; an empty table
writes an archive without records.  Rows are told apart by what they hold, and equal ones by a number
that is written with them, so the table's scans need not give rows in one order.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringStartsWith

from .storage import Workspace, fresh, send, small_batches

CRLF = "\r\n"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))


def write_warc(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 128 << 20, **options: str) -> None:
    """Write ``pages`` (page_id, url, html) to a folder of archives of about ``file_bytes`` of payload.

    Options go to the text writer; with ``compression`` a file is one compressed stream, not one for each record.
    """
    ws = Workspace(pages.sparkSession, "warc")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    told = ws.cut(rows.select("page_id", "url", "bytes", "digest"), "told")
    mean = told.agg(F.avg("bytes")).first()[0] or 0.0
    first = (
        told.where(F.col("bytes") >= least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_digest", F.col("_first.page_id").alias("_id"), F.col("_first.url").alias("_url"))
    )
    first = ws.cut(first, "repeated")
    # With few repeated digests no payload moves; with many, both sides are dealt by digest.
    key = F.when(F.col("bytes") >= least, F.col("digest"))
    least_row = F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    several = ws.again(told).join(send(first), (key == F.col("_digest")) & least_row).groupBy(F.col("_digest").alias("_tied")).count().where("count > 1").select("_tied")
    several = ws.cut(several, "tied")
    rows = rows.join(send(ws.again(first)), key == F.col("_digest"), "left").withColumn("again", F.col("_digest").isNotNull() & ~least_row)
    if several.head(1):
        # Equal rows that are all the least: they are numbered in a table of their own, and one of them is the response.
        rows = rows.join(send(several), (F.col("_digest") == F.col("_tied")) & ~F.col("again"), "left")
        equal = ws.cut(rows.where("_tied is not null").withColumn("_at", F.monotonically_increasing_id()), "equal")
        lead = ws.cut(ws.again(equal).groupBy(F.col("_digest").alias("_of")).agg(F.min("_at").alias("_lead")), "lead")
        equal = equal.join(send(lead), F.col("_digest") == F.col("_of")).withColumn("again", F.col("_at") != F.col("_lead"))
        rows = rows.where("_tied is null").drop("_tied").unionByName(equal.drop("_tied", "_at", "_of", "_lead"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    again, leads = F.col("again"), F.col("_digest").isNotNull() & ~F.col("again")
    # A response that others refer to is named by what it holds, any other record by its place in this scan too.
    urn = lambda page, *more: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), "digest", *more, F.lit(">"))
    name = F.when(leads, urn("page_id")).otherwise(urn("page_id", F.lit(":"), F.col("place").cast("string")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x1f\x7f]", "")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Profile", F.when(again, REVISIT)),
        _line("WARC-Refers-To", F.when(again, urn("_id"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
    )
    record = F.concat(head, http, F.when(again, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 500)))).options(**options).text(path)


class _Files(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


def _batches(found: Iterator[dict], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Records in batches of about ``most`` bytes."""
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names=names)
    rows: list[dict] = []
    held = 0
    for record in found:
        rows.append(record)
        held += len(record["payload"] or b"") + 500
        if held > most:
            yield made(rows)
            rows, held = [], 0
    if rows:
        yield made(rows)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.wanted = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.together = int(options.get("partitionbytes", 32 << 20))
        self.filters: list = []

    def pushFilters(self, filters):  # noqa: N802
        """Takes equality, membership, presence, prefix and substring tests of header fields."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, StringContains)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        parts: list[list[str]] = []
        room = 0
        for uri, size in sorted(self.files):
            if not parts or size > room:
                parts.append([])
                room = self.together
            parts[-1].append(uri)
            room -= size
        return [_Files(p) for p in parts] or [_Files([])]

    def _passes(self, record: dict) -> bool:
        for f in self.filters:
            value = record[f.attribute[0]]
            if value is None:
                return False
            if isinstance(f, EqualTo) and value != f.value or isinstance(f, In) and value not in f.value or isinstance(f, StringStartsWith) and not value.startswith(f.value) or isinstance(f, StringContains) and f.value not in value:
                return False
        return True

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _batches(r for uri in partition.uris for r in records(uri, self._passes, self.wanted, self.verify))


def _headers(stream) -> dict[str, str] | None:
    """Header fields up to the empty line, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    out = {"": line.decode("utf-8", "replace").strip()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records_in(raw, name: str, passes=lambda record: True, payload: bool = True, verify: bool = False) -> Iterator[dict]:
    """The records of an archive, an open file that can seek, that pass a test of their headers."""
    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
    while (head := _headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin in {name}: {head['']!r}")
        end = stream.tell() + int(head.get("content-length", 0))
        record = {c: head.get(h) for c, h in FIELDS.items()} | {"payload_bytes": None, "payload": None}
        record["payload_digest"] = (record["payload_digest"] or "").removeprefix("sha256:") or None
        if passes(record):
            told = None
            if head.get("content-type", "").startswith("application/http"):
                told = (_headers(stream) or {}).get("content-length")
            left = end - stream.tell()
            revisit = record["record_type"] == "revisit"
            record["payload_bytes"] = int(told) if revisit and told else left
            if not revisit and (payload or verify):
                body = stream.read(left)
                if verify and record["payload_digest"] and hashlib.sha256(body).hexdigest() != record["payload_digest"]:
                    raise ValueError(f"the payload of {record['record_id']} in {name} doesn't have its digest")
                record["payload"] = body if payload else None
            yield record
        if stream.tell() != end:
            stream.seek(end)


def _opened(uri: str):
    """(store, path) of an archive for pyarrow; fails where that has no client of the store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri)


def records(uri: str, passes=lambda record: True, payload: bool = True, verify: bool = False) -> Iterator[dict]:
    """The records of one archive that pass a test of their headers."""
    store, path = _opened(uri)
    with store.open_input_file(path) as raw:
        yield from records_in(raw, uri, passes, payload, verify)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; use :func:`read_warc`, which lists the files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of a folder of archives (or one archive); without ``payload`` its bytes are never read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while listed.hasNext():
        f = listed.next()
        if not f.getPath().getName().startswith(("_", ".")):
            uri = f.getPath().toString()
            files.append(("file://" + uri.removeprefix("file:").replace("//", "/") if uri.startswith("file:") else uri, f.getLen()))
    try:
        for uri, _ in files[:1]:
            _opened(uri)
    except (pa.ArrowInvalid, OSError):
        return _read_whole(spark, [uri for uri, _ in files], payload, verify)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("files", json.dumps(files)).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def _read_whole(spark: SparkSession, uris: list[str], payload: bool, verify: bool) -> DataFrame:
    """As :func:`read_warc`, with the bytes of the archives from Spark, one archive after the other."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(records_in(pa.BufferReader(content.as_buffer()), name, payload=payload, verify=verify))

    return spark.read.format("binaryFile").load(uris).select("path", "content").mapInArrow(run, SCHEMA)
