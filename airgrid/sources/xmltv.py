"""An XMLTV document as a data sink: ``df.write.format("xmltv")``, a file a range of rows, and a manifest that names them in order.

Tasks write their rows (column ``value``) to files of their own; no byte of them passes the driver, which gets a message a task,
renames files, and publishes by renaming the manifest.  The files of the manifest one after the other are the document.
With ``compression`` gzip each is a gzip file, and so are they together; the manifest tells size and hash of the text.
The files of the publication before stay until the next, for those who read them.  A killed task or job leaves nothing that a
manifest names; :meth:`abort` deletes what it has written.

The store is one that pyarrow has a client of (local and shared file systems, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import Store

MANIFEST = "_manifest.json"
_DIGEST = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("lines", pa.int64()), ("code", pa.string()), ("text", pa.string())])


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place, its file, and what is in it."""

    number: int
    name: str
    staged: str
    rows: int
    lines: int
    size: int
    sha256: str


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class XmltvWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compression: str = ""):
        if compression not in ("", "none", "gzip"):
            raise ValueError(f"compression is none or gzip, not {compression}")
        self.path, self.run, self.packed = path, uuid.uuid4().hex, compression == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = _store(self.path)
        task = TaskContext.get()
        number, staged = task.partitionId(), f"_temporary-{self.run}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(f"{folder}/_temporary-{self.run}", recursive=True)
        rows = lines = size = 0
        code = hashlib.sha256()
        packer = zlib.compressobj(1, wbits=31) if self.packed else None
        with store.open_output_stream(f"{folder}/{staged}") as out:
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("value")):
                    line = (value.as_py() or "").encode() + b"\n"
                    out.write(packer.compress(line) if packer else line)
                    code.update(line)
                    rows, lines, size = rows + 1, lines + line.count(b"\n"), size + len(line)
            if packer:
                out.write(packer.flush())
        return Part(number, f"part-{number:06d}-{self.run}.xmltv{'.gz' if packer else ''}", staged, rows, lines, size, code.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, folder = _store(self.path)
        before = read_manifest(store, folder)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        for m in parts:
            store.move(f"{folder}/{m.staged}", f"{folder}/{m.name}")
        names = [m.name for m in parts]
        told = {"parts": [{k: v for k, v in asdict(m).items() if k != "staged"} for m in parts], "before": [p["name"] for p in before["parts"]] if before else []}
        with store.open_output_stream(f"{folder}/{MANIFEST}-{self.run}") as out:
            out.write(json.dumps(told).encode())
        store.move(f"{folder}/{MANIFEST}-{self.run}", f"{folder}/{MANIFEST}")
        for name in before["before"] if before else []:
            if name not in names:
                _drop(store, f"{folder}/{name}")
        _drop(store, f"{folder}/_temporary-{self.run}")

    def abort(self, messages: list[Part | None]) -> None:
        store, folder = _store(self.path)
        _drop(store, f"{folder}/_temporary-{self.run}")


def _drop(store, path: str) -> None:
    from pyarrow.fs import FileType

    kind = store.get_file_info(path).type
    if kind == FileType.Directory:
        store.delete_dir(path)
    elif kind != FileType.NotFound:
        store.delete_file(path)


def read_manifest(store, folder: str) -> dict | None:
    try:
        with store.open_input_stream(f"{folder}/{MANIFEST}") as told:
            return json.loads(told.read())
    except (OSError, ValueError):
        return None


class XmltvSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xmltv"

    def writer(self, schema: StructType, overwrite: bool) -> XmltvWriter:
        if "value" not in schema.fieldNames():
            raise ValueError("a column named value is needed")
        return XmltvWriter(self.options["path"], self.options.get("compression", "").lower())


def write_xmltv(parts: DataFrame, path: str, order: tuple[str, ...] = ("section", "k1", "k2", "k3", "value"), compression: str = "none") -> None:
    """Publish the parts of a document (:func:`airgrid.operators.publish.document`), sorted by range, in a folder; ``compression`` is none or gzip."""
    parts.sparkSession.dataSource.register(XmltvSink)
    parts.orderBy(*order).select("value").write.format("xmltv").option("compression", compression).mode("overwrite").save(path)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Store(spark, path).text(f"{path}/{MANIFEST}"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, line``: the published document by lines, numbered from 1."""
    told = manifest(spark, path)["parts"]
    if not told:
        return spark.createDataFrame([], "line_no long, line string")
    # Parts are read line by line and by several tasks each; the lines of each stretch are counted, and a row a stretch goes to the driver.
    text = spark.read.option("lineSep", "\n").text([f"{path}/{p['name']}" for p in told])
    rows = text.select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    stretches = {(r["name"], r["block"]): r for r in rows.groupBy("name", "block").agg(F.count("*").alias("n"), F.min("row").alias("least")).collect()}
    number, before, firsts = {p["name"]: k for k, p in enumerate(told)}, 0, []
    for name, block in sorted(stretches, key=lambda x: (number[x[0]], x[1])):
        r = stretches[name, block]
        firsts.append((name, block, before - r["least"]))
        before += r["n"]
    first = F.broadcast(spark.createDataFrame(firsts, "name string, block long, before long"))
    return rows.join(first, ["name", "block"]).select((F.col("row") + F.col("before") + 1).alias("line_no"), "line")


def digests(lines: DataFrame, size: int = 1000) -> DataFrame:
    """``chunk, lines, code``: number of lines and MD5 of each run of ``size`` lines (line_no, line) of a document, joined by line feeds.

    Lines come in stretches of the document, so a task works out most runs by itself; only what it has of a run that goes on
    elsewhere is moved as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = after = 0  # the numbers of the lines held, and of the one that would follow
        held: list[str] = []

        def told() -> list[tuple]:
            if not held:
                return []
            text = "\n".join(held)
            whole = after - first == size
            return [((first - 1) // size, first, after - first, hashlib.md5(text.encode()).hexdigest() if whole else None, None if whole else text)]

        for batch in batches:
            number, rows, out = batch.column(0).to_numpy(), batch.column(1), []
            cuts = (np.flatnonzero((np.diff(number) != 1) | (number[1:] % size == 1 % size)) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(number)], strict=True):
                if i == j:
                    continue
                if held and (number[i] != after or number[i] % size == 1 % size):
                    out += told()
                    held = []
                if not held:
                    first = int(number[i])
                held.append("\n".join(rows.slice(i, j - i).to_pylist()))
                after = int(number[j - 1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)
        if out := told():
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)

    parts = lines.select("line_no", "line").mapInArrow(run, "chunk long, first long, lines long, code string, text string")
    texts = F.array_sort(F.collect_list(F.when(F.col("code").isNull(), F.struct("first", "text"))))
    joined = F.md5(F.array_join(F.transform(texts, lambda x: x["text"]), "\n"))
    return parts.groupBy("chunk").agg(F.sum("lines").alias("lines"), F.coalesce(F.max("code"), joined).alias("code"))
