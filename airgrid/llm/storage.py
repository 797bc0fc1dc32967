"""Tables that cut lineage.

An operator that iterates, or reads an intermediate result more than once, writes
it as Parquet below the shared folder named in ``spark.checkpoint.dir`` and reads
it back.  The files are visible to every executor, so a lost executor costs a
task retry and never a recomputation of earlier rounds.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: list[str] = []  # folders of this process


def shared_dir(spark: SparkSession) -> str:
    """The folder named in the session; a temporary one only where none is set and all tasks run here (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="airgrid-"))
    return _OWN[app]


class Workspace:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/airgrid/{name}-{uuid.uuid4().hex}"
        _MADE.append(self.root)
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the result has no lineage before the files."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._airgrid_path = path
        return out

    def again(self, df: DataFrame) -> DataFrame:
        """A table made by :meth:`cut`, read anew: a frame that can be joined with the first."""
        return self.spark.read.schema(df.schema).parquet(df._airgrid_path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table made by :meth:`cut` that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._airgrid_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Numbers of 8 bytes in a table that goes to all tasks: 16 MB, and two to four times that as a hash table.
MOST_CELLS = 2_000_000


def send(small: DataFrame) -> DataFrame:
    """A table as the side that goes to all tasks if its size is counted and small, else to be joined by a shuffle.

    A number counts as one cell, text and binary by their bytes, an array by its elements.
    """
    cells = F.lit(len(small.columns))
    for name, kind in small.dtypes:
        if kind.startswith("array"):
            cells = cells + F.coalesce(F.size(name), F.lit(0)) * max(1, kind.count(","))
        elif kind in ("string", "binary"):
            cells = cells + F.coalesce(F.octet_length(name), F.lit(0)) / 8
    return F.broadcast(small) if (small.agg(F.sum(cells)).first()[0] or 0) <= MOST_CELLS else small


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables that this process has made; results that weren't written yet can't be read after it."""
    while _MADE:
        at = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of a few megabytes, bounded in rows and in bytes; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        told = re.match(r"(\d+)([bkmgt]?)", str(spark.conf.get(key)).lower())
        now = int(told[1]) << 10 * "bkmgt".find(told[2] or "b") if told else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def fresh(tokens: bool = False) -> None:
    """Called first in a task's Python function: a worker that served another operator gives its memory back."""
    import ctypes
    import gc

    import pyarrow as pa

    from . import hashing
    from .tokens import Encoder

    if tokens:
        hashing._POWERS.clear()
    else:
        Encoder._open.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
