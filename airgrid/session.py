"""What a session needs besides its settings."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all tasks run here (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="airgrid-"))
    return _OWN[app]


def partitions(spark: SparkSession) -> int:
    """As many as a shuffle makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Store:
    """Files of any store that Spark reaches, by Hadoop's interface on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at(path).getFileSystem(self._conf)
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._at(path))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it is missing."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self.exists(folder) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._at(path), True)

    def move(self, path: str, to: str) -> None:
        """Rename in one step, over what is at ``to``."""
        over = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(to).toUri(), self._conf).rename(self._at(path), self._at(to), over)

    def folder(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def age(self, path: str) -> int:
        """When a file was changed last, in milliseconds since 1970."""
        return self._fs.getFileStatus(self._at(path)).getModificationTime()

    def date(self, path: str, millis: int) -> None:
        """Let a file have been changed last at that time."""
        self._fs.setTimes(self._at(path), millis, -1)

    def put(self, path: str, text: str) -> None:
        """A small file, seen whole or not at all: written beside its place and renamed."""
        staged = f"{path}._staged-{uuid.uuid4().hex}"
        out = self._fs.create(self._at(staged), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.move(staged, path)

    def text(self, path: str) -> str:
        """A small file."""
        into = self._fs.open(self._at(path))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8"))
        finally:
            into.close()

    def folders(self, folder: str) -> list[str]:
        """Names of the folders in a folder, sorted; none if it is missing."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()) if self.exists(folder) else []

    def join(self, parts: list[str], to: str) -> None:
        """The bytes of files one after the other in a new file, streamed."""
        out = self._fs.create(self._at(to), True)
        try:
            for part in parts:
                into = self._fs.open(self._at(part))
                try:
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(into, out, 1 << 16, False)
                finally:
                    into.close()
        finally:
            out.close()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once an application, unless their path has it."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _SHIPPED or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="airgrid-")
    copied = os.path.join(folder, "source", "airgrid")
    shutil.copytree(os.path.join(root, "airgrid"), copied, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "airgrid"), "zip", os.path.join(folder, "source")))
