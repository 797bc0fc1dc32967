"""Tables in immutable versions, of which one rename makes the next one current.

``<folder>/<table>/saved_at=<n>/version=<id>`` holds the files of a version, ``_log/<id>`` says that all its tables are
complete, ``_current`` names the version that new readers get, and ``_readers/<id>.<lease>`` that somebody reads one.
A publication writes the tables, then the log, then renames ``_current``; stopped anywhere before that, it leaves
readers with the version before, and its files go with a later :meth:`Versions.vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import Store


class Version:
    """A version that is held: its tables stay until :meth:`close`, whatever is published meanwhile."""

    def __init__(self, owner: Versions, told: dict, lease: str | None):
        self._owner, self._told, self._lease = owner, told, lease
        self.id, self.saved_at = told["version"], told["saved_at"]

    def table(self, name: str) -> DataFrame:
        schema = StructType.fromJson(self._told["tables"][name])
        return self._owner.spark.read.schema(schema).parquet(self._owner._at(name, self.saved_at, self.id))

    def close(self) -> None:
        if self._lease:
            self._owner._store.delete(self._lease)
            self._lease = None

    def __enter__(self) -> Version:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._store = spark, folder, Store(spark, folder)

    def _at(self, table: str, saved_at: int, version: str) -> str:
        return f"{self.folder}/{table}/saved_at={saved_at}/version={version}"

    def _told(self, path: str) -> dict | None:
        try:
            return json.loads(self._store.text(path))
        except (Py4JError, ValueError):
            return None

    def current(self) -> dict | None:
        """What the current version is made of; None where nothing is published or its file is broken."""
        return self._told(f"{self.folder}/_current")

    def publish(self, tables: dict[str, DataFrame], saved_at: int) -> str:
        """Write the tables as a version of time ``saved_at`` and make it current; its id."""
        version = f"{saved_at}-{uuid.uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(self._at(name, saved_at, version))
        told = json.dumps({"version": version, "saved_at": saved_at, "tables": {name: t.schema.jsonValue() for name, t in tables.items()}})
        self._store.put(f"{self.folder}/_log/{version}", told)
        self._store.put(f"{self.folder}/_current", told)
        return version

    def open(self, hold: bool = True) -> Version | None:
        """The current version; with ``hold`` it is kept until it is closed (or the lease is over, see :meth:`vacuum`)."""
        while told := self.current():
            lease = f"{self.folder}/_readers/{told['version']}.{uuid.uuid4().hex}" if hold else None
            if lease:
                self._store.put(lease, str(int(time.time())))
            # Published anew and tidied up in between: take the next one.
            if not hold or self._store.exists(f"{self.folder}/_log/{told['version']}"):
                return Version(self, told, lease)
            self._store.delete(lease)
        return None

    def versions(self) -> list[dict]:
        """All complete versions, the oldest first."""
        told = [self._told(f"{self.folder}/_log/{n}") for n in self._store.names(f"{self.folder}/_log") if "._staged-" not in n]
        return sorted((t for t in told if t), key=lambda t: (t["saved_at"], t["version"]))

    def history(self, table: str) -> DataFrame:
        """Rows of a table in all complete versions, with ``saved_at`` and ``version``, by which files are pruned."""
        told = [t for t in self.versions() if table in t["tables"]]
        schema = StructType.fromJson(told[-1]["tables"][table]) if told else StructType()
        rows = self.spark.read.schema(StructType([*schema.fields]).add("saved_at", "long").add("version", "string")).option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")
        return rows.where(F.col("version").isin([t["version"] for t in told]))

    def vacuum(self, keep: int = 1, lease_seconds: int = 86400, now: int | None = None) -> list[str]:
        """Delete versions older than the current one but the last ``keep`` of them and those that are held; their ids.

        A lease counts for ``lease_seconds``, so that a reader that was lost keeps nothing for ever.
        """
        current = self.current()
        if current is None:
            return []
        now = int(time.time()) if now is None else now
        held = set()
        for n in self._store.names(f"{self.folder}/_readers"):
            since = self._told(f"{self.folder}/_readers/{n}")
            if isinstance(since, int) and now - since > lease_seconds:
                self._store.delete(f"{self.folder}/_readers/{n}")
            else:
                held.add(n.rpartition(".")[0])
        last = [t["version"] for t in self.versions() if t["version"] != current["version"]]
        spared = held | {current["version"]} | set(last[-keep:] if keep else [])
        gone = set()
        for table in self._store.folders(self.folder):
            for at in self._store.folders(f"{self.folder}/{table}") if not table.startswith("_") else []:
                saved_at = int(at.partition("=")[2])
                names = [n.partition("=")[2] for n in self._store.folders(f"{self.folder}/{table}/{at}")]
                # What is younger than the current version may be a publication under way.
                old = [v for v in names if v not in spared and saved_at <= current["saved_at"]]
                for v in old:
                    self._store.delete(f"{self.folder}/_log/{v}")
                    self._store.delete(self._at(table, saved_at, v))
                    gone.add(v)
                if old and len(old) == len(names):
                    self._store.delete(f"{self.folder}/{table}/{at}")
        return sorted(gone)
