"""A key-value cache that is dealt by hash of key: a merge writes the slices it touches, and a probe moves no row of it.

``<folder>/data/<version>/slice=<k>`` holds the rows of a slice, in bucket files by key as Spark's bucketed tables have them;
``_current`` names the version of each slice and is renamed in one step, so a crash leaves the cache as it was.
Read as a bucketed table, a join on the key needs no exchange on the cache's side.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Store


class KeyedCache:
    """``schema`` has a string column ``key``; each key has one row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, slices: int = 16, buckets: int = 8):
        self.spark, self.folder, self.schema, self.slices, self.buckets = spark, folder, schema, slices, buckets
        self._store = Store(spark, folder)

    def _slice(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.slices)).cast("int")

    def _current(self) -> dict:
        try:
            return json.loads(self._store.text(f"{self.folder}/_current"))
        except (Py4JError, ValueError):
            return {"slices": {}, "before": []}

    def _table(self) -> DataFrame:
        """All rows with their slice, as a bucketed table of this session."""
        told = self._current()["slices"]
        if not told:
            return self.spark.createDataFrame([], self.schema).withColumn("slice", F.lit(0))
        name = f"airgrid_cache_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} ({self.schema}, slice int) using parquet partitioned by (slice) clustered by (key) into {self.buckets} buckets location '{self.folder}/data'")
        parts = " ".join(f"partition (slice={k}) location '{self.folder}/data/{version}/slice={k}'" for k, version in told.items())
        self.spark.sql(f"alter table {name} add if not exists {parts}")
        return self.spark.table(name)

    def read(self) -> DataFrame:
        """All rows."""
        return self._table().drop("slice")

    def close(self) -> None:
        """Forget this session's names of the cache; no file is touched."""
        for t in self.spark.catalog.listTables():
            if t.name.startswith("airgrid_cache_"):
                self.spark.sql(f"drop table if exists {t.name}")

    def merge(self, rows: DataFrame, valid: Column | None = None) -> list[int]:
        """Put ``rows`` in; of the slices that they touch, rows that are not ``valid`` any more go.  The numbers of these slices."""
        columns = self.spark.createDataFrame([], self.schema).columns
        new = rows.select(*columns).withColumn("slice", self._slice())
        touched = sorted(r["slice"] for r in new.select("slice").distinct().collect())  # at most ``slices``
        if not touched:
            return []
        old = self._table().where(F.col("slice").isin(touched))
        old = (old.where(valid) if valid is not None else old).join(new.select("key"), "key", "left_anti").select(*columns, "slice")
        version, name = uuid.uuid4().hex, f"airgrid_cache_{uuid.uuid4().hex}"
        dealt = old.unionByName(new).repartition(self.buckets, "key")  # a bucket a task, as the table has them
        dealt.write.partitionBy("slice").bucketBy(self.buckets, "key").format("parquet").option("path", f"{self.folder}/data/{version}").saveAsTable(name)
        self.spark.sql(f"drop table {name}")  # the name only: the files are the cache's
        told = self._current()
        now = told["slices"] | {str(k): version for k in touched}
        self._store.put(f"{self.folder}/_current", json.dumps({"slices": now, "before": sorted(set(told["slices"].values()))}))
        return touched

    def vacuum(self) -> list[str]:
        """Delete versions that neither the cache as it is nor the one before the last merge has, for those who read that."""
        told = self._current()
        spared = set(told["slices"].values()) | set(told["before"])
        gone = [v for v in self._store.folders(f"{self.folder}/data") if v not in spared]
        for v in gone:
            self._store.delete(f"{self.folder}/data/{v}")
        return gone
