"""Periodic refresh and cross-slot dedup as Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from ..session import Store


def slot_counts(events: DataFrame, hours: int = 6) -> DataFrame:
    """Rows of each tumbling slot (ts, event_type); works on a stream and on a table."""
    slot = F.window("ts", f"{hours} hours")
    return events.groupBy(slot.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("slot_start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """One row of each key; on a stream the state of a key is dropped when the watermark passes it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def run_once(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Take all that has arrived in batches, publish each, and stop; a rerun goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_every(stream: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, period: str = "24 hours"):
    """Publish what has arrived once a period, until the returned query is stopped; a failed batch leaves the last publication."""
    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def next_delay_seconds(age_seconds: int, period: int = 24 * 3600, least: int = 3600) -> int:
    """How long to wait for the next refresh after a start from a snapshot of that age."""
    return max(period - age_seconds, least)


class StreamCounters(StreamingQueryListener):
    """Sums of what a stream observes (``observe(name, ...)``) over its batches; add it with ``spark.streams.addListener``."""

    def __init__(self, name: str):
        self.name, self.sums, self.batches = name, {}, set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        at = (str(event.progress.id), event.progress.batchId)
        if told is not None and at not in self.batches:  # a batch that is run again counts once
            self.batches.add(at)
            for k, v in told.asDict().items():
                self.sums[k] = self.sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Replay:
    """A stream of table rows in the order of a number, a micro-batch a number: for tests and backfills.

    A micro-batch is always ``files`` files, some of them empty, so that many tasks write and read a large one.
    """

    def __init__(self, spark: SparkSession, schema: StructType, folder: str, files: int = 1):
        self.spark, self.schema, self.folder, self.files = spark, schema, folder, files

    def add(self, rows: DataFrame, batch: str) -> None:
        """Write the rows of each number, the smallest number first, so that files are as old as their number says."""
        staged = f"{self.folder}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("airgrid_file", F.pmod(F.xxhash64(*rows.columns), F.lit(self.files)))
        dealt.repartition(batch, "airgrid_file").write.option("maxRecordsPerFile", 0).partitionBy(batch, "airgrid_file").parquet(f"{staged}/rows")
        store = Store(self.spark, staged)
        store.folder(self.folder)
        numbers = sorted(int(n.partition("=")[2]) for n in store.names(f"{staged}/rows") if n.startswith(f"{batch}="))
        found = {k: [f"{staged}/rows/{batch}={k}/{at}/{n}" for at in store.folders(f"{staged}/rows/{batch}={k}") for n in store.names(f"{staged}/rows/{batch}={k}/{at}") if n.startswith("part-")] for k in numbers}
        if any(len(f) < self.files for f in found.values()):
            self.spark.createDataFrame([], rows.drop(batch).schema).coalesce(1).write.parquet(f"{staged}/none")
            none = [f"{staged}/none/{n}" for n in store.names(f"{staged}/none") if n.startswith("part-")]
            for k, files in found.items():
                for i in range(self.files - len(files)):
                    store.join(none, f"{staged}/rows/none-{k}-{i}")
                    files.append(f"{staged}/rows/none-{k}-{i}")
        last = max([int(time.time() * 1000), *(store.age(f"{self.folder}/{n}") + 1 for n in store.names(self.folder))])
        for at, k in enumerate(numbers):
            for path in found[k]:
                store.date(path, last + at)
                store.move(path, f"{self.folder}/{k}-{uuid.uuid4().hex}.parquet")
        store.delete(staged)

    def stream(self, batch: str) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.folder).drop(batch)
