"""Stateful streams: the first occurrence across slots, and answers that are kept for a time.

State is in the state store (RocksDB), one value a key, so a restart from the checkpoint goes on with it, and
each key ends when the watermark passes: the first occurrence by the engine's windowed aggregation, an answer by a timer.  Keys are dealt by a shuffle; no task holds more than
the values of one key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store; a choice that is already made stays."""
    if "StateStoreProvider" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def first_wins(stream: DataFrame, keys: list[str], order: list[str], ts: str = "ts", horizon: str = "14 days", delay: str = "2 days") -> DataFrame:
    """Of the rows of each key in a run the first by ``order`` (whole numbers), whole, whenever it arrives.

    A run is a tumbling stretch ``horizon`` of event time ``ts``.  Its rows are given out, and its state ends, when the watermark
    (``delay`` behind the latest row) has passed its end; what arrives later is too late.  Rows with a null key
    only move the watermark, as a source's sign of life does.
    """
    use_state_store(stream.sparkSession)
    run = F.window(ts, horizon).alias("run")
    place = F.struct(*[F.col(c).cast("long").alias(f"order_{i}") for i, c in enumerate(order)])
    # The test names the event time as well, so that it stays above the watermark, which a row without keys moves.
    named = F.forall(F.array(*[F.col(c).isNotNull() for c in (*keys, ts)]), lambda there: there)
    rows = stream.withWatermark(ts, delay).where(named).select(run, *keys, place.alias("place"), F.struct(*stream.columns).alias("row"))
    # Each task keeps the first of its rows before the shuffle, and the engine's aggregation holds them until the watermark.
    return rows.groupBy("run", *keys).agg(F.min_by("row", "place").alias("row")).select("row.*")


class _Kept(StatefulProcessor):
    """Holds the last answer to each key as long as it is valid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", StructType([StructField("fetched_at", LongType()), StructField("ttl", LongType()), StructField("answer", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, counts, ttl, answer = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, None
        for part in rows:  # distinct times only, however often a key is asked for
            both = np.concatenate([times, part["asked_at"].to_numpy(dtype=np.int64)])
            n = np.concatenate([counts, part["n"].to_numpy(dtype=np.int64)])
            times, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, weights=n).astype(np.int64)
            ttl, answer = int(part["ttl"].iloc[0]), part["answer"].iloc[0]
        answer = answer if isinstance(answer, str) else None
        held = self.held.get() if self.held.exists() else None
        before = fetched = None if held is None else held[0]
        kept = answer if held is None else held[2]
        told: list[tuple] = []
        for at, n in zip(times.tolist(), counts.tolist(), strict=True):
            new = fetched is None or at - fetched > ttl
            if new:
                fetched, kept = at, answer
            told.append((key[0], at, n, new, fetched, kept))
        if fetched != before:
            if before is not None:
                self.handle.deleteTimer((before + held[1] + 1) * 1000)
            self.held.update((fetched, ttl, kept))
            self.handle.registerTimer((fetched + ttl + 1) * 1000)
        yield pd.DataFrame(told, columns=["key", "asked_at", "n", "fetched", "fetched_at", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def kept_answers(requests: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``key, asked_at, n, fetched, fetched_at, answer``: how each request (key, ``ts``, ttl in seconds, answer) is answered, one row for all of a key at one second.

    ``answer`` is what the service would say then (null: nothing is found, which is kept as well).  A held answer serves until
    it is older than ``ttl``; then the request is ``fetched`` anew.  With a column ``n`` a row stands for that many requests.  An answer leaves the state when the watermark passes
    its end.
    """
    use_state_store(requests.sparkSession)
    rows = requests.withWatermark(ts, delay).select("key", ts, F.unix_seconds(F.col(ts)).alias("asked_at"), F.col("ttl").cast("long").alias("ttl"), F.col("answer").cast("string").alias("answer"), (F.col("n") if "n" in requests.columns else F.lit(1)).cast("long").alias("n"))
    schema = "key string, asked_at long, n long, fetched boolean, fetched_at long, answer string"
    return rows.groupBy("key").transformWithStateInPandas(_Kept(), schema, "Append", "EventTime")
