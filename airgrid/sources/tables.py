"""Small sources: key-value caches, the recorder's channel list, settings."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import Versions


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache table; one that is missing or broken is empty."""
    found = Versions(spark, path).open(hold=False)
    try:
        if found is not None:
            table = found.table("cache")
            table.count()  # every file opens; no column is read
            return spark.createDataFrame([], schema).unionByName(table.select(*spark.createDataFrame([], schema).columns))
    except (PySparkException, Py4JJavaError):
        pass
    return spark.createDataFrame([], schema)


def write_cache(cache: DataFrame, path: str) -> None:
    """Put a merged cache, which may be read from it, in the place of the last one by one rename; a crash leaves the last one."""
    versions = Versions(cache.sparkSession, path)
    now = versions.current()
    versions.publish({"cache": cache}, now["saved_at"] + 1 if now else 1)
    versions.vacuum(keep=1)


def recorder_numbers(spark: SparkSession, path: str) -> DataFrame:
    """``number``: channel numbers from the recorder's JSON answer (Items[].ChannelNumber)."""
    rows = spark.read.schema("Items array<struct<ChannelNumber:string>>").json(path, multiLine=True, mode="FAILFAST")
    return rows.select(F.explode("Items").alias("i")).select(F.col("i.ChannelNumber").alias("number"))


def setting(spark: SparkSession, key: str, fallback: str) -> str:
    """A setting from the session or the environment; empty counts as unset."""
    return spark.conf.get(f"spark.airgrid.{key.lower()}", "") or os.environ.get(key, "") or fallback
