"""Places in one total order over a whole table, without bringing it into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import partitions, shared_dir

_ROWS = 33  # bits of a row's number within its partition in monotonically_increasing_id


def numbered(df: DataFrame, order: list[Column | str], name: str = "ord", tasks: int | None = None) -> DataFrame:
    """``df`` with the place of each row (from 1) in the order of ``order``; rows that tie in it have places in any order, so it should be total.

    Rows are sorted by range and written once with their numbers within the range.  Of each range only its count goes to the
    driver; the sums of the counts before it are added to its numbers.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/airgrid/order-{uuid.uuid4().hex}"
    ranges = df.repartitionByRange(tasks or partitions(spark), *order).sortWithinPartitions(*order)
    ranges.withColumn("airgrid_row", F.monotonically_increasing_id()).write.parquet(at)
    rows = spark.read.parquet(at)
    part = F.shiftright("airgrid_row", _ROWS)
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    before, total = [], 0
    for k, n in counts:
        before.append((k, total))
        total += n
    sums = F.broadcast(spark.createDataFrame(before, "airgrid_part long, airgrid_before long"))  # a row a range
    place = F.col("airgrid_before") + F.col("airgrid_row").bitwiseAND((1 << _ROWS) - 1) + 1
    return rows.join(sums, part == F.col("airgrid_part")).withColumn(name, place.cast("long")).select(*df.columns, name)
