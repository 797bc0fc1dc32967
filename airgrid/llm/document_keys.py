"""Numbers for documents whose doc_id is null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, send

KEY = "_airgrid_doc"


def with_keys(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a long ``_airgrid_doc`` that is the same only where doc_id and text are.

    The keys are in the order of doc_id, a null one last, and of a 64-bit hash of the text.  Where no
    doc_id is null or has two texts they are the doc_ids themselves and nothing is joined.
    """
    code = F.xxhash64("text", F.col("text").isNull())
    ids = ws.cut(docs.select(F.col("doc_id").cast("long").alias("_airgrid_id"), code.alias("_airgrid_code")).distinct(), "ids")
    unclear = ids.groupBy("_airgrid_id").count().where("count > 1 or _airgrid_id is null")
    if not unclear.head(1):
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    # The numbers grow along the sorted partitions; they are written once and then only read.
    ordered = ids.orderBy(F.col("_airgrid_id").asc_nulls_last(), "_airgrid_code").withColumn(KEY, F.monotonically_increasing_id())
    keys = send(ws.cut(ordered, "keys"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_airgrid_id")) & (code == F.col("_airgrid_code"))
    return docs.join(keys, same).drop("_airgrid_id", "_airgrid_code")
