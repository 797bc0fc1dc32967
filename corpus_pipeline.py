"""A training-corpus pipeline: each stage is one operator over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of documents.  ORACLE_SQL is None: min-hash candidates, a fitted classifier and
subword ids have no SQL form; tests hold each stage against a brute-force version.

Defined results: columns beside doc_id and text stay as they are, but for n_chars, which follows the text.
Null and empty texts are not toxic, have no lines to lose and no copies, take nothing in the mix (so they
go there) and otherwise stay.  A null doc_id is that of a document of its own; rows that agree in doc_id and
text keep their lines together, leave one row among near copies and are mixed one by one; rows of one
doc_id with other texts are documents of their own.  Ties go to the smaller doc_id, a null one last, and then to the
smaller hash of the text.  Empty tables give empty results; without labels of both classes nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import line_dedup, mixing, packing, signature_tree, toxicity
from airgrid.llm.document_keys import KEY, with_keys
from airgrid.llm.storage import Workspace, send


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the ordinal model calls toxic go; all others stay as they are."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of similar lines the first stays; the others are taken out of their texts."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the document with the smallest doc_id stays, a null one last.

    Rows that agree in doc_id and text leave one row, unless the text has no words.
    """
    ws = Workspace(spark, "pipeline")
    keyed = with_keys(ws, docs)
    found = ws.cut(signature_tree.similar_documents(keyed.select(F.col(KEY).alias("doc_id"), "text")), "found")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_airgrid_gone")).distinct()
    kept = keyed.join(send(ws.cut(gone, "gone")), F.col(KEY) == F.col("_airgrid_gone"), "left_anti")
    again = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_airgrid_again")).count().where("count > 1").select("_airgrid_again")
    again = ws.cut(again, "again")
    if again.head(1):
        # The least row of equal ones, combined in each task, so a large group gathers nowhere.
        same = F.col(KEY) == F.col("_airgrid_again")
        least = kept.join(send(again), same, "left_semi").groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
        return kept.join(send(ws.again(again)), same, "left_anti").select(*docs.columns).unionByName(least)
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document with the words that the mix takes of it, repeats written out."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every piece of every document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
