"""One query for each operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, filter_audit, html_text, line_dedup, mixing, packing, pfp_dedup, pq_dedup, signature_tree, spelling, token_rollup, toxicity, warc
from .oracles import SQL  # noqa: F401
from .storage import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann_forest.search(rows, rows.where("vec_id % 20 = 0"))


def op2_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "warc").path("archive")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    page = lambda urn: F.regexp_extract(urn, r"^<urn:page:(-?\d*):", 1)
    back = warc.read_warc(spark, path, payload=False, verify=True)
    return back.select(F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]*):', 1) as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).try_cast("long").alias("refers_to"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded with words and estimated subword counts, sent again, and revised to the counts of whole texts.

    Estimates are also loaded as a trial version, which is deleted again, so nothing of it is left.
    """
    docs = _table(spark, sf_dir, "documents")
    rollup = token_rollup.TokenRollup(spark, Workspace(spark, "token_rollup").path("rollup"))
    estimated = token_rollup.estimate_tokens(docs)
    for _ in range(2):  # the second time nothing changes
        rollup.commit("load", token_rollup.inserts(estimated))
    subword = (token_rollup.SUBWORD,)
    rollup.commit("recount", token_rollup.revisions(token_rollup.estimate_tokens(docs, versions=subword), token_rollup.count_tokens(docs, versions=subword)))
    trial = token_rollup.estimate_tokens(docs, versions=("trial",))
    rollup.commit("trial", token_rollup.inserts(trial))
    rollup.compact()
    rollup.commit("retire", token_rollup.deletes(trial))
    return rollup.totals()


def op7_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pfp_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.similar_documents(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_forest": op1_ann_forest,
    "op2_pq_dedup": op2_pq_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_token_rollup": op6_token_rollup,
    "op7_pfp_dedup": op7_pfp_dedup,
    "op8_signature_tree": op8_signature_tree,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_html_text": op12_html_text,
    "op13_spelling": op13_spelling,
}
