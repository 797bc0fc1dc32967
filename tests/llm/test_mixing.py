"""Word counts, targets and what is taken, against a plain computation."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from airgrid.llm.mixing import apply_mix, mix

from .fixtures import hard_documents, no_documents, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in above}
        open_ -= above
    return out


def check(docs):
    rows = mix(docs).collect()
    texts = texts_of(docs)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    by = defaultdict(int)
    for i, n in size.items():
        by[source[i]] += n
    want, taken = targets(by), defaultdict(int)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1.5, 0.01 * t)
    return rows


def test_hard_documents(spark):
    docs = hard_documents(spark)
    first = check(docs)
    assert sorted(map(str, first)) == sorted(map(str, mix(docs.repartition(7)).collect()))


def test_mixed_texts(spark):
    docs = hard_documents(spark)
    mixed = mix(docs).cache()
    out = apply_mix(docs, mixed)
    assert out.columns == docs.columns
    got = {r["doc_id"]: len(WORD.findall(r["text"])) for r in out.collect()}
    assert got == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_one_hot_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    check(docs)


def test_one_source_and_none(spark):
    docs = hard_documents(spark).withColumn("source", F.lit(None).cast("string"))
    check(docs)
    assert mix(no_documents(spark)).count() == 0
    assert {r["taken"] for r in mix(docs.where("text is null or text = ''")).collect()} == {0}


def test_no_python(spark):
    plan = mix(hard_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
