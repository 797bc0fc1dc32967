"""Each stage on its own input, and the whole."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from airgrid.llm.mixing import apply_mix, mix
from airgrid.llm.queries import op6_token_rollup

from .fixtures import hard_documents, no_documents, prose, texts_of
from .test_line_dedup import want as kept_lines
from .test_signature_tree import want as near_groups
from .test_token_rollup import _want
from .test_toxicity import BAD


def _tables(spark, folder):
    docs = hard_documents(spark)
    schema = docs.schema
    extra = []
    for i in range(100, 220):
        words = prose(i, 30)
        toxic = i % 4 == 0
        row = dict.fromkeys(schema.names) | {"doc_id": i, "text": words + (" " + " ".join(BAD[:3]) if toxic else ""), "lang": "en", "source": f"s{i % 3}"}
        extra.append(tuple((row | {"n_chars": len(row["text"])})[c] for c in schema.names))
    docs.unionByName(spark.createDataFrame(extra, schema)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100, 220)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, tmp_path):
    docs = _tables(spark, tmp_path)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]

    def step(name, table):
        out = stages[name](spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = step("toxicity", docs)
    assert texts_of(clean) == {i: t for i, t in texts_of(docs).items() if i < 100 or i % 4}
    lines = step("line_dedup", clean)
    assert texts_of(lines) == kept_lines(texts_of(clean))
    single = step("ngram_join", lines)
    assert set(texts_of(single)) == {i for i, (_, c) in near_groups(texts_of(lines)).items() if i == c}
    mixed = step("mixing", single)
    taken = {r["doc_id"]: r["taken"] for r in mix(single).collect() if r["taken"]}
    assert {i: len(t.split()) for i, t in texts_of(mixed).items()} == taken
    assert all(t.columns == columns for t in (clean, lines, single, mixed))
    assert clean.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = step("packing", mixed)
    assert set(packed.select("doc_id").distinct().toPandas()["doc_id"]) == set(taken)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(key).collect())) == Counter(map(tuple, packed.select(key).collect()))


def test_empty_tables(spark, tmp_path):
    no_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert op6_token_rollup(spark, str(tmp_path)).count() == 0


def test_rollup_query(spark, tmp_path):
    docs = _tables(spark, tmp_path)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in op6_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in _want(docs).items() if v != (0, 0)}


def test_null_and_repeated_ids(spark, tmp_path):
    """Rows with no doc_id of their own keep one row of each group of copies and are mixed once each."""
    one, two = prose(700, 40), prose(701, 50)
    rows = [(None, one, "a"), (None, one, "a"), (None, one + " end", "b"), (None, two, "a"), (None, None, "a"), (None, "", "b")]
    rows += [(5, prose(702, 60), "a")] * 3 + [(5, prose(703, 30), "b"), (6, two, "b"), (7, prose(704, 45), None), (7, prose(705, 45), None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, n int").repartition(3)
    docs.write.parquet(f"{tmp_path}/in.parquet")
    kept = corpus_pipeline.drop_near_copies(spark, spark.read.parquet(f"{tmp_path}/in.parquet"), str(tmp_path))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    firsts = {k: v for k, v in got.items() if k in ((None, one), (None, one + " end"))}
    assert sum(firsts.values()) == 1
    rest = {(None, None): 1, (None, ""): 1, (5, prose(702, 60)): 1, (5, prose(703, 30)): 1, (6, two): 1, (7, prose(704, 45)): 1, (7, prose(705, 45)): 1}
    assert {k: v for k, v in got.items() if k not in firsts} == rest


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, prose(800 + i % 4, 20 + i % 4), f"s{i % 3}", i) for i in range(60)] + [(9, prose(850, 33), "s1", 100 + i) for i in range(30)] + [(i, prose(900 + i, 25), "s2", 200 + i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(3)
    mixed = mix(docs).cache()
    out = apply_mix(docs, mixed).collect()
    assert len({r["n"] for r in out}) == len(out)
    words = lambda rows, n: Counter((r["doc_id"], r["source"], n(r)) for r in rows)
    assert words(out, lambda r: len(r["text"].split())) == words(mixed.where("taken > 0").collect(), lambda r: r["taken"])
    texts = {r[3]: r[1:3] for r in rows}
    assert all(texts[r["n"]][1] == r["source"] and set(r["text"].split()) <= set(texts[r["n"]][0].split()) for r in out)
