"""Versions, the document sink, places and counters: crashes at each step, and readers across publications."""

import json
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from airgrid.functions import exact
from airgrid.operators import order, prefixes
from airgrid.operators.versions import Versions
from airgrid.session import Store
from airgrid.sources import tables, xmltv
from airgrid.streaming import refresh


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_a_reader_goes_on_across_publications(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    assert v.open() is None and v.vacuum() == []
    v.publish({"a": rows(spark, 1), "b": rows(spark, 10)}, 100)
    with v.open() as reader:
        held = reader.table("a")
        for n in (2, 3, 4):
            v.publish({"a": rows(spark, n), "b": rows(spark)}, 100 + n)
            v.vacuum(keep=0)
        assert values(held) == [1] and values(reader.table("b")) == [10]
        assert values(v.open(hold=False).table("a")) == [4] and v.open(hold=False).table("b").schema == held.schema
        assert [t["saved_at"] for t in v.versions()] == [100, 104]
    assert len(v.vacuum(keep=0)) == 1 and [t["saved_at"] for t in v.versions()] == [104]
    plan = v.history("a").where("saved_at = 104")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "104" in plan
    v.open()  # a lost reader keeps a version for the time of its lease only
    v.publish({"a": rows(spark, 5), "b": rows(spark)}, 105)
    assert v.vacuum(keep=0) == [] and len(v.vacuum(keep=0, now=10**12)) == 1


@pytest.mark.parametrize("step", ["table a", "table b", "_log", "_current"])
def test_a_crash_at_each_step(spark, tmp_path, monkeypatch, step):
    v = Versions(spark, f"file://{tmp_path}/t")
    v.publish({"a": rows(spark, 1), "b": rows(spark, 10)}, 1)
    tables_ = {"a": rows(spark, 2), "b": rows(spark, 20)}
    if step.startswith("table"):
        broken = rows(spark, 2).select(F.raise_error(F.lit("crash")).cast("long").alias("v"))
        tables_[step[-1]] = broken
        with pytest.raises(Exception, match="crash"):
            v.publish(tables_, 2)
    else:
        real = Store.put

        def put(self, path, text):
            if f"/{step}" in path:
                raise RuntimeError("crash")
            real(self, path, text)

        monkeypatch.setattr(Store, "put", put)
        with pytest.raises(RuntimeError):
            v.publish(tables_, 2)
        monkeypatch.undo()
    now = v.open(hold=False)
    assert values(now.table("a")) == [1] and values(now.table("b")) == [10]
    v.publish({"a": rows(spark, 3), "b": rows(spark, 30)}, 3)
    v.vacuum(keep=0)
    assert values(v.open(hold=False).table("a")) == [3]
    assert [p.name for p in (tmp_path / "t" / "a").glob("saved_at=*")] == ["saved_at=3"], "what the crash has left is gone"


def test_a_cache_outlives_a_crash(spark, tmp_path):
    at = f"file://{tmp_path}/cache"
    tables.write_cache(rows(spark, 1, 2), at)
    with pytest.raises(Exception, match="crash"):
        tables.write_cache(tables.read_cache(spark, at, "v long").select(F.raise_error(F.lit("crash")).cast("long").alias("v")), at)
    assert values(tables.read_cache(spark, at, "v long")) == [1, 2]
    tables.write_cache(tables.read_cache(spark, at, "v long").where("v > 1"), at)
    assert values(tables.read_cache(spark, at, "v long")) == [2]


def document(spark, n, tag):
    return spark.range(n).selectExpr("int(id % 3) section", "lpad(id % 7, 3, '0') k1", "'' k2", f"'{tag}' k3", f"concat('  <p no=\"', id, '\">\n    {tag} é\n  </p>') value")


def text_of(tmp_path):
    told = json.loads((tmp_path / xmltv.MANIFEST).read_text())
    return "".join((tmp_path / p["name"]).read_text() for p in told["parts"]), told


def test_sink(spark, tmp_path):
    for n, tag in ((500, "one"), (90, "two"), (0, "none"), (40, "three")):
        doc = document(spark, n, tag)
        xmltv.write_xmltv(doc, str(tmp_path))
        want = "".join(r["value"] + "\n" for r in sorted(doc.collect(), key=lambda r: (r["section"], r["k1"], r["k2"], r["k3"], r["value"].encode())))
        got, told = text_of(tmp_path)
        assert got == want
        lines = xmltv.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
        assert [r["line"] for r in lines] == want.split("\n")[:-1] and [r["line_no"] for r in lines] == list(range(1, len(lines) + 1))
        kept = {p["name"] for p in told["parts"]} | set(told["before"]) | {xmltv.MANIFEST}
        assert {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")} == kept, "this publication and the one before, and nothing else"


def test_sink_after_a_killed_task(spark, tmp_path):
    xmltv.write_xmltv(document(spark, 50, "whole"), str(tmp_path))
    before, _ = text_of(tmp_path)
    bad = document(spark, 50, "half").withColumn("value", F.when(F.col("value").contains('"33"'), F.raise_error(F.lit("killed"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="killed"):
        xmltv.write_xmltv(bad, str(tmp_path))
    assert text_of(tmp_path)[0] == before
    assert not [p for p in tmp_path.iterdir() if "_temporary" in p.name]


def test_places(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 a", "if(id % 5 = 0, null, id % 11) b")
    plan = order.numbered(df, [F.desc("a"), "b", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    got = order.numbered(df, [F.desc("a"), "b", "id"], tasks=9).collect()
    want = sorted((r.asDict() for r in df.collect()), key=lambda r: (-r["a"], r["b"] is not None, r["b"] or 0, r["id"]))
    assert [(r["id"], r["ord"]) for r in sorted(got, key=lambda r: r["ord"])] == [(r["id"], k) for k, r in enumerate(want, 1)]
    assert order.numbered(df.limit(0), ["id"]).count() == 0


def test_one_decimal_is_exact(spark):
    rng = random.Random(7)
    cases = [0.0, -0.0, 0.05, 0.25, 0.75, 8.35, 8.45, 0.95, 9.95, 99.95, 0.03, 0.0499999, 1e-300, 5e-324, 2.5, -2.25, -0.04, 4503599627370495.5, 2.0**53, 1e17, 123456789012345.65]
    cases += [k / 20 for k in range(-200, 400)] + [rng.uniform(-10, 10) for _ in range(3000)] + [rng.uniform(0, 1) * 10 ** rng.randrange(-3, 15) for _ in range(3000)]
    cases += [x for k in range(1, 400, 2) for x in (k / 20 + 2.0**-54 * k, k / 20 - 2.0**-54 * k)]
    df = spark.createDataFrame([(c,) for c in [*cases, None, float("nan")]], "v double")
    got = df.select("v", exact.one_decimal("v").alias("t")).collect()
    assert [(r["v"], r["t"]) for r in got if r["v"] is not None and r["v"] == r["v"] and r["t"] != f"{r['v']:.1f}"] == []
    assert [r["t"] for r in got[-2:]] == [None, None]
    assert "Python" not in df.select(exact.one_decimal("v"))._jdf.queryExecution().executedPlan().toString()


def test_stream_counters(spark, tmp_path):
    source = refresh.Replay(spark, spark.createDataFrame([], "v long, batch int").schema, f"{tmp_path}/in")
    source.add(spark.range(100).selectExpr("id v", "int(id % 3) batch"), "batch")
    heard = refresh.StreamCounters("told")
    spark.streams.addListener(heard)
    try:
        stream = source.stream("batch").observe("told", F.count("*").alias("rows"), F.count_if(F.col("v") >= 50).alias("large"))
        refresh.run_once(stream, lambda df, batch: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(heard)
    assert heard.sums == {"rows": 100, "large": 50}
    seen = Observation("once")
    spark.range(5).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 5}


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_prefixes(spark, most_bytes):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(300)] + [None, "zzz"]
    known = [("".join(rng.choice("abé") for _ in range(rng.randrange(0, 6))), rng.randrange(20)) for _ in range(60)] + [(None, 0)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, name string")
    found = prefixes.match(df, "name", spark.createDataFrame(known, "prefix string, rank int"), most_bytes)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) or most_bytes < 0
    got = {r["id"]: (r["first_prefix"], r["longest_prefix"]) for r in found.collect()}
    for k, t in enumerate(texts):
        fit = [(rank, p) for p, rank in known if t is not None and p is not None and t.startswith(p) and len(t) > len(p)]
        assert got[k] == ((min(fit)[1], max((p for _, p in fit), key=len)) if fit else (None, None))
    assert prefixes.match(df, "name", spark.createDataFrame([], "prefix string, rank int")).where("first_prefix is null").count() == len(texts)
