"""The cache that is dealt by key, and strict decoding in the engine against the same rule in Python."""

import json

import pytest
from pyspark.sql import functions as F

from airgrid.sources import grid
from airgrid.sources.keyed import KeyedCache


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, v long")


def content(cache):
    return sorted((r["key"], r["v"]) for r in cache.read().collect())


def test_merge_touches_its_slices_only(spark, tmp_path):
    cache = KeyedCache(spark, f"file://{tmp_path}/c", "key string, v long", slices=8, buckets=4)
    assert content(cache) == [] and cache.merge(rows(spark).limit(0)) == []
    cache.merge(spark.range(200).selectExpr("concat('k', id) key", "id v"))
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    touched = cache.merge(rows(spark, ("k5", -5), ("new", 1)))
    assert 1 <= len(touched) <= 2
    assert content(cache) == sorted([(f"k{i}", i) for i in range(200) if i != 5] + [("k5", -5), ("new", 1)])
    assert {p: p.stat().st_mtime_ns for p in before} == before, "no file is written anew"
    fresh = {p.parent.name for p in tmp_path.rglob("*.parquet") if p not in before}
    assert fresh == {f"slice={k}" for k in touched}
    cache.merge(rows(spark, ("k5", -6)), valid=F.col("v") < 0)
    assert ("k5", -6) in content(cache) and cache.vacuum() == []
    for _ in range(2):
        cache.merge(spark.range(200).selectExpr("concat('k', id) key", "-id v"))
    assert len(cache.vacuum()) == 3, "all but this version and the one before"
    assert sorted(content(cache)) == sorted([(f"k{i}", -i) for i in range(200)] + [("new", 1)] * (("new", 1) in content(cache)))


def test_a_probe_moves_no_row_of_the_cache(spark, tmp_path):
    cache = KeyedCache(spark, f"file://{tmp_path}/c", "key string, v long", slices=4, buckets=4)
    cache.merge(spark.range(500).selectExpr("concat('k', id) key", "id v"))
    keys = spark.range(900).selectExpr("concat('k', id) key")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = keys.join(cache.read(), "key")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert hits.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount" in plan
    cache_side = plan[: plan.index("FileScan")].rsplit("+-", 4)
    assert not any("Exchange" in x for x in cache_side[-2:])
    cache.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("airgrid_cache_")]


def test_a_crash_leaves_the_cache(spark, tmp_path):
    cache = KeyedCache(spark, f"file://{tmp_path}/c", "key string, v long")
    cache.merge(rows(spark, ("a", 1), ("b", 2)))
    with pytest.raises(Exception, match="crash"):
        cache.merge(rows(spark, ("a", 9)).withColumn("v", F.raise_error(F.lit("crash")).cast("long")))
    assert content(cache) == [("a", 1), ("b", 2)]


EVENT = {"startTime": "s", "endTime": None, "duration": "60", "flag": ["New", None], "tags": [], "filter": None, "program": {"id": "p", "TITLE": 'T "é"\n', "shortDesc": None, "other": [1, {"x": 2}]}}
DOCUMENTS = [
    {"channels": []}, {"channels": None}, {}, None, {"CHANNELS": [{"channelID": "1", "callsign": "C", "events": [EVENT, {}, None]}]}, {"channels": [None, {"events": None}]},
    {"channels": [{"channelId": 5}]}, {"channels": {"a": 1}}, {"channels": "x"}, [], 5, "text", True, {"channels": [[]]}, {"channels": [{"events": [{"flag": "New"}]}]}, {"channels": [{"events": [{"flag": [1]}]}]},
    {"channels": [{"events": [{"program": []}]}]}, {"channels": [{"events": [{"program": {"season": 2}}]}]}, {"other": {"channels": 1}}, {"channels": [{"channelNo": "1", "CHANNELNO": "1", "x": 1.5}]}, {"channels": [{"events": [{"tags": {}}]}]},
    {"channels": [{"channelId": True}]}, {"channels": [{"channelId": "<&> \\"}]},
]


def test_strict_in_the_engine(spark):
    bodies = [json.dumps(d) for d in DOCUMENTS] + ["", " ", "{", '{"channels": [}', "nope", '{"channels": []} x', '{"channels": []}  \n', None]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, raw string")
    told = df.select("k", grid.checked("raw").alias("c")).select("k", "c.body", "c.error")
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString()

    def want(body):
        try:
            return json.loads(grid.strict(body))
        except (ValueError, TypeError):
            return None

    def plain(value):
        """Without what is null, which JSON of the engine leaves out."""
        if isinstance(value, dict):
            return {k: plain(v) for k, v in value.items() if v is not None}
        return [plain(v) for v in value] if isinstance(value, list) else value

    for r in told.collect():
        expected = want(bodies[r["k"]])
        assert (r["body"] is None) == (expected is None) == (r["error"] is not None), (bodies[r["k"]], r)
        if expected is not None:
            assert plain(json.loads(r["body"])) == plain(expected)
