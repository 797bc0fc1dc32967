"""What is shuffled, held in a task or read at once stays small where tables grow."""

import os
import re

import pytest
from pyspark.sql import functions as F

from airgrid.plans import queries as plans

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_tables
def test_narrow_rows_are_ranked(spark):
    plan = plans._programs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window") :]
    assert "lpad" in plan and "lpad" not in below and "array(" not in below
    plan = plans.QUERIES["view_guide_json"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(channel#\d+, \d+\), ENSURE", plan), "programs are dealt by channel once"
    plan = plans.QUERIES["program_enrich"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "_asked" in plan and not re.search(r"Exchange hashpartitioning\(_asked", plan), "a small lookup goes to the programs"


@needs_tables
@pytest.mark.parametrize("name", ["program_full", "program_enrich", "xmltv_programme_fragment", "xmltv_document"])
def test_rows_are_ranked_before_parts_are_joined(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    ranked = plan[plan.index("windowspecdefinition(l_suppkey") :]
    ranked = ranked[: ranked.index("] parquet")]
    assert "l_orderkey" in ranked and "p_name" not in ranked and "channel_id" not in ranked


@needs_tables
def test_programmes_are_ordered_without_their_texts(spark):
    plan = plans.QUERIES["programme_order"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = [x[1] for x in re.finditer(r"ReadSchema: struct<([^>]*)>", plan) if "airgrid_row" in x[1]]
    assert read and not any("title" in r or "url" in r for r in read)


@needs_tables
@pytest.mark.parametrize("name", ["view_guide_json", "view_channel_schedule"])
def test_channels_are_dealt_without_what_is_made_of_them(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "date_trunc" in plan and "date_trunc" not in plan[plan.index("RepartitionByExpression") :]


@needs_tables
@pytest.mark.parametrize("name", ["view_guide_json", "view_channel_schedule"])
def test_channels_are_nested_in_small_tasks(spark, monkeypatch, name):
    """More rows make more tasks, not larger ones, and what is nested isn't sorted for the join with its channel."""
    want = sorted(plans.QUERIES[name](spark, SF).collect())
    monkeypatch.setattr(plans, "DEALT", 500, raising=False)
    most = plans._programs(spark, SF, by_channel=True).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < plans._programs(spark, SF).count() / 2
    rows = plans.QUERIES[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"SortMergeJoin \[id#\d+\], \[channel#", plan) and len(re.findall(r"Exchange hashpartitioning\([^)]*(?:suppkey|channel|id)#[^)]*\)?, 13\)", plan)) == 2
    assert sorted(rows.collect()) == want


@needs_tables
@pytest.mark.parametrize("name", ["program_full", "programme_order", "program_enrich"])
def test_odd_parts_and_keys(spark, tmp_path, name):
    """Airings without a part aren't ranked, a part told twice counts once, and programmes without a channel or a start come last."""
    duckdb = pytest.importorskip("duckdb")
    line = "case when l_orderkey % 7 = 3 then l_partkey + 1000000 when l_orderkey % 11 = 5 then null else l_partkey end l_partkey, case when l_orderkey % 13 = 1 then null else l_suppkey end l_suppkey, case when l_orderkey % 17 = 1 then null else l_shipdate end l_shipdate"
    duckdb.sql(f"copy (select * replace ({line.replace(' end ', ' end as ')}) from '{SF}/lineitem.parquet' union all select * from '{SF}/lineitem.parquet' where l_orderkey % 3 = 0) to '{tmp_path}/lineitem.parquet' (format parquet)")
    duckdb.sql(f"copy (select * from '{SF}/part.parquet' union all select * from '{SF}/part.parquet' where p_partkey % 3 = 0) to '{tmp_path}/part.parquet' (format parquet)")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    con.sql(f"create view supplier as select * from '{SF}/supplier.parquet'")
    got = plans.QUERIES[name](spark, str(tmp_path))
    rows = con.sql(f"select {', '.join(got.columns)} from ({plans.SQL[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, rows))


@needs_tables
@pytest.mark.parametrize("name", ["grid_decode_dedup", "stream_grid_source"])
def test_listing_documents_are_small(spark, monkeypatch, name):
    monkeypatch.setattr(plans, "LISTED", 10)
    home, n, parts = plans._grid_files(spark, SF)
    bodies = spark.read.text(home, wholetext=True, pathGlobFilter="*.json").selectExpr("length(value) n").collect()
    assert parts > 5 and n == 240 * parts and max(r["n"] for r in bodies) < 20_000 and len(bodies) > 300
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((r for r in plans.QUERIES[name](spark, SF).collect()), key=key)
    monkeypatch.undo()
    assert got == sorted(plans.QUERIES["grid_decode_dedup"](spark, SF).collect(), key=key)


def test_a_slot_is_a_batch_of_its_own(tmp_path):
    from airgrid.sources import grid

    for k in range(3):
        (tmp_path / f"{k}.json").write_text('{"channels": []}')
    reader = grid.GridReader({"start": "0", "slots": "4", "step": "1", "folder": f"file://{tmp_path}"})
    batches = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in batches] == [1, 1, 1, 1] and [b.column(1)[0].is_valid for b in batches] == [True, True, True, False]


def test_first_wins_is_combined_before_the_shuffle(spark):
    from airgrid.streaming import state

    rows = spark.createDataFrame([(1, "a", 1, None)], "second long, key string, pos long, what map<string,int>").withColumn("ts", F.timestamp_seconds("second"))
    plan = state.first_wins(rows, ["key"], ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Python" not in plan and "InPandas" not in plan


def test_a_replayed_batch_has_many_files(spark, tmp_path):
    from airgrid.streaming import refresh

    source = refresh.Replay(spark, spark.createDataFrame([], "v long, batch int").schema, f"{tmp_path}/in", files=5)
    source.add(spark.range(1000).selectExpr("id v", "int(id % 3) batch"), "batch")
    source.add(spark.createDataFrame([(7000, 3)], "v long, batch int"), "batch")
    told = []
    refresh.run_once(source.stream("batch"), lambda df, batch: told.append(sorted(r["v"] for r in df.collect())), f"{tmp_path}/checkpoint")
    assert told == [list(range(k, 1000, 3)) for k in range(3)] + [[7000]]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 20


def test_lines_are_read_by_stretches(spark, tmp_path):
    from airgrid.sources import xmltv

    text = spark.range(3000).selectExpr("2 section", "lpad(id, 6, '0') k1", "'' k2", "'' k3", "concat('line ', id, if(id % 3 = 0, '\\n\\n', ''), if(id % 7 = 0, 'a\\rb', '')) value")
    xmltv.write_xmltv(text, str(tmp_path))
    want = "\n".join(f"line {i}" + ("\n\n" if i % 3 == 0 else "") + ("a\rb" if i % 7 == 0 else "") for i in range(3000)).split("\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = xmltv.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > len(xmltv.manifest(spark, str(tmp_path))["parts"]) and "wholetext" not in lines._jdf.queryExecution().executedPlan().toString()
        assert [(r["line_no"], r["line"]) for r in lines.orderBy("line_no").collect()] == list(enumerate(want, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cut_off_references_stay(spark):
    from airgrid.functions import exact

    cases = {"and&amp</title>": "and&amp</title>", "&amp;amp &quot &#65; &#65 &copy;&nope; &ampx;": "&amp &quot A &#65 ©&nope; &ampx;", None: None}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", exact.html_unescape("t").alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == cases


def test_usual_documents_are_not_looked_at_field_by_field(spark, tmp_path, monkeypatch):
    import json

    from airgrid.sources import grid

    event = {"startTime": "s", "endTime": None, "flag": ["New", None], "tags": [], "filter": None, "program": {"id": "p", "title": 'T "é"', "more": {"a b": 1.5, "c": "x"}}}
    usual = [{"channels": [{"channelId": "1", "x: STRING, y": 1, "events": [event, None, {}]}, None], "other": [1, 2]}, {"channels": []}, {"channels": None}, {}, None, {"`": {"channelid": 3}}]
    odd = [{"Channels": []}, {"channels": [{"events": [dict(event, rating=5)]}]}, {"channels": [{"channelId": "1"}, {"channelId": 1}]}, {"channels": [{"channelID": "1"}]}, {"channels": [{"events": [{"program": {"ID": "a", "id": "b"}}]}]}, []]
    texts = [json.dumps(d) for d in usual + odd] + ['{"channels": []} {"channels": []}', '{"channels": [], "channels": []}', '{},"00000000000000000000000000000000":0}']
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, raw string")
    told = {r["k"]: r["c"] for r in rows.select("k", grid.checked("raw").alias("c")).collect()}
    plain = lambda v: {k: plain(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    for k, text in enumerate(texts[:-3]):
        try:
            want = plain(json.loads(grid.strict(text)))
        except TypeError:
            want = None
        assert (told[k]["body"] and plain(json.loads(told[k]["body"]))) == want and (told[k]["error"] is None) == (want is not None), text
    assert all(told[k]["body"] is None and told[k]["error"] for k in range(len(texts) - 3, len(texts)))

    # Field by field no document is taken any more; usual ones still are.
    none = lambda v, shape: F.struct(F.lit(False).alias("ok"), F.lit(None).cast(grid.GRID_TYPE).alias("value"))
    monkeypatch.setattr(grid, "_fitted", none)
    taken = {r["k"] for r in rows.select("k", grid.checked("raw").alias("c")).where("c.error is null").collect()}
    assert taken == set(range(len(usual) - 1)), "the last has a key that needs quotes twice"

    # A document is parsed once, and no text is moved to find out which are missing.
    (tmp_path / "1.json").write_text(texts[0])
    read = grid.read_grid(spark, start="0", slots="3", step="1", folder=str(tmp_path))
    plan = grid.decode(read)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("VariantExpressionEvalUtils") <= 2 and plan.count("Generate inline") == 1, plan
    assert sorted((r["slot_ts"], r["error"]) for r in read.collect()) == [(0, "FileNotFoundError"), (1, None), (2, "FileNotFoundError")]
    whole = read._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in whole and "Exchange hashpartitioning" not in whole


def test_a_document_is_packed_and_digested_where_it_lies(spark, tmp_path):
    import gzip
    import hashlib

    from airgrid.sources import xmltv

    text = spark.range(3000).selectExpr("2 section", "lpad(id, 6, '0') k1", "'' k2", "'' k3", "concat('line é ', id, if(id % 3 = 0, '\\n\\n', '')) value")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        xmltv.write_xmltv(text, str(tmp_path), compression="gzip")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = "\n".join(f"line é {i}" + ("\n\n" if i % 3 == 0 else "") for i in range(3000))
    parts = xmltv.manifest(spark, str(tmp_path))["parts"]
    packed = b"".join((tmp_path / p["name"]).read_bytes() for p in parts)
    assert len(parts) > 1 and gzip.decompress(packed).decode() == want + "\n" and 4 * len(packed) < len(want)
    assert sum(p["size"] for p in parts) == len(want.encode()) + 1
    lines = xmltv.read_lines(spark, str(tmp_path))
    rows = want.split("\n")
    for size in (1, 7, 1000, 10_000):
        cut = {k // size: rows[k : k + size] for k in range(0, len(rows), size)}
        for told in (xmltv.digests(lines, size), xmltv.digests(lines.repartition(3), size)):
            assert {r["chunk"]: (r["lines"], r["code"]) for r in told.collect()} == {k: (len(x), hashlib.md5("\n".join(x).encode()).hexdigest()) for k, x in cut.items()}
    assert "MapInArrow" in xmltv.digests(lines, 100)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        xmltv.XmltvWriter(str(tmp_path), "zip")
