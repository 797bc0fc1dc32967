"""Streams that stop and go on: offsets, state and its end."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from airgrid.sources import grid
from airgrid.streaming import refresh, state

DAY = 86400


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            ts = int(parse_qs(urlparse(self.path).query)["time"][0])
            asked.append(ts)
            self.send_response(500 if ts == 3 else 200)
            self.end_headers()
            if ts != 3:
                self.wfile.write(json.dumps({"channels": [{"channelId": f"c{ts}"}]}).encode())

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", asked
    s.shutdown()


def test_slots_go_on_after_a_stop(spark, server, tmp_path):
    url, asked = server
    for until in (5, 5, 8):
        slots = grid.stream_grid(spark, url=url, start="0", step="1", until=str(until), streams="2")
        refresh.run_once(slots, lambda df, batch: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
    assert sorted(asked) == list(range(8)), "each slot once, the failed one too"
    rows = {r["slot_ts"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sorted(rows) == list(range(8))
    assert rows[3]["body"] is None and "500" in rows[3]["error"]
    assert json.loads(rows[4]["body"]) == {"channels": [{"channelId": "c4"}]} and rows[4]["error"] is None


def test_the_rule_of_a_document_is_made_once(monkeypatch):
    """The shape is not walked for each value: made for one document, its rule serves all."""
    monkeypatch.setattr(grid, "_SHAPE", {"nothing": str})
    text = '{"CHANNELS": [{"channelid": "1", "other": 1, "events": [{"flag": ["a", null], "program": {"ID": "x", "id": null}}, null]}]}'
    assert json.loads(grid.strict(text)) == {"channels": [{"channelId": "1", "events": [{"flag": ["a", None], "program": {"id": None}}, None]}]}
    for bad in ('{"channels": [{"events": [{"program": {"season": true}}]}]}', '{"channels": [{"events": [{"tags": [1]}]}]}', '{"channels": {}}', "[]", "1"):
        with pytest.raises(TypeError):
            grid.strict(bad)


def test_slots_come_due_by_the_clock(monkeypatch):
    monkeypatch.setattr(grid.time, "time", lambda: 10_000)
    reader = grid.GridStream({"start": "4000", "step": "1000", "slots": "3"})
    assert reader.initialOffset() == {"slot": 0} and reader.latestOffset() == {"slot": 9}
    assert [p.slots for p in reader.partitions({"slot": 7}, {"slot": 9})] == [[11000, 12000]]
    assert list(reader.partitions({"slot": 9}, {"slot": 9})) == []


class Steps:
    """One query that is given its batches one by one, each in a run of its own from the same checkpoint."""

    def __init__(self, spark, tmp_path, schema, build):
        self.spark, self.home, self.build = spark, tmp_path, build
        self.source = refresh.Replay(spark, spark.createDataFrame([], schema + ", batch int").schema, f"{tmp_path}/in")
        self.schema, self.n = schema, 0

    def step(self, rows):
        self.n += 1
        self.source.add(self.spark.createDataFrame(rows, self.schema).withColumn("batch", F.lit(self.n)), "batch")
        out = f"{self.home}/out{self.n}"
        stream = self.build(self.source.stream("batch").withColumn("ts", F.timestamp_seconds("second")))
        refresh.run_once(stream, lambda df, batch: df.write.mode("append").parquet(out), f"{self.home}/checkpoint")
        try:
            return [r.asDict() for r in self.spark.read.schema(stream.schema).parquet(out).collect()]
        except Exception:  # nothing was given out
            return []


def test_first_wins_whenever_it_arrives(spark, tmp_path):
    build = lambda s: state.first_wins(s, ["key"], ["slot", "pos"], horizon="10 days", delay="1 day")
    steps = Steps(spark, tmp_path, "second long, key string, slot long, pos long, what string, cost double", build)
    assert steps.step([(2 * DAY, "a", 5, 0, "late slot", 0.1), (2 * DAY, "b", 1, 7, None, None)]) == []
    assert steps.step([(3 * DAY, "a", 2, 9, "first", 8.35), (3 * DAY, "a", 2, 10, "same slot, later place", 1.0), (9 * DAY, "c", 1, 1, 'q"é\n', 1e-7)]) == []
    assert steps.step([(4 * DAY, "a", 3, 0, "between", 2.0), (10 * DAY + 5, "a", 9, 9, "next run", 3.0)]) == []
    got = steps.step([(11 * DAY + 1, None, None, None, None, None)])  # the watermark passes the run's end
    assert sorted((r["key"], r["slot"], r["pos"], r["what"], r["cost"], r["second"]) for r in got) == [("a", 2, 9, "first", 8.35, 3 * DAY), ("b", 1, 7, None, None, 2 * DAY), ("c", 1, 1, 'q"é\n', 1e-7, 9 * DAY)]
    # What comes after a run's end is too late, and a run has no state then.
    assert steps.step([(4 * DAY, "a", 0, 0, "too late", 1.0), (12 * DAY, None, None, None, None, None)]) == []
    got = steps.step([(30 * DAY, None, None, None, None, None)])
    assert [(r["key"], r["what"]) for r in got] == [("a", "next run")]


def test_answers_are_kept_as_long_as_they_hold(spark, tmp_path):
    steps = Steps(spark, tmp_path, "second long, key string, ttl long, answer string", lambda s: state.kept_answers(s))
    told = lambda rows: sorted((r["key"], r["asked_at"], r["n"], r["fetched"], r["fetched_at"], r["answer"]) for r in rows)
    week, month = 7 * DAY, 30 * DAY
    assert told(steps.step([(1, "t", week, "one"), (1, "t", week, "one"), (5, "none", week, None), (5, "logo", month, "l")])) == [("logo", 5, 1, True, 5, "l"), ("none", 5, 1, True, 5, None), ("t", 1, 2, True, 1, "one")]
    # A restart keeps what is held, misses too; it holds at exactly seven days and not a second longer.
    assert told(steps.step([(week + 1, "t", week, "two"), (week + 5, "none", week, "found")])) == [("none", week + 5, 1, False, 5, None), ("t", week + 1, 1, False, 1, "one")]
    assert told(steps.step([(week + 6, "none", week, "found"), (week + 6, "t", week, "two"), (week + 6, "logo", month, "x")])) == [("logo", week + 6, 1, False, 5, "l"), ("none", week + 6, 1, True, week + 6, "found"), ("t", week + 6, 1, True, week + 6, "two")]
    assert told(steps.step([(month + 5, "logo", month, "new"), (month + 6, "logo", month, "new")])) == [("logo", month + 5, 1, False, 5, "l"), ("logo", month + 6, 1, True, month + 6, "new")]
    assert told(steps.step([(month + 7, "t", week, "three")])) == [("t", month + 7, 1, True, month + 7, "three")]
