"""The guide from grid documents to published documents."""

import http.server
import json
import threading
import time
import urllib.parse

import pytest
from pyspark.sql import functions as F

from airgrid import job
from airgrid.functions import text
from airgrid.operators import dims, enrich, filters, icons, normalize, publish, view
from airgrid.sources import grid, tables, web
from airgrid.streaming import refresh

EVENT = {
    "startTime": "2025-08-06T02:00:00Z", "endTime": "2025-08-06T03:00:00Z", "duration": "60", "thumbnail": "p1", "seriesId": "SH00000001", "rating": "TV-14", "flag": ["New", "Finale"], "tags": ["CC", "CC"],
    "filter": ["filter-movie"], "program": {"id": "EP000000010002", "title": "Law & <Order>", "episodeTitle": None, "shortDesc": None, "season": "1", "episode": "5"},
}
CHANNEL = {"channelId": "10", "channelNo": "5.1", "callSign": "HISTORY", "affiliateName": "ABC", "thumbnail": "//cdn.example.com/a.png?w=55", "events": [EVENT, EVENT]}


def _grid(spark, tmp_path):
    bodies = {0: json.dumps({"channels": [CHANNEL]}), 1: json.dumps({"CHANNELS": [dict(CHANNEL, callSign="LATER"), dict(CHANNEL, channelId="11", channelNo="X", events=None)]}), 2: '{"channels": [{"channelId": 5}]}', 3: "not json"}
    for ts, body in bodies.items():
        (tmp_path / f"{ts}.json").write_text(body)
    return grid.read_grid(spark, start="0", slots="5", step="1", folder=str(tmp_path))


def _tables(spark, tmp_path):
    raw, airings = normalize.explode_grid(grid.decode(_grid(spark, tmp_path)))
    channels = normalize.to_channels(normalize.first_wins(raw, ["channel_id"], ["slot_ts", "pos"]))
    programs = normalize.to_programs(normalize.first_wins(airings, ["channel_id", "start_time", "end_time"], ["slot_ts", "pos", "event_pos"]))
    return channels, programs


def test_bad_slots_are_told_and_skipped(spark, tmp_path):
    rows = {r["slot_ts"]: r for r in _grid(spark, tmp_path).collect()}
    assert rows[0]["error"] is None and rows[1]["error"] is None
    assert "TypeError" in rows[2]["error"] and "JSONDecodeError" in rows[3]["error"] and "FileNotFoundError" in rows[4]["error"]


def test_first_occurrence_and_conversion(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    assert {(r["id"], r["call_sign"]) for r in channels.collect()} == {("10", "HISTORY"), ("11", "HISTORY")}
    (p,) = programs.collect()
    assert (p["title"], p["description"], p["start"]) == ("Law &amp; &lt;Order&gt;", "Unavailable", "20250806020000 +0000")
    assert [c["name"] for c in p["categories"]] == ["movie", "Series", "Finale"]
    assert [(e["system"], e["episode_number"]) for e in p["episode_numbers"]] == [("onscreen", "S01E05"), ("xmltv_ns", "0.4"), ("dd_progid", "EP00000001.0002")]
    assert len(p["subtitles"]) == 2 and p["new"] and not p["previously_shown"] and p["rating_system"] == "USA Parental Rating"


def test_json_view(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    got = {r["id"]: json.loads(r["body"]) for r in view.guide_json(channels, programs).collect()}
    assert got["11"]["programs"] is None
    (p,) = got["10"]["programs"]
    assert p["title"] == "Law & <Order>" and "description" not in p and "subTitle" not in p and p["isNew"] is True and p["start"] == "2025-08-06T02:00:00Z"


def test_document(spark, tmp_path):
    import xml.etree.ElementTree as E

    channels, programs = _tables(spark, tmp_path)
    publish.write_document(publish.document(channels, programs), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    root = E.fromstring(part.read_text().replace("<!DOCTYPE tv SYSTEM 'xmltv.dtd'>", ""))
    assert [c.get("id") for c in root.findall("channel")] == ["10", "11"]
    assert root.find("programme/title").text == "Law & <Order>" and len(root.findall("programme/subtitles")) == 2


def test_enrichment(spark, tmp_path):
    _, programs = _tables(spark, tmp_path)
    assert enrich.distinct_lookups(programs).first()["key"] == "movie:law & <order>"
    lookup = spark.createDataFrame([("movie:law & <order>", "u", 8.35, "2001", "a & b", 7, "fr", 0)], enrich.LOOKUP)
    r = enrich.enrich(programs, lookup).first()
    assert (r["icon_src"], r["star_rating"], r["date"], r["description"], r["orig_language"], r["enriched"]) == ("u", "8.3/10", "2001", "a &amp; b", "fr", True)
    assert r["episode_numbers"][-1]["episode_number"] == "7" and r["images"][0]["type"] == "poster"
    miss = spark.createDataFrame([("movie:law & <order>", "", 0.0, "2001", "x", 0, "fr", 0)], enrich.LOOKUP)
    r = enrich.enrich(programs, miss).first()
    assert not r["enriched"] and r["date"] == "" and r["description"] == "Unavailable"


def test_filter_before_enrich_is_the_same(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    allowed = spark.createDataFrame([("5.1",), ("",)], "number string")
    kept = filters.filter_channels(channels, filters.allowed_numbers(allowed))
    assert [r["id"] for r in kept.collect()] == ["10"]
    lookup = spark.createDataFrame([("movie:law & <order>", "u", 8.35, "2001", "a & b", 7, "fr", 0)], enrich.LOOKUP)
    a = filters.filter_programs(enrich.enrich(programs, lookup), kept).collect()
    b = enrich.enrich(filters.filter_programs(programs, kept), lookup).collect()
    assert a == b


def test_icons(spark, tmp_path):
    channels, _ = _tables(spark, tmp_path)
    known = spark.createDataFrame([(f"{dims.LOGO_BASE}/united-states/history-channel-us.png",)], "url string")
    out, cache = icons.resolve(channels.where("id = '10'"), known, dims.callsigns(spark), as_of=100)
    assert out.first()["icon_url"].endswith("/history-channel-us.png") and cache.first()["key"] == "channelId:10"
    again, fetched = icons.resolve(channels, known.limit(0), dims.callsigns(spark), cache=cache, as_of=200)
    assert {r["id"]: r["icon_url"] != "" for r in again.collect()} == {"10": True, "11": False} and [r["key"] for r in fetched.collect()] == ["channelId:11"]
    assert icons.resolve(channels, known, dims.callsigns(spark), country="FRA")[0].where("id = '10'").first()["icon_url"] == "http://cdn.example.com/a.png"


def test_snapshot_and_cache(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    publish.write_snapshot(channels, programs, str(tmp_path / "snap"), 1000)
    assert publish.read_snapshot(spark, str(tmp_path / "snap"), 1000 + 4 * 3600 - 1)[1].count() == 1
    assert publish.read_snapshot(spark, str(tmp_path / "snap"), 1000 + 4 * 3600) is None
    assert publish.read_snapshot(spark, str(tmp_path / "none"), 0) is None
    assert tables.read_cache(spark, str(tmp_path / "none"), enrich.LOOKUP).count() == 0
    (tmp_path / "items.json").write_text('{"Items": [{"ChannelNumber": "5"}, {"ChannelNumber": ""}, {}]}')
    assert [r[0] for r in filters.allowed_numbers(tables.recorder_numbers(spark, str(tmp_path / "items.json"))).collect()] == ["5"]
    assert tables.setting(spark, "AIRGRID_NOTHING", "x") == "x"


def test_rewrite_and_delay(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    c, _ = publish.rewrite_images(channels, programs, "http://p/")
    assert c.where("id = '10'").first()["icon_url"] == "http://p/img?url=http%3A%2F%2Fcdn.example.com%2Fa.png"
    assert refresh.next_delay_seconds(3600) == 82800 and refresh.next_delay_seconds(86000) == 3600


def test_slots(spark):
    rows = grid.slots(spark, "2025-08-06 17:00:00").orderBy("slot_ts").collect()
    assert len(rows) == 56 and rows[0]["slot_ts"] == 1754438400 and rows[-1]["slot_ts"] - rows[0]["slot_ts"] == 55 * 6 * 3600


def test_first_wins_is_idempotent(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (None, 1, "d"), (None, 1, "d")], "k int, o int, v string")
    once = normalize.first_wins(df, ["k"], ["o", "v"])
    assert sorted(once.collect(), key=str) == sorted(normalize.first_wins(once, ["k"], ["o", "v"]).collect(), key=str)
    assert {(r.k, r.v) for r in once.collect()} == {(1, "a"), (2, "c"), (None, "d")}
    assert once.where(F.col("k") == 1).count() == 1


class _Service(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def _answer(self, body):
        type(self).asked.append((time.monotonic(), self.path, self.headers.get("Authorization"), self.headers.get("X-Requested-Width")))
        status = 404 if "gone" in self.path else 200
        body = b"{ broken" if "broken" in self.path else body
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_GET(self):  # noqa: N802
        if "/search/" in self.path:
            self._answer(json.dumps({"results": [{"id": 7, "poster_path": "/p.jpg", "vote_average": 8, "overview": "o", "original_language": "fr", "first_air_date": "1999-01-01", "release_date": "2001-01-01"}]}).encode())
        else:
            ts = int(dict(urllib.parse.parse_qsl(self.path.partition("?")[2])).get("time", 0))
            self._answer(b"no" if ts == 1 else json.dumps({"channels": [{"channelId": "10", "channelNo": "5.1", "callSign": "HISTORY", "events": [{"startTime": "2025-08-06T02:00:00Z", "endTime": "2025-08-06T03:00:00Z", "duration": "60", "seriesId": "SH1", "filter": ["filter-movie"], "program": {"id": "EP10000", "title": f"Film {ts}"}}]}]}).encode())

    do_HEAD = do_GET  # noqa: N815

    def log_message(self, *_):
        pass


@pytest.fixture()
def service():
    _Service.asked = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_search_routes_and_keeps_its_pace(spark, service):
    keys = spark.createDataFrame([("a b", True, "movie:a b"), ("c", False, "tv:c"), ("gone", False, "tv:gone"), ("broken", False, "tv:broken")], "lookup_title string, movie boolean, key string").repartition(4)
    found = {r["key"]: r for r in enrich.project_results(web.search(keys, service, "t", gap=0.2)).collect()}
    assert (found["movie:a b"]["year"], found["tv:c"]["year"], found["tv:c"]["image_url"]) == ("2001", "1999", enrich.IMAGE_BASE + "/p.jpg")
    assert found["tv:gone"]["ref_id"] == found["tv:broken"]["ref_id"] == 0
    times = sorted(t for t, *_ in _Service.asked)
    assert {p for _, p, *_ in _Service.asked} >= {"/3/search/movie?query=a+b", "/3/search/tv?query=c"} and {a for _, _, a, _ in _Service.asked} == {"Bearer t"}
    assert times[-1] - times[0] > 0.4  # four requests, less what the first connection takes


def test_probe_and_images(spark, service):
    urls = spark.createDataFrame([(f"{service}/a.png",), (f"{service}/gone.png",), ("no url",)], "url string")
    assert [r["url"] for r in web.probe(urls, gap=0).collect()] == [f"{service}/a.png"]
    assert [(r["url"], r["content_type"]) for r in web.fetch_images(urls.where("url not like '%gone%'")).collect()] == [(f"{service}/a.png", "application/octet-stream")]


def test_grid_online(spark, service):
    rows = grid.read_grid(spark, start="0", slots="3", step="1", url=service, pause="0.2").orderBy("slot_ts").collect()
    assert [r["body"] is None for r in rows] == [False, True, False] and rows[1]["error"].startswith("JSONDecodeError")
    times = [t for t, *_ in sorted(_Service.asked)]
    assert times[1] - times[0] > 0.15 and {x for *_, x in _Service.asked} == {"XMLHttpRequest"}


def test_job(spark, service, tmp_path):
    """A whole run: everything is published, a second run asks for nothing that a cache holds, old copies go."""
    folder = f"file://{tmp_path}/guide"
    (tmp_path / "items.json").write_text('{"Items": [{"ChannelNumber": "5.1"}]}')
    known = f"{tmp_path}/known"
    spark.createDataFrame([(f"{dims.LOGO_BASE}/united-states/history-channel-us.png",)], "url string").write.parquet(known)
    s = job.Settings(folder, {"url": service, "slots": "3", "step": "1"}, search_url=service, search_token="t", recorder=str(tmp_path / "items.json"), filter_by_recorder=True, known_logos=known)
    searches = []
    for now in (0, 86_400, 90_000):
        before = len(_Service.asked)
        told = job.run_once(spark, s, now)
        searches.append(sum("/search/" in p for _, p, *_ in _Service.asked[before:]))
    assert searches == [1, 1, 0], "one request for a new title, none for what the cache holds"
    for k in range(9):
        (tmp_path / "guide" / f"xmlguide.1960010{k}.xmltv").write_text("old")
    assert told == {"programs": 1, "enriched": 1, "to_fix": 0, "channels": 1, "icons": 1, "kept": 1}
    names = publish.rotate(spark, folder, "19700103")
    assert len(names) == 7 and names[-1] == "xmlguide.19700103.xmltv" and "xmlguide.19600100.xmltv" not in names
    text = (tmp_path / "guide" / "xmlguide.xmltv").read_text()
    assert text.startswith("<?xml") and text.rstrip().endswith("</tv>") and "history-channel-us.png" in text and "<star-rating><value>8.0/10" in text
    told = json.loads((tmp_path / "guide" / "guide.json").read_text())
    assert told["generated"] == "1970-01-02T01:00:00Z" and [c["id"] for c in told["channels"]] == ["10"] and told["channels"][0]["programs"][0]["title"].startswith("Film")
    assert spark.table("guide_channels").count() == 1
    assert not [p for p in (tmp_path / "guide").iterdir() if "_staged" in p.name]
    assert publish.read_snapshot(spark, f"{folder}/snapshot", 90_000, f"{folder}/none.xmltv") is None
    lost = job.Settings(folder, s.grid, recorder=f"{tmp_path}/missing.json", filter_by_recorder=True, known_logos=known)
    broken = job.Settings(folder, s.grid, recorder=str(tmp_path / "broken.json"), filter_by_recorder=True, known_logos=known)
    (tmp_path / "broken.json").write_text('{"Items": [')
    for k, without in enumerate((lost, broken)):  # without its list nothing is filtered
        assert job.run_once(spark, without, (3 + k) * 86_400)["kept"] == 1
    assert not job.Settings(folder).enriches() and not job.Settings(folder, filter_by_recorder=True).filters()


def test_broken_files(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    publish.write_snapshot(channels, programs, f"file://{tmp_path}/snap", 1000)
    cache = spark.createDataFrame([("k", "u", 1, 2)], job.LOGO_CACHE)
    tables.write_cache(cache, f"file://{tmp_path}/cache")
    tables.write_cache(tables.read_cache(spark, f"file://{tmp_path}/cache", job.LOGO_CACHE), f"file://{tmp_path}/cache")
    assert tables.read_cache(spark, f"file://{tmp_path}/cache", job.LOGO_CACHE).count() == 1
    for f in [*tmp_path.glob("snap/channels/**/*.parquet"), *tmp_path.glob("cache/cache/**/*.parquet")]:
        f.write_bytes(b"not parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert publish.read_snapshot(spark, f"file://{tmp_path}/snap", 1000) is None
    assert tables.read_cache(spark, f"file://{tmp_path}/cache", job.LOGO_CACHE).count() == 0


def test_documents_of_nothing(spark, tmp_path):
    channels, programs = _tables(spark, tmp_path)
    path = f"file://{tmp_path}/guide.json"
    publish.publish_text(view.guide_document(view.guide_json(channels.limit(0), programs), "now"), path, ["section", "ord"])
    assert json.loads((tmp_path / "guide.json").read_text()) == {"generated": "now", "channels": []}
    publish.publish_document(publish.document(channels, programs), f"file://{tmp_path}/xmlguide.xmltv")
    assert (tmp_path / "xmlguide.xmltv").read_text().count("<channel ") == 2


def test_xml_unescape(spark):
    texts = ["a & b", "&amp;", "&lt;", "<&>", "&amp;lt;", "", "&eacute; &#39;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.xml_unescape(text.xml_escape("t")).alias("u"))
    assert all(r["t"] == r["u"] for r in df.collect())
