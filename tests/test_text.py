"""Scalar functions against edge rows."""

import pytest
from pyspark.sql import functions as F

from airgrid.functions import exact, text
from airgrid.operators import enrich, filters, normalize, view

CASES = [
    (text.iso_to_xmltv, "2025-08-06T02:00:00Z", "20250806020000 +0000"),
    (text.iso_to_xmltv, "2025-08-06T02:00:00-05:00", "202508060200000500"),
    (text.xmltv_to_iso, "20250225200000 +0000", "2025-02-25T20:00:00Z"),
    (text.xmltv_to_iso, "2025 +0000", "2025"),
    (text.icon_url, "//a/b?c=1?d", "http://a/b"),
    (text.icon_url, "///?x", ""),
    (text.icon_url, "", ""),
    (text.title_case, "hBO mcDONALD  tv x", "HBO McDONALD  Tv X"),
    (text.slugify, "A&E! Net  TV", "a-and-e-net-tv"),
    (text.normalize_affiliate, "acme broadcasting company", "acme"),
    (text.parse_int, " 5", 0),
    (text.parse_int, "5.0", 0),
    (text.parse_int, "", 0),
    (text.parse_int, None, 0),
    (text.parse_int, "+5", 5),
    (text.parse_int, "007", 7),
    (text.parse_int, "5\n", 0),
    (text.query_escape, "c d?~*é+", "c+d%3F~%2A%C3%A9%2B"),
    (text.xml_escape, 'a & <b> "c"', 'a &amp; &lt;b&gt; "c"'),
    (exact.html_unescape, "a &amp;lt; &middot; b", "a &lt; · b"),
    (filters.image_url_allowed, "https://IMAGE.tmdb.org:443/x", True),
    (filters.image_url_allowed, "http://zap2it.tmsimg.com/x", False),
    (filters.image_url_allowed, None, False),
    (filters.valid_id, "0aF-9", True),
    (filters.valid_id, "0aF-9\n", False),
    (filters.valid_id, "", False),
] + [(text.bare_callsign, c, b) for c, b in [("maxhdp", "max"), ("toonp", "toon"), ("up", "up"), ("hd", "hd"), ("pppp", "pp"), ("hsdp", "hsd"), ("kabc-dt2", "kabc"), ("wabc-tv", "wabc"), ("shop", "sho"), ("", "")]]


def test_cases(spark):
    row = spark.range(1).select(*[f(F.lit(x)).alias(f"c{i}") for i, (f, x, _) in enumerate(CASES)]).first()
    assert [(f.__name__ if hasattr(f, "__name__") else str(f), x, row[i]) for i, (f, x, _) in enumerate(CASES)] == [(f.__name__ if hasattr(f, "__name__") else str(f), x, y) for f, x, y in CASES]


@pytest.mark.parametrize("value, told", [(8.35, "8.3"), (7.25, "7.2"), (0.25, "0.2"), (9.0, "9.0")])
def test_one_decimal(spark, value, told):
    assert spark.range(1).select(exact.one_decimal(F.lit(value))).first()[0] == told


def test_episode_numbers(spark):
    rows = spark.createDataFrame([("SH1", "EP10000"), ("SH1", "EP10002"), ("SH1", "E1"), ("ASHSH", "x1234")], "series_id string, program_id string")
    assert [r[0] for r in rows.select(normalize.dd_progid()).collect()] == ["SH1.0000", "EP1.0002", "EP1.", "AEPSH.1234"]
    pair = lambda s, e: (normalize.onscreen(F.lit(s), F.lit(e)), normalize.xmltv_ns(F.lit(s), F.lit(e)))
    got = spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate([*pair(1, 5), *pair(0, -3), *pair(1, 105), *pair(0, 5)])]).first()
    assert list(got) == ["S01E05", "0.4", "S00E-3", ".-4", "S01E105", "0.104", "S00E05", ".4"]


def test_channel_order(spark):
    rows = spark.createDataFrame([(n,) for n in ["10", "X", "9.1", ""]], "number string")
    assert [r[0] for r in rows.orderBy(*view.channel_order()).collect()] == ["", "9.1", "10", "X"]


def test_image_host_once(spark):
    row = spark.range(1).select(F.lit("http://zap2it.tmsimg.com/zap2it.tmsimg.com").alias("icon_src"), F.array().cast(normalize._IMAGES).alias("images"))
    assert enrich.fix_image_host(row).first()["icon_src"] == "http://tmsimg.com/zap2it.tmsimg.com"
