"""Archives written and read back."""

import gzip
import hashlib

from pyspark.sql import functions as F

from airgrid.llm.queries import op4_warc
from airgrid.llm.warc import read_warc, write_warc

PAGE = "page_id long, url string, html string, bytes int, digest string, place long, payload string"


def _pages(spark):
    long_ = "<p>é" + "x" * 200 + "</p>"
    html = [long_, long_, long_ + "y", None, "", "short", "short", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "z" * 100, "x" * 100, "x" * 100, "x" * 99, "x" * 99, long_, "big" * 400_000]
    urls = ["http://a/é", None, "http://b/\r\nX: y", ""] + [f"http://c/{i}?a=1" for i in range(len(html) - 4)]
    rows = [(20 - i if i != 6 else None, u, h, 1, "d", 1, "p") for i, (u, h) in enumerate(zip(urls, html, strict=True))]
    return spark.createDataFrame([*rows, rows[0]], PAGE)  # a row twice


def test_round_trip(spark, tmp_path):
    pages = _pages(spark)
    pages.coalesce(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = op4_warc(spark, str(tmp_path)).collect()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    assert sorted((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((i or -1, len(b), hashlib.sha256(b).hexdigest()) for i, b in rows)
    least = {}
    for i, b in rows:
        if len(b) >= 100:
            least[hashlib.sha256(b).hexdigest()] = min(i, least.get(hashlib.sha256(b).hexdigest(), i))
    for digest, first in least.items():
        same = [r for r in got if r["payload_digest"] == digest]
        assert [r["page_id"] for r in same if r["record_type"] == "response"] == [first]
        assert all(r["refers_to"] == first for r in same if r["record_type"] == "revisit")
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] < 100)


def test_pushdown_and_payloads(spark, tmp_path):
    table = _pages(spark)
    table.write.parquet(f"{tmp_path}/pages")
    write_warc(spark.read.parquet(f"{tmp_path}/pages"), f"file://{tmp_path}/archive")
    back = read_warc(spark, f"file://{tmp_path}/archive").where("record_type = 'response' and target_uri like 'http://c/%'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "(Python)" in plan and "Filter " not in plan.replace("RuntimeFilters", "")  # the source took all filters
    want = {r["url"]: (r["html"] or "").encode() for r in table.collect() if (r["url"] or "").startswith("http://c/")}
    got = {r["target_uri"]: bytes(r["payload"]) for r in back.collect()}
    assert got and all(want[u] == b for u, b in got.items())
    assert {r["payload"] for r in read_warc(spark, f"file://{tmp_path}/archive", payload=False).collect()} == {None}
    assert read_warc(spark, f"file://{tmp_path}/archive").where(F.col("payload_digest").isin(["no"])).count() == 0
    assert read_warc(spark, f"file://{tmp_path}/archive").where("target_uri = 'http://b/X: y'").count() == 1


def test_compressed_and_foreign(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    rows = read_warc(spark, f"file://{tmp_path}/one").collect()
    assert [(r["record_type"], bytes(r["payload"]), r["payload_bytes"]) for r in rows] == [("warcinfo", b"hello", 5)] * 2
    write_warc(_pages(spark).limit(0), f"file://{tmp_path}/none")
    assert read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_store_of_spark_only(spark, tmp_path):
    """A store that has no client but Hadoop's gives the same records."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.told.link./store", f"file://{tmp_path}")
    pages = _pages(spark)
    write_warc(pages, "viewfs://told/store/archive", file_bytes=1 << 20)
    columns = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    plain = lambda df: sorted(map(str, df.select(*columns).collect()))
    want = plain(read_warc(spark, f"file://{tmp_path}/archive", verify=True))
    assert len(want) == pages.count() and plain(read_warc(spark, "viewfs://told/store/archive", verify=True)) == want
    far = read_warc(spark, "viewfs://told/store/archive", payload=False)
    assert far.where("record_type = 'revisit'").count() == sum("'revisit'" in w for w in want)
    assert {r["payload"] for r in far.collect()} == {None}


def test_rows_that_are_not_read_alike_twice(spark, tmp_path):
    """One response for each payload though the table's order changes between scans."""
    pages = spark.range(400).select((F.col("id") % 4).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x" * 120), (F.col("id") % 2).cast("string")).alias("html")).orderBy(F.rand())
    write_warc(pages, f"file://{tmp_path}/archive")
    rows = read_warc(spark, f"file://{tmp_path}/archive", payload=False).collect()
    assert len(rows) == 400 and sum(r["record_type"] == "response" for r in rows) == 2
    assert {r["refers_to"] for r in rows} - {None} == {r["record_id"] for r in rows if r["record_type"] == "response"}
