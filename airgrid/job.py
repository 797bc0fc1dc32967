"""The whole run: slots, dedup, enrichment, icons, filter, publication; once or once a period.

``python -m airgrid.job --folder /shared/guide --once`` with settings as in :func:`airgrid.sources.tables.setting`.
"""

from __future__ import annotations

import argparse
import signal
import threading
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dims, enrich, filters, icons, normalize, publish, view
from .operators.versions import Versions
from .session import ship
from .sources import grid, tables, web
from .streaming import refresh

LOGO_CACHE = "key string, logo_url string, fetched_at long, matcher_version int"


@dataclass
class Settings:
    """What a run needs; an empty setting turns its part off."""

    folder: str  # in a store that all executors see
    grid: dict[str, str] = field(default_factory=dict)  # options of the listing grid but start
    lang: str = "en"
    country: str = "USA"
    search_url: str = "https://api.themoviedb.org"
    search_token: str = ""
    recorder: str = ""  # the recorder's channel list as a file
    filter_by_recorder: bool = False
    known_logos: str = ""  # a table of URLs that are there; without it candidates are asked for
    callsigns: str = ""
    proxy: str = ""

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Settings:
        told = lambda key, fallback="": tables.setting(spark, key, fallback)
        options = {k: v for k in ("url", "zipcode", "headend", "lineupid", "device", "language", "pause") if (v := told(f"GRID_{k.upper()}", {"pause": "5"}.get(k, "")))}
        return cls(
            folder, options, told("GUIDE_LANGUAGE", "en"), told("GUIDE_COUNTRY", "USA"), told("SEARCH_URL", cls.search_url), told("SEARCH_TOKEN"),
            told("RECORDER_LIST"), told("RECORDER_FILTER") != "", told("KNOWN_LOGOS"), told("CALLSIGNS"), told("BASE_URL"),
        )

    def enriches(self) -> bool:
        return self.search_token != ""

    def filters(self) -> bool:
        return self.filter_by_recorder and self.recorder != ""


def build(spark: SparkSession, s: Settings, now: int) -> tuple[DataFrame, DataFrame, enrich.Counters]:
    """Channels, programs and counters (told when both are written) of a run at ``now`` (Unix seconds); caches in the folder are brought up to date."""
    raw = grid.read_grid(spark, **({"start": str(now - now % 86400)} | s.grid))
    tables.write_cache(raw, f"{s.folder}/cache/slots")  # one request a slot, whatever reads the slots afterwards
    raw = tables.read_cache(spark, f"{s.folder}/cache/slots", "slot_ts long, body string, error string")
    raw_channels, airings = normalize.explode_grid(grid.decode(raw))
    channels = normalize.to_channels(normalize.first_wins(raw_channels, ["channel_id"], ["slot_ts", "pos"]))
    programs = normalize.to_programs(normalize.first_wins(airings, ["channel_id", "start_time", "end_time"], ["slot_ts", "pos", "event_pos"]), s.lang, s.country)
    if s.enriches():
        at = f"{s.folder}/cache/lookups"
        cache = tables.read_cache(spark, at, enrich.LOOKUP)
        asked = web.search(enrich.missing_keys(enrich.distinct_lookups(programs), cache, now), s.search_url, s.search_token)
        tables.write_cache(enrich.project_results(asked), f"{s.folder}/cache/asked")  # one request a title, though the merge reads them twice
        fetched = tables.read_cache(spark, f"{s.folder}/cache/asked", enrich.LOOKUP.rpartition(",")[0])
        tables.write_cache(enrich.merge_cache(cache, fetched, now), at)
        programs = enrich.enrich(programs, tables.read_cache(spark, at, enrich.LOOKUP))
    else:
        programs = programs.withColumn("enriched", F.lit(False))
    counters = enrich.Counters()
    programs = enrich.fix_image_host(counters.programs(programs))
    signs, at = dims.callsigns(spark, s.callsigns or None), f"{s.folder}/cache/logos"
    cache = tables.read_cache(spark, at, LOGO_CACHE)
    if s.known_logos:
        known = spark.read.parquet(s.known_logos)
    else:
        tried = icons.candidates(channels, signs).select(F.explode("slugs").alias("slug"))
        known = web.probe(tried.select(icons.logo_url(F.col("slug"), s.country).alias("url"))) if s.country in dims.COUNTRIES else spark.createDataFrame([], "url string")
    resolved, fetched = icons.resolve(channels, known, signs, s.country, cache, now)
    tables.write_cache(icons.valid_cache(cache, now).unionByName(fetched), at)
    resolved, _ = icons.resolve(channels, known.limit(0), signs, s.country, tables.read_cache(spark, at, LOGO_CACHE), now)
    kept = counters.channels(resolved)
    allowed = _allowed(spark, s) if s.filters() else None
    if allowed is not None:
        kept = filters.filter_channels(kept, allowed)
        programs = filters.filter_programs(programs, filters.filter_channels(resolved, allowed))
    return (*publish.rewrite_images(counters.kept(kept), programs.drop("enriched"), s.proxy), counters)


def _allowed(spark: SparkSession, s: Settings) -> DataFrame | None:
    """The recorder's channel numbers; None if its list can't be read, and the run goes on without the filter."""
    try:
        allowed = filters.allowed_numbers(tables.recorder_numbers(spark, s.recorder))
        allowed.head(1)
        return allowed
    except (PySparkException, Py4JJavaError) as e:
        print(f"the recorder's list can't be read, channels are not filtered: {str(e).splitlines()[0]}")
        return None


def run_once(spark: SparkSession, s: Settings, now: int | None = None) -> dict:
    """One run: the document, its dated copy, the JSON document and the snapshot; counters."""
    now = int(time.time()) if now is None else now
    channels, programs, counters = build(spark, s, now)
    publish.write_snapshot(channels, programs, f"{s.folder}/snapshot", now)
    channels, programs = publish.read_snapshot(spark, f"{s.folder}/snapshot", now)
    publish.publish_document(publish.document(channels, programs), f"{s.folder}/xmlguide.xmltv")
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))
    publish.publish_text(view.guide_document(view.guide_json(channels, programs), stamp), f"{s.folder}/guide.json", ["section", "ord"])
    publish.rotate(spark, s.folder, time.strftime("%Y%m%d", time.gmtime(now)))
    publish.swap(channels, programs)
    return counters.told()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--folder", required=True)
    parser.add_argument("--once", action="store_true", help="one run, without a schedule")
    told = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    s = Settings.of(spark, told.folder)
    if told.once:
        print(run_once(spark, s))
        return
    held = publish.read_snapshot(spark, f"{s.folder}/snapshot", int(time.time()), f"{s.folder}/xmlguide.xmltv")
    age = None
    if held is not None:
        publish.swap(*held)
        age = int(time.time()) - Versions(spark, f"{s.folder}/snapshot").current()["saved_at"]
    # A signal ends the wait; a run that is under way finishes its publication first.
    stop = threading.Event()
    for kind in (signal.SIGTERM, signal.SIGINT):
        signal.signal(kind, lambda *_: stop.set())
    while not stop.is_set():  # a failed run leaves the last publication and is tried again in an hour
        if age is not None and stop.wait(refresh.next_delay_seconds(age)):
            break
        try:
            print(run_once(spark, s))
            age = 0
        except Exception as e:  # noqa: BLE001
            print(f"the run failed: {e}")
            age = 24 * 3600


if __name__ == "__main__":
    main()
