"""Enrichment of programs from a metadata lookup, with a cache that holds misses too."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exact import one_decimal
from ..functions.text import replace_first, xml_escape, xml_unescape
from .normalize import UNAVAILABLE

# Fixed values.
IMAGE_BASE = "https://image.tmdb.org/t/p/w500"
TTL_SECONDS = 7 * 24 * 3600
LOOKUP = "key string, image_url string, rating double, year string, overview string, ref_id long, orig_language string, fetched_at long"
_FOUND = ["image_url", "rating", "year", "overview", "ref_id", "orig_language"]


def is_movie() -> Column:
    return F.exists("categories", lambda c: c["name"] == "movie")


def cache_key(title: Column | str, movie: Column | str) -> Column:
    return F.concat(F.when(F.col(movie) if isinstance(movie, str) else movie, "movie:").otherwise("tv:"), F.col(title) if isinstance(title, str) else title)


def lookup_keys(programs: DataFrame) -> DataFrame:
    """``title, movie, lookup_title``: distinct titles with the plain lower-case form they are looked up by."""
    return programs.select("title", is_movie().alias("movie")).distinct().withColumn("lookup_title", F.lower(xml_unescape("title")))


def distinct_lookups(programs: DataFrame) -> DataFrame:
    """``lookup_title, movie, key``: one row for each search."""
    return lookup_keys(programs).select("lookup_title", "movie").distinct().withColumn("key", cache_key("lookup_title", "movie"))


def project_results(found: DataFrame) -> DataFrame:
    """The first of each answer's ``results`` (key, movie, results) as a lookup row; no result gives empty fields."""
    first = F.get("results", F.lit(0))
    date = F.when(F.col("movie"), first["release_date"]).otherwise(first["first_air_date"])
    empty = lambda c: F.coalesce(c, F.lit(""))
    return found.select(
        "key",
        empty(F.concat(F.lit(IMAGE_BASE), first["poster_path"])).alias("image_url"),
        F.coalesce(first["vote_average"], F.lit(0.0)).alias("rating"),
        empty(F.when(F.octet_length(date) >= 4, F.substring(date, 1, 4))).alias("year"),
        empty(first["overview"]).alias("overview"),
        F.coalesce(first["id"], F.lit(0)).cast("long").alias("ref_id"),
        empty(first["original_language"]).alias("orig_language"),
    )


def valid_cache(cache: DataFrame, as_of: int) -> DataFrame:
    return cache.where(F.lit(as_of) - F.col("fetched_at") <= TTL_SECONDS)


def merge_cache(cache: DataFrame, fetched: DataFrame, as_of: int) -> DataFrame:
    """The cache after a run: entries that hold, and each fetched key (also misses) at ``as_of``."""
    new = fetched.select("key", *_FOUND, F.lit(as_of).cast("long").alias("fetched_at"))
    return valid_cache(cache, as_of).select("key", *_FOUND, "fetched_at").join(new.select("key"), "key", "left_anti").unionByName(new)


def missing_keys(keys: DataFrame, cache: DataFrame, as_of: int) -> DataFrame:
    """The searches that the cache doesn't answer."""
    return keys.join(valid_cache(cache, as_of).select("key"), "key", "left_anti")


def enrich(programs: DataFrame, lookup: DataFrame) -> DataFrame:
    """``programs`` overlaid with their lookup rows; ``enriched`` tells which had one that is not a miss."""
    stars = F.when(F.col("rating") > 0, F.concat(one_decimal("rating"), F.lit("/10")))
    answers = lookup.where("not (ref_id = 0 and image_url = '' and rating = 0)").select(F.col("key").alias("_key"), stars.alias("_stars"), *[F.col(c).alias(f"_{c}") for c in _FOUND])
    # The programs are read once: a key is worked out in each row, and Spark may send the answers or split a hot title.
    rows = programs.withColumn("_m", is_movie()).withColumn("_asked", cache_key(F.lower(xml_unescape("title")), "_m"))
    rows = rows.join(answers, F.col("_asked") == F.col("_key"), "left")
    image = F.struct(F.col("_image_url").alias("url"), F.lit("poster").alias("type"), F.lit("3").alias("size"), F.lit("P").alias("orient"), F.lit("tmdb").alias("system"))
    number = F.struct(F.lit("themoviedb.org").alias("system"), F.concat(F.when(F.col("_m"), "").otherwise("series/"), F.col("_ref_id").cast("string")).alias("episode_number"))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    out = rows.withColumns({
        "icon_src": F.when(has("_image_url"), F.col("_image_url")).otherwise(F.col("icon_src")),
        "images": F.when(has("_image_url"), F.array(image)).otherwise(F.col("images")),
        "star_rating": F.coalesce("_stars", "star_rating"),
        "date": F.when(has("_year"), F.col("_year")).otherwise(F.col("date")),
        "description": F.when(has("_overview") & (F.col("description") == UNAVAILABLE), xml_escape("_overview")).otherwise(F.col("description")),
        "orig_language": F.when(has("_orig_language"), F.col("_orig_language")).otherwise(F.col("orig_language")),
        "episode_numbers": F.when(F.coalesce(F.col("_ref_id") != 0, F.lit(False)), F.concat("episode_numbers", F.array(number))).otherwise(F.col("episode_numbers")),
        "enriched": F.col("_key").isNotNull(),
    })
    return out.select(*programs.columns, "enriched")


def fix_image_host(programs: DataFrame) -> DataFrame:
    """The host that is gone replaced by the one that serves, once in each image URL."""
    fix = lambda c: replace_first(c, r"zap2it\.tmsimg\.com", "tmsimg.com")
    return programs.withColumns({"icon_src": fix("icon_src"), "images": F.transform("images", lambda i: i.withField("url", fix(i["url"])))})


class Counters:
    """Counts of a run, made while its tables are written and by no job of their own.

    Each table goes through :meth:`programs` or :meth:`channels` before it is written; when all are, :meth:`told` has the counts.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def _observed(self, table: DataFrame, name: str, *counts: Column) -> DataFrame:
        self._seen[name] = Observation(f"airgrid_{name}_{uuid.uuid4().hex}")
        return table.observe(self._seen[name], *counts)

    def programs(self, programs: DataFrame) -> DataFrame:
        """Programs, those ``enriched``, those whose image host is gone; before :func:`fix_image_host`."""
        return self._observed(programs, "programs", *program_counts())

    def channels(self, resolved: DataFrame) -> DataFrame:
        """Channels, and those with an icon."""
        return self._observed(resolved, "channels", F.count("*").alias("channels"), F.count_if(F.col("icon_url") != "").alias("icons"))

    def kept(self, kept: DataFrame) -> DataFrame:
        """Channels that the filter keeps."""
        return self._observed(kept, "kept", F.count("*").alias("kept"))

    def told(self) -> dict[str, int]:
        return {k: v for o in self._seen.values() for k, v in o.get.items()}


def program_counts() -> list[Column]:
    """The counters of programs as aggregates, for a batch or a stream."""
    return [F.count("*").alias("programs"), F.count_if("enriched").alias("enriched"), F.count_if(F.col("icon_src").contains("zap2it.tmsimg.com")).alias("to_fix")]
