"""Channel icons: ordered logo candidates from call sign and affiliate, and the first that is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_callsign, normalize_affiliate, slugify, trim_space
from . import dims

MATCHER_VERSION = 2
TTL_SECONDS = 30 * 24 * 3600


def _dictionary(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def candidates(channels: DataFrame, callsigns: DataFrame) -> DataFrame:
    """``channels`` (id, call_sign, affiliate, channel_no and others) with ``slugs``, best first.

    The fixed dictionaries are literals; the call-sign table is joined twice, and Spark
    sends it to all tasks if it is small.
    """
    affiliate, call = F.lower(trim_space("affiliate")), F.lower(trim_space("call_sign"))
    rows = channels.withColumn("_affiliate", affiliate).withColumn("_call", call).withColumn("_bare", bare_callsign("_call"))
    table = callsigns.groupBy("callsign").agg(F.min("slug").alias("slug"))
    rows = rows.join(table.select(F.col("callsign").alias("_k1"), F.col("slug").alias("_raw")), F.col("_call") == F.col("_k1"), "left")
    rows = rows.join(table.select(F.col("callsign").alias("_k2"), F.col("slug").alias("_short")), F.col("_bare") == F.col("_k2"), "left")
    network = F.when(F.col("_bare") != "", F.try_element_at(_dictionary(dims.NETWORK_SLUGS), F.col("_affiliate")))
    local = lambda *parts: F.concat(F.lit(dims.LOCAL_DIR), *parts)
    prefixes = F.array(*[F.lit(p) for p in dims.KNOWN_PREFIXES])
    ordered = F.array(
        F.try_element_at(_dictionary(dims.AFFILIATE_ALIASES), F.col("_affiliate")),
        F.col("_raw"),
        F.when(F.col("_bare") != F.col("_call"), F.col("_short")),
        F.when(F.col("channel_no") != "", local(network, F.lit("-"), F.col("channel_no"), F.lit("-"), F.col("_bare"))),
        local(network, F.lit("-"), F.col("_bare")),
        slugify("_affiliate"),
        F.col("_bare"),
        F.when(F.col("_affiliate").startswith("the "), slugify(F.expr("substr(_affiliate, 5)"))),
        normalize_affiliate("_affiliate"),
        F.get(F.filter(prefixes, lambda p: F.col("_bare").startswith(p) & (F.length("_bare") > F.length(p))), F.lit(0)),
    )
    slugs = F.array_distinct(F.filter(ordered, lambda x: F.coalesce(x != "", F.lit(False))))
    return rows.withColumn("slugs", slugs).drop("_affiliate", "_call", "_bare", "_k1", "_k2", "_raw", "_short")


def logo_url(slug: Column, country: str) -> Column:
    folder, suffix = dims.COUNTRIES[country]
    return F.concat(F.lit(f"{dims.LOGO_BASE}/{folder}/"), slug, F.lit(f"{suffix}.png"))


def valid_cache(cache: DataFrame, as_of: int) -> DataFrame:
    """Entries (key, logo_url, fetched_at, matcher_version) that still hold at ``as_of`` (Unix seconds)."""
    return cache.where((F.lit(as_of) - F.col("fetched_at") <= TTL_SECONDS) & ~((F.col("matcher_version") < MATCHER_VERSION) & (F.col("logo_url") == "")))


def resolve(channels: DataFrame, known_urls: DataFrame, callsigns: DataFrame, country: str = "USA", cache: DataFrame | None = None, as_of: int = 0) -> tuple[DataFrame, DataFrame]:
    """``channels`` with the icon of the first known candidate (none: empty), and new cache entries.

    An unsupported country leaves the icons as they are.  Cached channels are not resolved again;
    misses are cached as empty.
    """
    entries = "key string, logo_url string, fetched_at long, matcher_version int"
    if country not in dims.COUNTRIES:
        return channels, channels.sparkSession.createDataFrame([], entries)
    key = F.concat(F.lit("channelId:"), F.col("id"))
    todo = channels.withColumn("_key", key)
    if cache is not None:
        held = valid_cache(cache, as_of).select(F.col("key").alias("_key"), "logo_url")
        todo = todo.join(held.select("_key"), "_key", "left_anti")
    tried = candidates(todo, callsigns).select("_key", F.posexplode("slugs").alias("pos", "slug")).withColumn("url", logo_url(F.col("slug"), country))
    hits = tried.join(known_urls.select("url").distinct(), "url", "left_semi").groupBy("_key").agg(F.min_by("url", "pos").alias("logo_url"))
    found = todo.select("_key").distinct().join(hits, "_key", "left").select("_key", F.coalesce("logo_url", F.lit("")).alias("logo_url"))
    every = found if cache is None else found.unionByName(held)
    out = channels.withColumn("_key", key).join(every, "_key", "left").withColumn("icon_url", F.coalesce("logo_url", F.lit(""))).select(*channels.columns)
    return out, found.select(F.col("_key").alias("key"), "logo_url", F.lit(as_of).cast("long").alias("fetched_at"), F.lit(MATCHER_VERSION).alias("matcher_version"))
