"""Allow lists and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts whose images may be fetched, one of them below a path only.
IMAGE_HOSTS = ["image.tmdb.org", "tmsimg.com"]
RAW_HOST, RAW_PATH = "raw.githubusercontent.com", "/tv-logo/tv-logos/"


def allowed_numbers(items: DataFrame) -> DataFrame:
    """Distinct channel numbers that are not empty, from ``number``."""
    return items.select("number").where("number <> ''").distinct()


def filter_channels(channels: DataFrame, allowed: DataFrame) -> DataFrame:
    """Channels whose displayed number is allowed; with fewer than three names the number is empty."""
    number = F.when(F.size("display_names") >= 3, F.get("display_names", F.lit(1))).otherwise("")
    return channels.withColumn("_number", number).join(allowed.select(F.col("number").alias("_number")), "_number", "left_semi").drop("_number")


def filter_programs(programs: DataFrame, channels: DataFrame) -> DataFrame:
    """Programs of the channels that were kept."""
    return programs.join(channels.select(F.col("id").alias("channel")), "channel", "left_semi")


def image_url_allowed(url: Column | str) -> Column:
    host = F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))
    path = F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("PATH"))
    return F.coalesce(host.isin(IMAGE_HOSTS) | ((host == RAW_HOST) & F.coalesce(path.startswith(RAW_PATH), F.lit(False))), F.lit(False))


def valid_id(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\A[0-9a-fA-F-]+\z")


def url_key(url: Column | str) -> Column:
    """The name under which an image is stored."""
    return F.sha2((F.col(url) if isinstance(url, str) else url).cast("binary"), 256)
