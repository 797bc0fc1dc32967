"""Raw channels and airings to channel and program tables, first occurrence first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import icon_url, iso_to_xmltv, parse_int, title_case, xml_escape

# Fixed values.
UNAVAILABLE = "Unavailable"
PROGRAM_URL = "https://tvlistings.gracenote.com//overview.html?programSeriesId="
ICON_HOST = "http://zap2it.tmsimg.com/assets/"

_NUMBERS = "array<struct<system:string,episode_number:string>>"
_IMAGES = "array<struct<url:string,type:string,size:string,orient:string,system:string>>"


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in a total order.

    Spark keeps only each task's first rows before the shuffle, so a key with very many
    rows moves no more than one of them from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def explode_grid(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded grid documents (slot_ts, grid) to raw channels and raw airings with their place of arrival."""
    channels = grid.select("slot_ts", F.posexplode("grid.channels").alias("pos", "c"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = channels.select("slot_ts", "pos", text("c.channelId").alias("channel_id"), text("c.channelNo").alias("channel_no"), text("c.callSign").alias("call_sign"), text("c.affiliateName").alias("affiliate"), text("c.thumbnail").alias("thumbnail"))
    events = channels.select("slot_ts", "pos", text("c.channelId").alias("channel_id"), F.posexplode("c.events").alias("event_pos", "e"))
    airings = events.select(
        "slot_ts", "pos", "event_pos", "channel_id",
        text("e.startTime").alias("start_time"), text("e.endTime").alias("end_time"), text("e.duration").alias("duration"), text("e.thumbnail").alias("thumbnail"),
        text("e.seriesId").alias("series_id"), text("e.program.id").alias("program_id"), text("e.program.title").alias("title"),
        F.col("e.program.episodeTitle").alias("episode_title"), F.col("e.program.shortDesc").alias("short_desc"), F.col("e.program.season").alias("season"), F.col("e.program.episode").alias("episode"),
        F.col("e.flag").alias("flag"), F.col("e.tags").alias("tags"), F.col("e.filter").alias("filters"), F.col("e.rating").alias("rating"),
    )
    return raw, airings


def display_names() -> Column:
    no, call = F.col("channel_no"), F.col("call_sign")
    return F.array(xml_escape(F.concat(no, F.lit(" "), call)), xml_escape(no), xml_escape(call), xml_escape(title_case("affiliate")))


def to_channels(raw: DataFrame) -> DataFrame:
    """``id, display_names, icon_url, call_sign, affiliate, channel_no`` from raw channels."""
    return raw.select(F.col("channel_id").alias("id"), display_names().alias("display_names"), icon_url("thumbnail").alias("icon_url"), "call_sign", "affiliate", "channel_no")


def categories(lang: Column, episode: Column | None = None) -> Column:
    episode = parse_int("episode") if episode is None else episode
    none = F.array().cast("array<string>")
    names = F.concat(
        F.transform(F.coalesce("filters", none), lambda f: F.when(f.startswith("filter-"), f.substr(F.lit(8), F.length(f))).otherwise(f)),
        F.when(episode != 0, F.array(F.lit("Series"))).otherwise(none),
        F.filter(F.coalesce("flag", none), lambda f: f == "Finale"),
    )
    return F.transform(names, lambda n: F.struct(n.alias("name"), lang.alias("lang")))


def onscreen(season: Column, episode: Column) -> Column:
    return F.format_string("S%02dE%02d", season, episode)


def xmltv_ns(season: Column, episode: Column) -> Column:
    return F.concat(F.when(season != 0, (season - 1).cast("string")).otherwise(""), F.lit("."), (episode - 1).cast("string"))


def dd_progid(series: str = "series_id", program: str = "program_id") -> Column:
    suffix = F.when(F.octet_length(program) >= 4, F.right(F.col(program), F.lit(4))).otherwise("")
    at = F.instr(F.col(series), "SH")
    first = F.when(at > 0, F.concat(F.substr(F.col(series), F.lit(1), at - 1), F.lit("EP"), F.substr(F.col(series), at + 2))).otherwise(F.col(series))
    head = F.when(suffix == "0000", F.col(series)).otherwise(first)
    return F.concat(head, F.lit("."), suffix)


def episode_numbers(season: Column | None = None, episode: Column | None = None) -> Column:
    season, episode = (parse_int(c) if told is None else told for c, told in (("season", season), ("episode", episode)))
    of = lambda system, value: F.struct(F.lit(system).alias("system"), value.alias("episode_number"))
    both = F.array(of("onscreen", onscreen(season, episode)), of("xmltv_ns", xmltv_ns(season, episode)))
    return F.concat(F.when(episode != 0, both).otherwise(F.array().cast(_NUMBERS)), F.array(of("dd_progid", dd_progid())))


def has_flag(name: str) -> Column:
    return F.coalesce(F.array_contains("flag", name), F.lit(False))


def rating_system() -> Column:
    return F.when(F.coalesce("rating", F.lit("")).startswith("TV-"), "USA Parental Rating").otherwise("")


def to_programs(airings: DataFrame, lang: str = "en", country: str = "USA", keep: Sequence[str] = ()) -> DataFrame:
    """Program rows from raw airings, with the columns ``keep`` as they are; text is escaped here, as the document writer doesn't."""
    none = F.array().cast("array<string>")
    language = F.lit(lang)
    # Each number is parsed once, in a step of its own.
    airings = airings.withColumns({"_season": parse_int("season"), "_episode": parse_int("episode")})
    return airings.select(
        iso_to_xmltv("start_time").alias("start"), iso_to_xmltv("end_time").alias("stop"), F.col("channel_id").alias("channel"), language.alias("lang"),
        xml_escape("title").alias("title"), F.coalesce(xml_escape("episode_title"), F.lit("")).alias("sub_title"), F.coalesce(xml_escape("short_desc"), F.lit(UNAVAILABLE)).alias("description"),
        F.lit("minutes").alias("length_units"), F.col("duration").alias("length"),
        F.when(F.col("thumbnail") != "", F.concat(F.lit(ICON_HOST), "thumbnail", F.lit(".jpg"))).otherwise("").alias("icon_src"), F.array().cast(_IMAGES).alias("images"),
        F.concat(F.lit(PROGRAM_URL), "series_id", F.lit("&amp;tmsId="), "program_id").alias("url"),
        language.alias("language"), F.lit("").alias("orig_language"), F.lit(country).alias("country"),
        episode_numbers(F.col("_season"), F.col("_episode")).alias("episode_numbers"), categories(language, F.col("_episode")).alias("categories"),
        has_flag("New").alias("new"), has_flag("Premiere").alias("premiere"), (~has_flag("New")).alias("previously_shown"),
        F.transform(F.filter(F.coalesce("tags", none), lambda t: t == "CC"), lambda t: F.struct(F.lit("teletext").alias("type"))).alias("subtitles"),
        F.coalesce("rating", F.lit("")).alias("rating"), rating_system().alias("rating_system"), F.lit("").alias("star_rating"), F.lit("").alias("date"), *keep,
    )
