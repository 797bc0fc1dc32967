"""The per-channel schedule as nested rows and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import leading_number, xml_unescape, xmltv_to_iso
from .normalize import UNAVAILABLE


def view_programs(programs: DataFrame) -> DataFrame:
    """``channel`` and the fields a listing shows."""
    plain = xml_unescape("description")
    return programs.select(
        "channel", xml_unescape("title").alias("title"), xml_unescape("sub_title").alias("sub_title"), xmltv_to_iso("start").alias("start"), xmltv_to_iso("stop").alias("end"),
        F.coalesce(F.get("categories", F.lit(0))["name"], F.lit("")).alias("category"), F.col("new").alias("is_new"), "rating", F.col("icon_src").alias("icon_url"), F.when(plain == UNAVAILABLE, "").otherwise(plain).alias("description"),
    )


def number_and_name() -> tuple[Column, Column]:
    names = F.size("display_names")
    at = lambda i: F.get("display_names", F.lit(i))
    return F.when(names >= 3, at(1)).otherwise(""), F.when(names >= 3, at(2)).when(names >= 1, at(0)).otherwise("")


def view_channels(channels: DataFrame) -> DataFrame:
    number, name = number_and_name()
    return channels.select("id", xml_unescape(number).alias("number"), xml_unescape(name).alias("name"), F.col("icon_url").alias("logo_url"))


def channel_order(number: str = "number") -> list[Column]:
    """Sort keys of channel numbers: by value where they begin with one, by text elsewhere, in a total order."""
    value = leading_number(number)
    return [F.when(value.isNotNull(), 1).when(F.col(number) < "0", 0).otherwise(2), value, F.col(number)]


def schedule(channels: DataFrame, programs: DataFrame) -> DataFrame:
    """Each channel with ``programs``, sorted by start; null where it has none."""
    fields = ["start", "title", "end", "sub_title", "category", "is_new", "rating", "icon_url", "description"]
    nested = view_programs(programs).groupBy("channel").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("programs"))
    # Channels are hashed, as a merge join would sort the nested rows once more.
    return view_channels(channels).hint("shuffle_hash").join(nested, F.col("id") == F.col("channel"), "left").drop("channel")


def guide_json(channels: DataFrame, programs: DataFrame) -> DataFrame:
    """``id, ord, body``: one JSON object for each channel in channel order; empty optional fields are left out."""
    some = lambda c: F.when(c != "", c)
    row = lambda p: F.struct(p["title"].alias("title"), some(p["sub_title"]).alias("subTitle"), p["start"].alias("start"), p["end"].alias("end"), some(p["category"]).alias("category"), F.when(p["is_new"], F.lit(True)).alias("isNew"), some(p["rating"]).alias("rating"), some(p["icon_url"]).alias("iconUrl"), some(p["description"]).alias("description"))
    rows = schedule(channels, programs).withColumn("list", F.to_json(F.transform("programs", row)))
    head = F.to_json(F.struct("id", "number", "name", F.col("logo_url").alias("logoUrl")))
    body = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(',"programs":'), F.coalesce("list", F.lit("null")), F.lit("}"))
    return rows.withColumn("head", head).select("id", F.struct(*channel_order(), "id").alias("ord"), body.alias("body"))


def guide_document(rows: DataFrame, generated: str) -> DataFrame:
    """``section, ord, value``: the lines of one JSON document with all channels (of :func:`guide_json`) in order."""
    first = rows.orderBy("ord").select("id").head(1)
    comma = F.when(F.col("id") == (first[0]["id"] if first else ""), "").otherwise(",")
    body = rows.select(F.lit(1).alias("section"), "ord", F.concat(comma, "body").alias("value"))
    none = F.lit(None).cast(rows.schema["ord"].dataType)
    ends = rows.sparkSession.createDataFrame([(0, f'{{"generated":"{generated}","channels":['), (2, "]}")], "section int, value string")
    return ends.select("section", none.alias("ord"), "value").unionByName(body)
