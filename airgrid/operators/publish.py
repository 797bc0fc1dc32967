"""Documents, snapshots and rotation."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_escape
from ..session import Store
from .versions import Versions

PROLOG = "<?xml version=\"1.0\" ?>\n<!DOCTYPE tv SYSTEM 'xmltv.dtd'>\n"
SNAPSHOT_TTL_HOURS = 4
KEEP_FILES = 7


def proxied(url: Column, base: str) -> Column:
    """The URL by way of an image proxy; nothing stays nothing."""
    return F.when(url != "", F.concat(F.lit(base.rstrip("/") + "/img?url="), query_escape(url))).otherwise(url)


def rewrite_images(channels: DataFrame, programs: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    if not base:
        return channels, programs
    images = F.transform("images", lambda i: i.withField("url", proxied(i["url"], base)))
    return channels.withColumn("icon_url", proxied(F.col("icon_url"), base)), programs.withColumns({"icon_src": proxied(F.col("icon_src"), base), "images": images})


def _each(array: str, row) -> Column:
    return F.array_join(F.transform(array, row), "")


def _if(c: str, *parts: Column | str) -> Column:
    return F.when(F.col(c) != "", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def channel_fragment() -> Column:
    names = _each("display_names", lambda n: F.concat(F.lit("    <display-name>"), n, F.lit("</display-name>\n")))
    return F.concat(F.lit('  <channel id="'), "id", F.lit('">\n'), names, F.lit('    <icon src="'), "icon_url", F.lit('" />\n  </channel>'))


def programme_fragment() -> Column:
    c, t = F.col, F.lit
    return F.concat(
        t('  <programme start="'), c("start"), t('" stop="'), c("stop"), t('" channel="'), c("channel"), t('">\n    <title lang="'), c("lang"), t('">'), c("title"), t("</title>\n"),
        _if("sub_title", '    <sub-title lang="', c("lang"), '">', c("sub_title"), "</sub-title>\n"),
        t('    <desc lang="'), c("lang"), t('">'), c("description"), t('</desc>\n    <length units="'), c("length_units"), t('">'), c("length"), t("</length>\n"),
        _if("language", "    <language>", c("language"), "</language>\n"), _if("orig_language", "    <orig-language>", c("orig_language"), "</orig-language>\n"), _if("icon_src", '    <icon src="', c("icon_src"), '"/>\n'),
        _each("images", lambda i: F.concat(t('    <image type="'), i["type"], t('" size="'), i["size"], t('" orient="'), i["orient"], t('" system="'), i["system"], t('">'), i["url"], t("</image>\n"))),
        t("    <url>"), c("url"), t("</url>\n"), _if("country", "    <country>", c("country"), "</country>\n"),
        _each("episode_numbers", lambda e: F.concat(t('    <episode-num system="'), e["system"], t('">'), e["episode_number"], t("</episode-num>\n"))),
        _each("categories", lambda g: F.concat(t('    <category lang="'), g["lang"], t('">'), g["name"], t("</category>\n"))),
        F.when(c("new"), "    <new />\n").otherwise(""), F.when(c("premiere"), "    <premiere />\n").otherwise(""), F.when(c("previously_shown"), "    <previously-shown />\n").otherwise(""),
        _each("subtitles", lambda s: F.concat(t('    <subtitles type="'), s["type"], t('" />\n'))),
        _if("rating", "    <rating", _if("rating_system", ' system="', c("rating_system"), '"'), "><value>", c("rating"), "</value></rating>\n"),
        _if("star_rating", "    <star-rating><value>", c("star_rating"), "</value></star-rating>\n"), _if("date", "    <date>", c("date"), "</date>\n"), t("  </programme>"),
    )


def document(channels: DataFrame, programs: DataFrame, source_url: str = "http://tvlistings.gracenote.com/", source_name: str = "GraceNote", generator: str = "airgrid") -> DataFrame:
    """``section, k1, k2, k3, value``: the parts of an XMLTV document in sort order."""
    spark = channels.sparkSession
    none = F.lit("")
    head = f'{PROLOG}<tv source-info="{source_url}" source-info-name="{source_name}" generator-info-name="{generator}">'
    ends = spark.createDataFrame([(0, "", "", "", head), (3, "", "", "", "</tv>")], "section int, k1 string, k2 string, k3 string, value string")
    first = channels.select(F.lit(1).alias("section"), F.col("id").alias("k1"), none.alias("k2"), none.alias("k3"), channel_fragment().alias("value"))
    second = programs.select(F.lit(2).alias("section"), F.col("channel").alias("k1"), F.col("start").alias("k2"), F.col("title").alias("k3"), programme_fragment().alias("value"))
    return ends.unionByName(first).unionByName(second)


def write_document(parts: DataFrame, path: str) -> None:
    """One ordered text file in a folder, sorted and written by one task; :func:`publish_text` sorts in parallel."""
    parts.orderBy("section", "k1", "k2", "k3", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def publish_text(parts: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """One ordered file at ``path``, seen whole or not at all: sorted and written in parallel, joined, renamed."""
    store, staged = Store(parts.sparkSession, path), f"{path}._staged-{uuid.uuid4().hex}"
    try:
        parts.orderBy(*order, value).select(value).write.text(staged)
        store.join([f"{staged}/{n}" for n in store.names(staged) if n.startswith("part-")], f"{staged}/_whole")
        store.move(f"{staged}/_whole", path)
    finally:
        store.delete(staged)


def publish_document(parts: DataFrame, path: str) -> None:
    """The XMLTV document of :func:`document` as one file."""
    publish_text(parts, path, ["section", "k1", "k2", "k3"])


def write_snapshot(channels: DataFrame, programs: DataFrame, path: str, saved_at: int) -> None:
    """Both tables as the current version of a snapshot; readers of the one before go on, and older ones that nobody reads go."""
    versions = Versions(channels.sparkSession, path)
    versions.publish({"channels": channels, "programs": programs}, saved_at)
    versions.vacuum()


def read_snapshot(spark: SparkSession, path: str, as_of: int, document: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The tables of a snapshot younger than four hours, or None if it is older, missing or broken, or has no published ``document``.

    They are those of one version, which stays while it is the current one or the one before; to hold it for longer,
    open it by :meth:`Versions.open`.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    found = Versions(spark, path).open(hold=False)
    if found is None or as_of - found.saved_at >= SNAPSHOT_TTL_HOURS * 3600:
        return None
    if document is not None and not Store(spark, document).exists(document):
        return None
    try:
        tables = found.table("channels"), found.table("programs")
        for table in tables:
            table.head(1)
    except (PySparkException, Py4JJavaError):
        return None
    return tables


def retained(files: DataFrame, keep: int = KEEP_FILES) -> DataFrame:
    """The ``keep`` greatest names of dated files (name)."""
    return files.where(F.col("name").rlike(r"\Axmlguide\..*\.xmltv\z")).orderBy(F.desc("name")).limit(keep)


def dated_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name``: the dated files in a folder of any store."""
    names = [(n,) for n in Store(spark, folder).names(folder) if n.startswith("xmlguide.") and n.endswith(".xmltv") and n.count(".") >= 2]
    return spark.createDataFrame(names, "name string")


def rotate(spark: SparkSession, folder: str, day: str, keep: int = KEEP_FILES) -> list[str]:
    """Copy the published file to the dated one of ``day`` (yyyymmdd) and delete all dated files but the greatest; their names."""
    store = Store(spark, folder)
    if not store.exists(f"{folder}/xmlguide.xmltv"):
        return []
    store.join([f"{folder}/xmlguide.xmltv"], f"{folder}/xmlguide.{day}.xmltv")
    kept = sorted(r["name"] for r in retained(dated_files(spark, folder), keep).collect())
    for r in dated_files(spark, folder).collect():
        if r["name"] not in kept:
            store.delete(f"{folder}/{r['name']}")
    return kept


def swap(channels: DataFrame, programs: DataFrame) -> None:
    """Let readers of the session see these tables as guide_channels and guide_programs from now on."""
    channels.createOrReplaceTempView("guide_channels")
    programs.createOrReplaceTempView("guide_programs")
