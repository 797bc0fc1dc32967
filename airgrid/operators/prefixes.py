"""Texts matched with a table of prefixes: the first in order and the longest of which a text is a real continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 16 << 20  # of prefixes that go to all tasks


def match(df: DataFrame, text: str, prefixes: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with ``first_prefix`` and ``longest_prefix`` of column ``text`` from ``prefixes`` (prefix, rank); null where none fits.

    A prefix fits if the text begins with it and is longer.  Ties of rank go to the smaller prefix.  Each distinct text is cut to the lengths
    that prefixes have, and the pieces are looked up by an equi-join, so the work doesn't grow with texts times prefixes.
    The table of prefixes goes to all tasks if its bytes are counted and few, else both sides are dealt by prefix.
    """
    table = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("rank").alias("rank"))
    size = table.agg(F.coalesce(F.sum(F.octet_length("prefix") + 16), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths")).first()
    lengths = F.array(*[F.lit(n) for n in size["lengths"]]).cast("array<int>")  # at most as many as a prefix has letters
    side = F.broadcast(table) if size["bytes"] <= most_bytes else table
    texts = df.select(F.col(text).alias("airgrid_text")).where("airgrid_text is not null").distinct()
    cut: Column = F.explode(F.transform(F.filter(lengths, lambda n: n < F.length("airgrid_text")), lambda n: F.substring("airgrid_text", F.lit(1), n)))
    found = texts.select("airgrid_text", cut.alias("airgrid_cut")).join(side, F.col("airgrid_cut") == F.col("prefix"))
    best = found.groupBy("airgrid_text").agg(F.min(F.struct("rank", "prefix"))["prefix"].alias("first_prefix"), F.max_by("prefix", F.length("prefix")).alias("longest_prefix"))
    return df.join(best, F.col(text) == F.col("airgrid_text"), "left").drop("airgrid_text")
