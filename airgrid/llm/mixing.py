"""Mixing sources to target weights (Sainte-Lague apportionment), in DataFrame functions only.

1. Words are counted once per document; everything later reads that narrow table.
2. Targets: ``share`` times all words, dealt by weight; a target stops at ``most``
   times its source and the excess goes to the others by weight until none is above
   (the water level is found in closed form from the sources sorted by cap / weight).
3. Quotas: blocks of equal words go to sources by highest quotient
   target / (2 seats + 1).  A divisor bound gives each source all but a few of its
   seats at once; only the last seats (at most two for each source) are ranked.
4. A source is dealt by hash into shards of about ``shard_words`` words, so a hot
   source has more shards and no larger ones; its blocks go to its shards by the same rule.
5. A shard is a circle of its documents in seeded order.  It gives whole turns and
   one run of blocks that begins at a seeded block, so a document is taken at most
   ``most`` times and the work does not depend on the number of blocks.

Defined results: null text has size 0 and takes nothing; a null source is a source
of its own and the last; repeated rows are separate documents; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, send

WORD = r"[^\x20\x09-\x0D]+"
FEW_SOURCES = 20_000


def _code(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def _row_code() -> Column:
    """A 64-bit hash of source and text: with doc_id it tells rows apart as far as the mix can."""
    return F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.coalesce("text", F.lit("")), F.col("text").isNull())


def _draw(code: Column) -> Column:
    return F.conv(F.substring(code, 1, 8), 16, 10).cast("long")


def _seats(df: DataFrame, votes: str, seats: str, by: list[str], order: list[Column]) -> DataFrame:
    """df with ``quota``: ``seats`` (the same in a group) dealt to the rows by Sainte-Lague.

    ``by`` are the columns of the group; ties of quotients go by ``order``.
    """
    group = Window.partitionBy(*by)
    df = df.withColumn("_all", F.sum(votes).over(group)).withColumn("_half", F.sum(F.when(F.col(votes) > 0, 0.5).otherwise(0.0)).over(group))
    bound = lambda n: F.when(F.col(votes) > 0, F.floor(F.col(votes) * F.greatest(n, F.lit(0.0)) / F.col("_all") + 0.5)).otherwise(0).cast("long")
    df = df.withColumn("_sure", F.when(F.col(seats) > F.col("_half"), bound(F.col(seats) - F.col("_half"))).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_most", F.greatest(F.col("_sure") + 1, bound(F.col(seats) + F.col("_half")) + 1))
    df = df.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    open_ = df.where(F.col(votes) > 0).withColumn("_seat", F.explode(F.sequence("_sure", "_most")))
    quotient = F.col(votes) / (2 * F.col("_seat") + 1)
    won = open_.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *order, "_seat"))).where("_rank <= _left")
    keys = [*by, *[c for c in df.columns if c in ("source", "shard") and c not in by]]
    won = won.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_won"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.join(won, on, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_all", "_half", "_sure", "_most", "_left", "_won", *[f"_k{i}" for i in range(len(keys))])


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` for each source of a table with ``source, size``."""
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    src = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = whole.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"])
    return src.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 64,
    shard_words: int = 16_384,
    most_shards: int = 4_096,
    seed: str = "mix-1",
) -> DataFrame:
    """What the mix takes of each document: one row per row of ``docs`` (doc_id, text, source).

    ``doc_id, source, size, source_size, target, taken`` and where it is taken:
    ``turns`` whole copies, then the words [first_at, first_at + first_words) and
    [second_at, second_at + second_words) of the document; ``row_code`` is a hash of source and text.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    sized = ws.cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _row_code().alias("row_code")), "sized")
    targets = source_targets(sized, weights, share, most)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(smallest, F.lit(0.0)) / 512))).cast("long"))
    targets = targets.withColumn("blocks", F.round(F.lit(float(min(share, most))) * F.sum("source_size").over(Window.partitionBy()) / F.col("block")).cast("long"))
    quotas = _seats(targets, "target", "blocks", [], [F.col("source").asc_nulls_last()])
    quotas = quotas.withColumn("shards", F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    quotas = ws.cut(quotas.withColumnRenamed("quota", "source_quota").drop("blocks").repartition(1), "quotas")
    few = quotas.count() <= FEW_SOURCES
    side = lambda t: F.broadcast(t) if few else t

    code = _code(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    q = quotas.withColumnRenamed("source", "_source")
    dealt = sized.join(side(q), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("code", code)
    dealt = dealt.withColumn("shard", F.pmod(_draw(F.col("code")), F.col("shards"))).drop("shards")

    group = ["source", "shard"]
    per = dealt.groupBy("source", "shard", "block", "source_quota").agg(F.sum("size").alias("shard_size"))
    per = _seats(per, "shard_size", "source_quota", ["source"], [F.col("shard")])
    words = F.least(F.col("quota") * F.col("block"), F.floor(F.col("shard_size") * F.lit(float(most))))
    per = per.withColumn("_words", words.cast("long"))
    per = per.withColumn("turns", F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long"))
    per = per.withColumn("run", F.col("_words") - F.col("turns") * F.col("shard_size"))
    start = F.pmod(_draw(_code(F.lit(seed), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block")))) * F.col("block")
    per = per.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "turns", "run", start.alias("begin"))

    order = Window.partitionBy(*group).orderBy("code", F.col("doc_id").asc_nulls_last(), "size", "row_code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("at", F.sum("size").over(order) - F.col("size"))
    placed = placed.join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    end, stop = F.col("at") + F.col("size"), F.col("begin") + F.col("run")
    zero = F.lit(0).cast("long")
    a = F.greatest("at", "begin")
    a_words = F.greatest(zero, F.least(end, stop, F.col("shard_size")) - a)
    b_words = F.greatest(zero, F.least(end, stop - F.col("shard_size")) - F.col("at"))
    placed = placed.withColumn("first_at", F.when(a_words > 0, a - F.col("at")).otherwise(zero)).withColumn("first_words", a_words).withColumn("second_at", zero).withColumn("second_words", b_words)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("turns") * F.col("size") + F.col("first_words") + F.col("second_words")).alias("taken"),
        "turns", "first_at", "first_words", "second_at", "second_words", "row_code",
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row per document of which words are taken.

    Its text is its whole copies and then its partial runs of words, joined by an
    empty line; whole copies keep their spacing, the words of a part are joined by
    single spaces.  A document of which nothing is taken goes.

    Rows are told apart by doc_id and ``row_code``.  Rows that agree in both share out what was
    taken of them, one to one: where it is the same of all by a plain join, else by number.
    """
    own = ["size", "turns", "first_at", "first_words", "second_at", "second_words"]
    ws = Workspace(docs.sparkSession, "mixing")
    key = [F.col("doc_id").alias("_airgrid_id"), F.col("row_code").alias("_airgrid_code")]
    take = mixed.groupBy(*key, *[F.col(c).alias(f"_airgrid_{c}") for c in own]).agg(F.count("*").alias("_airgrid_rows"))
    equal = Window.partitionBy("_airgrid_id", "_airgrid_code")
    upto = F.sum("_airgrid_rows").over(equal.orderBy(*[f"_airgrid_{c}" for c in own]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    take = ws.cut(take.withColumn("_airgrid_kinds", F.count("*").over(equal)).withColumn("_airgrid_upto", upto), "taken")
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    of = lambda c: F.col(f"_airgrid_{c}")
    none = F.array().cast("array<string>")
    words = lambda at, n: F.array(F.array_join(F.slice(found, (of(at) + 1).cast("int"), of(n).cast("int")), " "))
    part = lambda at, n: F.when(of(n) == 0, none).when(of(n) == of("size"), F.array("text")).otherwise(words(at, n))
    text = F.array_join(F.concat(F.array_repeat("text", of("turns").cast("int")), part("first_at", "first_words"), part("second_at", "second_words")), "\n\n")
    some = "_airgrid_turns * _airgrid_size + _airgrid_first_words + _airgrid_second_words > 0"
    same = F.col("doc_id").eqNullSafe(F.col("_airgrid_id")) & (_row_code() == F.col("_airgrid_code"))
    single = take.where("_airgrid_kinds = 1").where(some).select("_airgrid_id", "_airgrid_code", *[f"_airgrid_{c}" for c in own])
    out = docs.join(send(single), same).withColumn("text", text).select(*docs.columns)
    several = ws.again(take).where("_airgrid_kinds > 1")
    if several.head(1):
        groups = several.select("_airgrid_id", "_airgrid_code").distinct()
        rest = [c for c, t in docs.dtypes if c not in ("doc_id", "text", "source") and not t.startswith("map")]
        by = Window.partitionBy("doc_id", "_airgrid_row").orderBy(*rest, F.lit(0))
        numbered = docs.join(send(groups), same, "left_semi").withColumn("_airgrid_row", _row_code()).withColumn("_airgrid_number", F.row_number().over(by))
        numbered = numbered.join(send(several.where(some)), F.col("doc_id").eqNullSafe(F.col("_airgrid_id")) & (F.col("_airgrid_row") == F.col("_airgrid_code")) & (F.col("_airgrid_number") <= F.col("_airgrid_upto")) & (F.col("_airgrid_number") > F.col("_airgrid_upto") - F.col("_airgrid_rows")))
        out = out.unionByName(numbered.withColumn("text", text).select(*docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
