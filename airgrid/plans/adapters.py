"""Guide-shaped relations derived from the driver's tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import first_wins

CALLS = ["HISTORY", "MAXHDP", "ESPNHD", "KABC-DT2", "A&E", "UP", "HBOHD", "TOONP", "WJXT-TV", "FOXNEWSHD", "ZZZQ", "CINEHP"]
AFFILIATES = ["ABC", "The Weather Channel", "A&E", "home box office", "", "Acme Broadcasting Company", "my network tv", "NBC", "PBS", "action channel"]
LANGUAGES = ["en", "fr", ""]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
AS_OF = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_suppkey as string) channel_id",
        "case when s_suppkey % 10 = 0 then '' when s_suppkey % 10 = 1 then concat('X', s_suppkey) else concat(s_suppkey % 97 + 2, if(s_suppkey % 3 = 0, '.1', '')) end channel_no",
        f"element_at({_array(CALLS)}, cast(s_suppkey % 12 + 1 as int)) call_sign",
        f"element_at({_array(AFFILIATES)}, cast(s_nationkey % 10 + 1 as int)) affiliate",
        "if(s_suppkey % 4 = 0, '', concat('//cdn.example.com/assets/', s_suppkey, '.png?w=55&h=40')) thumbnail",
        "s_nationkey",
    )


_START = "l_shipdate + make_dt_interval(0, 3 * (l_linenumber - 1))"
_TITLE = "concat(p_name, if(p_size % 5 = 0, ' & <co>', ''))"
_FILTERS = "if(p_type = 'PROMO', array('filter-movie'), array(concat('filter-', lower(p_type))))"


_PARTS = ["p_partkey", "p_name", "p_size", "p_type", "p_brand"]


def keyed(rows: DataFrame) -> DataFrame:
    """Rows of lineitem with their channel_id and ``start`` (to the second, as in the texts)."""
    return rows.withColumns({"channel_id": F.expr("cast(l_suppkey as string)"), "start": F.expr(f"date_trunc('SECOND', {_START})")})


def parted(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of lineitem with what their parts tell."""
    return rows.join(parts.select(*_PARTS), F.expr("l_partkey = p_partkey")).drop("p_partkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an airing is made of but its channel_id and ``start``: narrow rows, which are shuffled and sorted before they are :func:`keyed` and :func:`described`."""
    return parted(table(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag", "l_linestatus"), table(spark, sf_dir, "part"))


def unparted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`lines` without what parts tell: those of lineitem that have a part."""
    rows = table(spark, sf_dir, "lineitem").where("l_partkey is not null").select(*ORDER, "l_returnflag", "l_linestatus")
    unknown = rows.select("l_partkey").distinct().join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"), "left_anti")
    return rows if unknown.isEmpty() else rows.join(unknown, "l_partkey", "left_anti")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each p_partkey."""
    return first_wins(table(spark, sf_dir, "part").select(*_PARTS), ["p_partkey"], _PARTS[1:])


def described(lines: DataFrame, *keep: str) -> DataFrame:
    """The airings of :func:`keyed` lines, with the columns ``keep`` as they are."""
    return lines.withColumn("p_partkey", F.col("l_partkey")).selectExpr(
        *[c for c in lines.columns if c in ORDER or c in keep],
        "p_partkey",
        "channel_id",
        "date_format(start, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") start_time",
        "date_format(start + interval 1 hour, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end_time",
        "'60' duration",
        "if(p_partkey % 4 = 0, '', concat('p', p_partkey)) thumbnail",
        "concat('SH', lpad(p_partkey, 8, '0')) series_id",
        "concat(if(l_linenumber % 4 = 0, 'SH', 'EP'), lpad(p_partkey, 8, '0'), lpad(l_linenumber % 4, 4, '0')) program_id",
        f"{_TITLE} title",
        "if(l_linenumber % 2 = 0, null, concat('Part ', l_linenumber)) episode_title",
        "case when p_size % 3 = 0 then null when p_size % 7 = 0 then '' else concat(p_type, ' & ', p_brand) end short_desc",
        "case when l_linenumber % 3 = 0 then null when l_linenumber = 5 then ' 5' else cast(l_linenumber % 3 as string) end season",
        "case when p_size % 6 = 0 then null when p_size % 11 = 0 then 'x1' else cast(p_size % 6 as string) end episode",
        "case l_returnflag when 'N' then array('New') when 'R' then array('Premiere') else array('Finale') end flag",
        "if(l_linestatus = 'F', array('CC'), cast(array() as array<string>)) tags",
        f"{_FILTERS} filters",
        "case p_size % 4 when 0 then null when 1 then 'TV-14' when 2 then 'PG' else 'TV-G' end rating",
    )


def airings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(keyed(lines(spark, sf_dir)))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, movie, p_partkey``: what the airings are looked up by, a row a part that has one."""
    aired = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return table(spark, sf_dir, "part").join(aired, F.expr("l_partkey = p_partkey"), "left_semi").selectExpr(f"lower({_TITLE}) t", f"array_contains({_FILTERS}, 'filter-movie') movie", "p_partkey")


def lookup_answers(keys: DataFrame) -> DataFrame:
    """``key, movie, results`` for keys with ``k``: made answers, none for some keys."""
    return keys.where("k % 11 <> 0").selectExpr(
        "key", "movie",
        f"""array(named_struct('id', k, 'poster_path', if(k % 5 = 0, null, concat('/p', k, '.jpg')), 'vote_average', (k % 1000) / cast(100.0 as double), 'overview', concat('About & ', k),
            'original_language', element_at({_array(LANGUAGES)}, cast(k % 3 + 1 as int)), 'first_air_date', if(k % 7 = 0, '20', '2001-05-06'), 'release_date', if(k % 7 = 0, '20', '2001-05-06'))) results""",
    )


CHANNELS_SQL = f"""channel_src as (select cast(s_suppkey as varchar) channel_id,
  case when s_suppkey % 10 = 0 then '' when s_suppkey % 10 = 1 then 'X' || s_suppkey else (s_suppkey % 97 + 2) || (case when s_suppkey % 3 = 0 then '.1' else '' end) end channel_no,
  ({_list(CALLS)})[s_suppkey % 12 + 1] call_sign, ({_list(AFFILIATES)})[s_nationkey % 10 + 1] affiliate,
  case when s_suppkey % 4 = 0 then '' else '//cdn.example.com/assets/' || s_suppkey || '.png?w=55&h=40' end thumbnail, s_nationkey from supplier)"""

AIRINGS_SQL = """airing_src as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, p_partkey, cast(l_suppkey as varchar) channel_id,
  strftime(l_shipdate + to_hours(3 * (l_linenumber - 1)), '%Y-%m-%dT%H:%M:%SZ') start_time, strftime(l_shipdate + to_hours(3 * (l_linenumber - 1) + 1), '%Y-%m-%dT%H:%M:%SZ') end_time, '60' duration,
  case when p_partkey % 4 = 0 then '' else 'p' || p_partkey end thumbnail, 'SH' || lpad(cast(p_partkey as varchar), 8, '0') series_id,
  (case when l_linenumber % 4 = 0 then 'SH' else 'EP' end) || lpad(cast(p_partkey as varchar), 8, '0') || lpad(cast(l_linenumber % 4 as varchar), 4, '0') program_id,
  p_name || (case when p_size % 5 = 0 then ' & <co>' else '' end) title, case when l_linenumber % 2 = 0 then null else 'Part ' || l_linenumber end episode_title,
  case when p_size % 3 = 0 then null when p_size % 7 = 0 then '' else p_type || ' & ' || p_brand end short_desc,
  case when l_linenumber % 3 = 0 then null when l_linenumber = 5 then ' 5' else cast(l_linenumber % 3 as varchar) end season,
  case when p_size % 6 = 0 then null when p_size % 11 = 0 then 'x1' else cast(p_size % 6 as varchar) end episode,
  case l_returnflag when 'N' then 'New' when 'R' then 'Premiere' else 'Finale' end flag, case when l_linestatus = 'F' then 'CC' else '' end tags,
  case when p_type = 'PROMO' then 'filter-movie' else 'filter-' || lower(p_type) end filters,
  case p_size % 4 when 0 then null when 1 then 'TV-14' when 2 then 'PG' else 'TV-G' end rating from lineitem join part on l_partkey = p_partkey)"""
