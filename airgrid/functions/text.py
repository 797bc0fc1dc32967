"""Scalar text functions as column expressions; all run inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of station call signs.
INLINE_SUFFIX = r"(?i)(hdp|hp|hd[234]|hd|sd|dt2|dt|p)\z"
DASH_SUFFIX = r"(?i)-(tv|dt|hd|ld|dt2|hd2|hd3)\z"
# Words that say nothing in an affiliate's name.
NOISE_WORDS = ["broadcasting", "company", "corporation", "inc"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), r"^\s+|\s+\z", "")


def xml_escape(c: Column | str) -> Column:
    """``&``, ``<`` and ``>`` as entities; quotes stay."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(_col(c), F.lit(raw), F.lit(entity))
    return c


def xml_unescape(c: Column | str) -> Column:
    """The inverse of :func:`xml_escape`: of a text that it has escaped the same as unescaping all entities in one pass."""
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ("&", "&amp;")):
        c = F.replace(_col(c), F.lit(entity), F.lit(raw))
    return c


def iso_to_xmltv(c: Column | str) -> Column:
    """``2025-08-06T02:00:00Z`` to ``20250806020000 +0000``, by plain replacement: any text passes."""
    return F.replace(F.translate(_col(c), "-T:", ""), F.lit("Z"), F.lit(" +0000"))


def xmltv_to_iso(c: Column | str) -> Column:
    """The inverse; the zone is dropped, and a text with fewer than 14 bytes stays."""
    digits = F.substring_index(trim_space(c), " ", 1)
    part = lambda at, n: F.substring(digits, at, n)
    iso = F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit("T"), part(9, 2), F.lit(":"), part(11, 2), F.lit(":"), part(13, 2), F.lit("Z"))
    return F.when(F.octet_length(digits) < 14, digits).otherwise(iso)


def title_case(c: Column | str) -> Column:
    """The first letter of each word in upper case, all others unchanged."""
    words = F.split(_col(c), r"(?<=\s)")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def slugify(c: Column | str) -> Column:
    """Lower case, ``&`` as a word, every other run of signs a dash."""
    words = F.replace(F.lower(_col(c)), F.lit("&"), F.lit(" and "))
    return F.btrim(F.regexp_replace(words, "[^a-z0-9]+", "-"), F.lit("-"))


def normalize_affiliate(c: Column | str) -> Column:
    """The slug of a name without its noise words."""
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    return slugify(F.array_join(F.filter(F.split(trim_space(c), r"\s+"), lambda w: ~F.array_contains(noise, w)), " "))


def bare_callsign(c: Column | str) -> Column:
    """A call sign without its dash suffix, then without inline suffixes until none is left or two bytes would be undercut."""
    start = F.regexp_replace(_col(c), DASH_SUFFIX, "")

    def step(s: Column, _: Column) -> Column:
        shorter = F.regexp_replace(s, INLINE_SUFFIX, "")
        return F.when(F.octet_length(shorter) < 2, s).otherwise(shorter)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(start), F.lit(1))), start, step)
    return F.btrim(folded, F.lit("- "))


def parse_int(c: Column | str) -> Column:
    """A whole number with an optional sign; anything else is 0."""
    c = _col(c)
    return F.coalesce(F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint")), F.lit(0).cast("bigint"))


def leading_number(c: Column | str) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(_col(c), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def query_escape(c: Column | str) -> Column:
    """Percent-encoding for a query string, a space as ``+``."""
    return F.replace(F.replace(F.url_encode(_col(c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def replace_first(c: Column | str, pattern: str, text: str) -> Column:
    """The first match of a literal pattern replaced (regular-expression signs escaped by the caller)."""
    return F.regexp_replace(_col(c), f"(?s)\\A(.*?){pattern}", "$1" + text)


def icon_url(c: Column | str) -> Column:
    """A thumbnail without its query and leading slashes, under http; nothing stays nothing."""
    path = F.ltrim(F.substring_index(_col(c), "?", 1), F.lit("/"))
    return F.when(path != "", F.concat(F.lit("http://"), path)).otherwise("")
