"""The listing grid: slots, a data source with one partition a slot, and strict decoding."""

from __future__ import annotations

import functools
import http.cookiejar
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

GRID = (
    "channels array<struct<channelId:string,channelNo:string,callSign:string,affiliateName:string,thumbnail:string,events:array<struct<"
    "startTime:string,endTime:string,duration:string,thumbnail:string,seriesId:string,rating:string,flag:array<string>,tags:array<string>,filter:array<string>,"
    "program:struct<id:string,title:string,episodeTitle:string,shortDesc:string,season:string,episode:string>>>>>"
)
GRID_TYPE = f"struct<{GRID.replace(' ', ':', 1)}>"
_EVENT = {"startTime": str, "endTime": str, "duration": str, "thumbnail": str, "seriesId": str, "rating": str, "flag": [str], "tags": [str], "filter": [str], "program": {k: str for k in ("id", "title", "episodeTitle", "shortDesc", "season", "episode")}}
_SHAPE = {"channels": [{"channelId": str, "channelNo": str, "callSign": str, "affiliateName": str, "thumbnail": str, "events": [_EVENT]}]}

_ROW = pa.schema([("slot_ts", pa.int64()), ("body", pa.string()), ("error", pa.string())])


def slots(spark: SparkSession, start: str, days: int = 14, hours: int = 6) -> DataFrame:
    """``slot, slot_ts``: the half-open horizon from midnight of ``start`` in steps."""
    n = days * 24 // hours
    first = F.date_trunc("day", F.lit(start).cast("timestamp"))
    return spark.range(n).select((first + F.make_dt_interval(F.lit(0), (F.col("id") * hours).cast("int"))).alias("slot")).withColumn("slot_ts", F.unix_timestamp("slot"))


def _fitter(shape):
    """A function that gives a value in the shape's own spelling of keys; a value of another type fails the whole document.

    It is made once for a shape and not worked out for each value, as a document has very many.
    """
    if isinstance(shape, list):
        each, plain = _fitter(shape[0]), shape[0] is str

        def fit_list(value):
            if value is None:
                return None
            if type(value) is not list:
                raise TypeError(f"a list is expected, not {type(value).__name__}")
            return value if plain and all(type(v) is str for v in value) else [each(v) for v in value]

        return fit_list
    if isinstance(shape, dict):
        names = {k.lower(): k for k in shape}
        fitters = {k: None if kind is str else _fitter(kind) for k, kind in shape.items()}

        def fit_dict(value):
            if value is None:
                return None
            if type(value) is not dict:
                raise TypeError(f"an object is expected, not {type(value).__name__}")
            out = {}
            for k, v in value.items():
                name = k if k in fitters else names.get(k.lower())
                if name is None:
                    continue
                fit = fitters[name]
                if fit is not None:
                    v = fit(v)
                elif type(v) is not str and v is not None:
                    raise TypeError(f"str is expected, not {type(v).__name__}")
                out[name] = v
            return out

        return fit_dict

    def fit_text(value):
        if value is not None and type(value) is not shape:
            raise TypeError(f"{shape.__name__} is expected, not {type(value).__name__}")
        return value

    return fit_text


_fit = _fitter(_SHAPE)


def strict(body: str) -> str:
    """The document with known fields only, or an error if it isn't JSON or a field has another type."""
    told = json.loads(body)
    return json.dumps(_fit(told if told is not None else {}), ensure_ascii=False)


class _Slot(InputPartition):
    def __init__(self, slots: list[int]):
        self.slots = slots


class GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        first, n, step = int(self.options["start"]), int(self.options.get("slots", 56)), int(self.options.get("step", 6 * 3600))
        every, streams = [first + i * step for i in range(n)], int(self.options.get("streams", 1))
        return [_Slot(every[k::streams]) for k in range(streams) if every[k::streams]]

    def _body(self, ts: int, opener: urllib.request.OpenerDirector) -> str:
        o = self.options.get
        if o("folder"):
            store, folder = _store(o("folder"))
            with store.open_input_stream(f"{folder}/{ts}.json") as answer:
                return answer.read().decode("utf-8")
        # The request's parameters.
        query = {
            "aid": o("aid", "orbebb"), "lineupId": o("lineupid", "USA-lineupId-DEFAULT"), "timespan": "6", "headendId": o("headend", "lineupId"), "country": o("country", "USA"), "device": o("device", "-"),
            "postalCode": o("zipcode", "13490"), "isOverride": "true", "time": str(ts), "timezone": "", "pref": "16,256", "userId": "-", "languagecode": o("language", "en-us"),
        }
        request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(sorted(query.items()))}", headers={"User-Agent": o("useragent", "airgrid"), "Referer": o("referer", ""), "X-Requested-Width": "XMLHttpRequest"} | ({"Authorization": f"Bearer {o('token')}"} if o("token") else {}))
        with opener.open(request, timeout=15) as answer:
            return answer.read().decode("utf-8")

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        """A batch a document, so that a task holds one and not all of its slots."""
        opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))
        told = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, _ROW.types, strict=True)], schema=_ROW)
        for k, ts in enumerate(partition.slots):
            try:
                yield told(ts, strict(self._body(ts, opener)), None)
            except (OSError, ValueError, TypeError) as e:  # one slot fails, the others go on
                yield told(ts, None, f"{type(e).__name__}: {e}")
                continue
            if k + 1 < len(partition.slots):
                time.sleep(float(self.options.get("pause", "0")))


@functools.cache
def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class GridStream(DataSourceStreamReader):
    """Slots as they come due.  The offset is the number of slots asked for, so a stopped run goes on at the next slot.

    ``slots`` of them are due at ``start``, and one more after each ``step``; with ``until``, that many and no more.  A batch is planned as
    ``streams`` partitions.  A failed slot gives a row with its error and is over with its batch.
    """

    def __init__(self, options: dict):
        self.asked = GridReader(options)

    def initialOffset(self) -> dict:
        return {"slot": 0}

    def latestOffset(self) -> dict:
        o = self.asked.options
        first, step = int(o["start"]), int(o.get("step", 6 * 3600))
        return {"slot": int(o["until"]) if "until" in o else max(0, (int(time.time()) - first) // step) + int(o.get("slots", 56))}

    def partitions(self, start: dict, end: dict):
        o = self.asked.options
        due = [int(o["start"]) + i * int(o.get("step", 6 * 3600)) for i in range(start["slot"], end["slot"])]
        streams = int(o.get("streams", 1))
        return [_Slot(due[k::streams]) for k in range(streams) if due[k::streams]]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return self.asked.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch: its offsets are in the checkpoint and its answers in the sink."""


class GridSource(DataSource):
    """``spark.read.format("listing_grid")`` with options start, slots, step, url, pause and streams.

    A stream asks for its slots one after the other and pauses after each that succeeds; by default there is one,
    so the pause holds between all requests.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_grid"

    def schema(self) -> str:
        return "slot_ts long, body string, error string"

    def reader(self, schema) -> GridReader:
        return GridReader(self.options)

    def streamReader(self, schema) -> GridStream:
        return GridStream(self.options)


def read_grid(spark: SparkSession, **options: str) -> DataFrame:
    """``slot_ts, body, error``: documents of all slots; failed slots have an error and no body."""
    if "folder" in options:
        return _read_folder(spark, options)
    spark.dataSource.register(GridSource)
    return spark.read.format("listing_grid").options(**options).load()


def stream_grid(spark: SparkSession, **options: str) -> DataFrame:
    """``slot_ts, body, error`` as a stream (:class:`GridStream`)."""
    spark.dataSource.register(GridSource)
    return spark.readStream.format("listing_grid").options(**options).load()


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fitted(v: Column, shape) -> Column:
    """``ok, value`` of a variant: whether it has the shape, and the value in it; null and what is missing fit everywhere.

    The same rule as :func:`_fitter`, as an expression over VARIANT.
    """
    none = v.isNull() | F.is_variant_null(v)
    if isinstance(shape, list):
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _fitted(x, shape[0]))
        whole = lambda i: F.struct((none | F.coalesce(F.forall(i, lambda x: x["ok"]), F.lit(False))).alias("ok"), F.transform(i, lambda x: x["value"]).alias("value"))
        return _let(items, whole)
    if isinstance(shape, dict):
        # Keys are found without regard to case; of several spellings the last by code points counts, as a variant keeps no order.
        of = lambda entries, name: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name.lower()), F.lit(-1))["value"]
        fields = lambda entries: F.struct(*[_fitted(of(entries, name), kind).alias(name) for name, kind in shape.items()])
        ok = lambda f: F.array(*[f[name]["ok"] for name in shape])
        value = lambda f: F.struct(*[f[name]["value"].alias(name) for name in shape])
        told = lambda f: F.struct((F.forall(ok(f), lambda x: x)).alias("ok"), value(f).alias("value"))
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        return _let(entries, lambda e: _let(fields(e), lambda f: _let(told(f), lambda t: F.struct((none | (e.isNotNull() & t["ok"])).alias("ok"), F.when(e.isNotNull(), t["value"]).alias("value")))))
    return F.struct((none | (F.schema_of_variant(v) == "STRING")).alias("ok"), F.try_variant_get(v, "$", "string").alias("value"))


MOST_NAMED = 4_000  # characters of a type that is matched with the pattern


def _typed(shape) -> str:
    """A pattern for the type (as schema_of_variant tells it) of what has the shape, with its keys in the shape's own spelling.

    Fields that the shape doesn't know may be plain, or lists or objects of what is plain; no spelling of a known key is taken for one.
    """
    if isinstance(shape, list):
        return f"(?:VOID|ARRAY<{_typed(shape[0])}>)"
    if isinstance(shape, dict):
        plain = r"[A-Z]++(?!<)(?:\(\d+,\d+\))?"
        name = "(?:[A-Za-z0-9_]++|`[^`]++`)"
        other = f"(?!`?(?i:{'|'.join(shape)})`?:){name}: (?:{plain}|ARRAY<{plain}>|OBJECT<(?:{name}: {plain}(?:, (?!>))?)*+>)"
        known = "|".join(f"{k}: {_typed(kind)}" for k, kind in shape.items())
        return f"(?:VOID|OBJECT<(?:(?:{known}|{other})(?:, (?!>))?)*+>)"
    return "(?:VOID|STRING)"


def checked(raw: Column | str) -> Column:
    """``body, error`` of a document's text: its known fields, or what is wrong with it; a missing text is an error too.

    It is taken or refused whole, as by :func:`strict`, without Python; only a key that an object has twice in the same spelling
    is refused here, as the engine's parser does.

    The type of a whole document is told by one call.  Where it fits and keys are in the usual spelling, the document is cast by another;
    only others are looked at field by field.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    # The parser stops behind a document.  In an object whose second key is made from the text, nothing can follow the text unseen.
    end = F.md5(raw.cast("binary"))
    parsed = F.try_parse_json(F.concat(F.lit('{"d":'), raw, F.lit(',"'), end, F.lit('":0}')))
    of = "`?[0-9a-f]{32}`?: BIGINT"
    usual = f"^OBJECT<(?:d: {_typed(_SHAPE)}, {of}|{of}, d: {_typed(_SHAPE)})>$"
    empty = F.from_json(F.lit("{}"), GRID)

    def slowly(whole: Column) -> Column:
        held = F.try_variant_get(whole, "$", "map<string,variant>")
        doc = F.when((F.size(held) == 2) & F.map_contains_key(held, end), F.try_element_at(held, F.lit("d")))

        def result(doc: Column) -> Column:
            told = lambda t: F.struct(
                F.when(doc.isNotNull() & t["ok"], F.to_json(F.coalesce(t["value"], empty))).alias("body"),
                F.when(raw.isNull(), "FileNotFoundError").when(doc.isNull(), "JSONDecodeError: no JSON document").when(~t["ok"], "TypeError: a field is of another type").alias("error"),
            )
            return _let(_fitted(doc, _SHAPE), told)

        return _let(doc, result)

    def result(whole: Column) -> Column:
        quick = lambda kind: F.coalesce((F.length(kind) <= MOST_NAMED) & F.contains(kind, end) & F.rlike(kind, F.lit(usual)), F.lit(False))
        body = F.to_json(F.coalesce(F.try_variant_get(whole, "$.d", GRID_TYPE), empty))
        return F.when(_let(F.schema_of_variant(whole), quick), F.struct(body.alias("body"), F.lit(None).cast("string").alias("error"))).otherwise(slowly(whole))

    return _let(parsed, result)


def _read_folder(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Offline: one document a slot, ``<slot>.json``, in a folder of any store that Spark reads."""
    first, n, step = int(options["start"]), int(options.get("slots", 56)), int(options.get("step", 6 * 3600))
    wanted = F.broadcast(spark.range(n).select((F.lit(first) + F.col("id") * step).alias("slot_ts")))
    slot = lambda name: F.regexp_extract(name, r"(?:^|/)(-?\d+)\.json$", 1).try_cast("long").alias("slot_ts")
    read = spark.read.option("pathGlobFilter", "*.json")
    files = read.text(options["folder"], wholetext=True).select(slot("_metadata.file_name"), F.col("value").alias("raw")).join(wanted, "slot_ts")
    # A document is checked once, in a step that no filter goes behind; of missing ones only the names are looked through, so no text moves for a join.
    told = files.select("slot_ts", F.inline(F.array(checked("raw"))))
    named = read.format("binaryFile").load(options["folder"]).select(slot("path"))
    missing = wanted.join(named, "slot_ts", "left_anti").select("slot_ts", F.lit(None).cast("string").alias("body"), F.lit("FileNotFoundError").alias("error"))
    return told.unionByName(missing)


def decode(raw: DataFrame) -> DataFrame:
    """``slot_ts, grid`` of the slots that arrived."""
    return raw.where("body is not null").select("slot_ts", F.from_json("body", GRID).alias("grid"))
