"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as additive deltas.  A
batch of changes is signed: an insert adds a document's counts, a delete takes them
away, a revision takes the old counts away and adds the new.  A batch is summed in
Spark, staged below a name of its own and becomes visible as ``batch=<id>`` by one rename that
fails where the batch is there already, so a batch that is sent again, sent twice at once, or
was cut short, changes nothing.  Totals are the sums of all committed deltas.

``compact`` writes the totals, with the ids of the batches they hold, and one rename to
``state=<n>`` puts both in place; whoever reads takes the highest state and the batches that it
doesn't hold.  What the state has made superfluous goes in ``vacuum``, and a crash at any point loses
nothing.  The store must rename a folder in one step (HDFS, local disks, Azure's hierarchical store); plain object
stores don't.

Defined results: null source, language or version are keys of their own; null counts
are 0; null text has no tokens; groups whose documents and tokens are both 0 are left
out; repeated rows count as often as they occur; an empty batch commits and adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import WORD
from .storage import fresh, small_batches
from .tokens import Encoder, default_vocabulary

KEYS = ["source", "lang", "tokenizer"]
WORDS, SUBWORD = "words_1", "word_bpe_49k"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class TokenRollup:
    """A rollup table below ``path``, which all executors must see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _named(self, prefix: str) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        return [n.removeprefix(prefix) for n in (s.getPath().getName() for s in fs.listStatus(path(self.path))) if n.startswith(prefix)]

    def _publish(self, staged: str, final: str) -> bool:
        """Rename in one step; False if ``final`` is there."""
        from py4j.protocol import Py4JJavaError

        fs, path = self._fs()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(path(staged), path(final), options)
        except Py4JJavaError:
            if not fs.exists(path(final)):
                raise
            fs.delete(path(staged), True)
            return False
        return True

    def _state(self) -> tuple[int, list[str]]:
        """Number of the newest state (0: none) and the ids of the batches that it holds."""
        n = max(map(int, self._named("state=")), default=0)
        return n, [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/state={n}/held").collect()] if n else []

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted({*self._state()[1], *self._named("batch=")})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Sum signed changes (KEYS, docs, tokens) and commit them once; False if the batch is known."""
        if not batch.replace("-", "").isalnum():
            raise ValueError("a batch id is made of letters, digits and dashes")
        if batch in self.batches():
            return False
        deltas = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        staged = f"{self.path}/_staged-{batch}-{uuid.uuid4().hex}"
        deltas.coalesce(1).write.parquet(staged)
        return self._publish(staged, f"{self.path}/batch={batch}")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches."""
        n, held = self._state()
        paths = [f"{self.path}/batch={b}" for b in sorted({*self._named("batch=")} - {*held})] + [f"{self.path}/state={n}/totals"] * bool(n)
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all deltas into a new state."""
        n, held = self._state()
        known = self.batches()
        if set(known) == set(held):
            return
        staged = f"{self.path}/_compact-{uuid.uuid4().hex}"
        self.totals().select(*KEYS, "docs", "tokens").coalesce(1).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(b,) for b in known], "batch string").coalesce(1).write.parquet(f"{staged}/held")
        self._publish(staged, f"{self.path}/state={n + 1}")  # another compaction may have been faster

    def vacuum(self) -> None:
        """Delete batches that the newest state holds and older states; not while someone reads them."""
        fs, path = self._fs()
        n, held = self._state()
        for name in [f"batch={b}" for b in self._named("batch=") if b in held] + [f"state={k}" for k in self._named("state=") if int(k) < n]:
            fs.delete(path(f"{self.path}/{name}"), True)


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes for documents that are new (KEYS, n_tokens)."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed changes for documents that go."""
    return inserts(counted).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes for documents whose counts or keys change."""
    return deletes(before).unionByName(inserts(after))


def _each(counted: DataFrame, versions: tuple[str, ...]) -> DataFrame:
    """``source, lang, tokenizer, n_tokens`` from ``source, lang`` and a column for each version."""
    rows = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("n_tokens")) for v in versions])
    return counted.select("source", "lang", F.explode(rows).alias("c")).select("source", "lang", "c.tokenizer", "c.n_tokens")


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def estimate_tokens(docs: DataFrame, bytes_per_id: int = 4, versions: tuple[str, ...] = (WORDS, SUBWORD)) -> DataFrame:
    """As :func:`count_tokens`, with subword ids (any version but words) estimated from bytes: for documents that wait for their count."""
    ids = F.coalesce(F.ceil(F.octet_length("text") / bytes_per_id), F.lit(0)).cast("long")
    return _each(docs.select("source", "lang", *[(_words() if v == WORDS else ids).alias(v) for v in versions]), versions)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, versions: tuple[str, ...] = (WORDS, SUBWORD)) -> DataFrame:
    """A row for each version and row of ``docs`` (text, lang, source): ``source, lang, tokenizer, n_tokens``.

    Words are maximal runs of non-space bytes, counted in the engine; subword ids are
    those of the public vocabulary over whole texts.
    """
    path = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)
    words = _words() if WORDS in versions else F.lit(0).cast("long")
    if SUBWORD not in versions:
        return _each(docs.select("source", "lang", words.alias(WORDS)), versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(tokens=True)
        encoder = Encoder.of(path)
        for batch in batches:
            counts = pa.array([encoder.count(t.as_py()) for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), counts], names=["source", "lang", WORDS, SUBWORD])

    return _each(docs.select("source", "lang", words.alias(WORDS), "text").mapInArrow(run, f"source string, lang string, {WORDS} long, {SUBWORD} long"), versions)
