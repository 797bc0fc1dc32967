"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 severely toxic.  One weight vector is
shared by both thresholds, P(grade >= k) = sigmoid(w.x - b_k) with b_1 <= b_2, and
the result is the expected severity, the sum of the P(grade >= k), with the grade
whose probability is largest.

Features of a text are the presence of its words and of word prefixes (families of
inflected insults share their stem); a word of more than ``LONGEST`` letters has its
prefixes only.  The labels are binary, so a labelled toxic text
is graded severe when it holds more distinct marked words than the median
labelled toxic text; marked words come from the log odds of the same sample.

The classifier is fitted on at most ``sample`` labelled documents of each class,
chosen by hash of doc_id; labelled texts with the same label and the same set of words
count once.  Features are counted and chosen in Spark; to the driver come at most
``most_features`` names with their counts and, for each text of the sample, the numbers of
those that it holds, whatever the length of the texts.  Scoring covers whole texts of all documents.

Defined results: null or empty text has no features and takes the prior severity; null
labels and labels of unknown documents are ignored; a document with labels of both kinds is
toxic; of labelled rows that repeat a doc_id with other texts each counts; without labels of
both classes every document has severity 0; repeated rows are scored alike; empty tables give
empty results; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace, fresh, small_batches

_WORD = re.compile(r"\w+")
_CACHE = 100_000
SIGNIFICANT = 24.0  # twice the log likelihood ratio that chance doesn't explain
MARKED = 3.0  # log odds of a marked word
LONGEST = 64


def features(word: str) -> tuple[str, ...]:
    """A lower-case word, and its first four and five letters where it is longer."""
    stems = ["^" + word[:n] for n in (4, 5) if len(word) > n]
    return (word, *stems) if len(word) <= LONGEST else tuple(stems)


def words_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a text; those of a very long one are found one after the other."""
    if not text:
        return set()
    return set(_WORD.findall(text.lower())) if len(text) < 1 << 20 else {m.group() for m in _WORD.finditer(text.lower())}


@dataclass
class OrdinalModel:
    """Weights of a bounded number of features and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (30.0, 60.0)

    def margins(self, texts: Iterator[str | None]) -> np.ndarray:
        """w.x of each text; every feature counts once in a text."""
        known: dict[str, tuple[str, ...]] = {}
        weights, out = self.weights, []
        for text in texts:
            held: set[str] = set()
            for word in words_of(text):
                own = known.get(word)
                if own is None:
                    own = tuple(f for f in features(word) if f in weights)
                    if len(known) < _CACHE:
                        known[word] = own
                if own:
                    held.update(own)
            out.append(sum(sorted([weights[f] for f in held])))
        return np.array(out, dtype=np.float64)

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k), one column for each threshold."""
        return 1.0 / (1.0 + np.exp(-np.clip(margins[:, None] - np.array(self.thresholds)[None, :], -700, 700)))


def likelihood(w: np.ndarray, b: np.ndarray, rows: list[np.ndarray], grade: np.ndarray, weigh: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted log likelihood of ``grade`` and its gradients by w and b; rows: the features of each text."""
    n, at = len(rows), np.arange(len(rows))
    flat = np.concatenate(rows) if n else np.zeros(0, dtype=np.int64)
    of = np.repeat(at, [len(r) for r in rows])
    p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[flat], minlength=n)[:, None] - b[None, :], -30, 30)))
    ones, zeros = np.ones((n, 1)), np.zeros((n, 1))
    above, slope = np.concatenate([ones, p, zeros], 1), np.concatenate([zeros, p * (1 - p), zeros], 1)
    # A grade's probability is the interval between its two thresholds.
    mass = np.maximum(above[at, grade] - above[at, grade + 1], 1e-9)
    upper, lower = slope[at, grade] / mass * weigh, slope[at, grade + 1] / mass * weigh
    by_b = np.array([np.sum(np.where(grade == k - 1, lower, 0)) - np.sum(np.where(grade == k, upper, 0)) for k in range(1, len(b) + 1)])
    return float(np.sum(np.log(mass) * weigh)), np.bincount(flat, (upper - lower)[of], minlength=len(w)), by_b


def fit(names: list[str], odds: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, rounds: int = 400, l2: float = 1e-6) -> OrdinalModel:
    """Fit on the sample: ``rows`` are numbers of the features ``names`` that each text holds; nothing is random."""
    y = np.asarray(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return OrdinalModel()
    marked = (odds > MARKED) & np.array([not f.startswith("^") for f in names], dtype=bool) if names else np.zeros(0, dtype=bool)
    held = np.array([int(marked[r].sum()) for r in rows])
    grade = y + ((y == 1) & (held > np.median(held[y == 1])))
    weigh = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b = np.zeros(len(names)), np.array([1.0, 2.0])
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, b)]
    for step in range(1, rounds + 1):
        _, by_w, by_b = likelihood(w, b, rows, grade, weigh)
        for g, (m, v), value in zip((l2 * w - by_w, -by_b), moments, (w, b), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.2 / np.sqrt(step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b[1] = max(b[1], b[0] + 0.05)
    return OrdinalModel({f: float(w[i]) for i, f in enumerate(names) if abs(w[i]) > 1e-6}, (float(b[0]), float(b[1])))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, toxic, words, features``: the distinct features of each text (a long list in pieces), and a hash of its set of words."""
    fresh()
    for batch in batches:
        for text, label, doc_id in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = words_of(text.as_py())
            code = hashlib.blake2b("\n".join(sorted(own)).encode("utf-8", "replace"), digest_size=16).digest()
            found = sorted({f for w in own for f in features(w)})
            for at in range(0, max(1, len(found)), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([label], pa.int32()), pa.array([code], pa.binary()), pa.array([found[at : at + 50_000]], pa.list_(pa.string()))], names=["id", "toxic", "words", "features"])


def _gain(n: list[int]) -> Column:
    """Twice the log likelihood ratio of a feature's counts k0 and k1 in classes of n texts against one common rate."""
    rate, total = (F.col("k0") + F.col("k1")) / float(sum(n)), F.lit(0.0)
    for seen, texts in ((F.col("k0"), n[0]), (F.col("k1"), n[1])):
        for part, expected in ((seen, rate * texts), (F.lit(texts) - seen, (1 - rate) * texts)):
            total = total + F.when(part > 0, part * F.log(part / expected)).otherwise(0.0)
    return 2 * total


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_features: int = 4096) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents of each class."""
    ws = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)").groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    # Two bounded tables of ids, so the join with the documents never moves a text.
    chosen = known.where("_toxic = 1").orderBy(*order).limit(sample).unionByName(known.where("_toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "_toxic", F.monotonically_increasing_id().alias("_row"))
    held = ws.cut(texts.mapInArrow(_held, "id long, toxic int, words binary, features array<string>"), "held")
    # One document for each set of words; both are at most twice the sample.
    single = held.groupBy("toxic", "words").agg(F.min("id").alias("_one"))
    one = ws.cut(single.select("_one", F.col("toxic").alias("_as"), F.col("words").alias("_words")), "single")
    n = {r["_as"]: r["n"] for r in one.groupBy("_as").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return OrdinalModel()
    alike = (F.col("id") == F.col("_one")) & (F.col("words") == F.col("_words")) & (F.col("toxic") == F.col("_as"))
    held = ws.again(held).join(F.broadcast(one), alike, "left_semi")
    single = held.select("toxic", F.explode("features").alias("feature"))
    counts = single.groupBy("feature").agg(F.count_if(F.col("toxic") == 0).alias("k0"), F.count_if(F.col("toxic") == 1).alias("k1")).where("k0 + k1 >= 3")
    # Only features whose counts chance doesn't explain, those that tell most first.
    top = counts.withColumn("gain", _gain([n[0], n[1]])).where(F.col("gain") >= SIGNIFICANT).orderBy(F.desc("gain"), "feature").limit(most_features).collect()
    names = [r["feature"] for r in top]
    odds = np.array([np.log((r["k1"] + 0.5) / (n[1] + 1)) - np.log((r["k0"] + 0.5) / (n[0] + 1)) for r in top])
    numbered = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(names)), "number int, name string"))
    found = held.select("toxic", "words", F.explode_outer("features").alias("feature")).join(numbered, F.col("feature") == F.col("name"), "left")
    # A row of at most most_features numbers for each text of the sample.
    table = found.groupBy("toxic", "words").agg(F.sort_array(F.collect_set("number")).alias("numbers")).orderBy("toxic", "words").select("toxic", "numbers").toArrow()
    rows = [np.asarray(r.values.to_numpy(zero_copy_only=False), dtype=np.int64) for r in table["numbers"]]
    return fit(names, odds, rows, table["toxic"].to_numpy())


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the model doesn't call toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        fitted = shared.value
        for batch in batches:
            p = fitted.at_least(fitted.margins(t.as_py() for t in batch.column(at)))
            yield batch.filter(pa.array(p[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        fitted = shared.value
        for batch in batches:
            p = fitted.at_least(fitted.margins(t.as_py() for t in batch.column(1)))
            mass = np.concatenate([np.ones((len(p), 1)), p], 1) - np.concatenate([p, np.zeros((len(p), 1))], 1)
            grade = mass.argmax(1).astype(np.int32) if len(p) else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(grade), pa.array(p[:, 0] >= 0.5)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
