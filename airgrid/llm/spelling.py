"""Spelling variants of a corpus by a rare-first prefix filter on positional bigrams.

1. Runs of letters are counted over all documents; what is left are distinct words.
2. Bigrams get a global order, the rarest first.  One edit breaks at most two bigrams of
   a word and moves others by one place at most, so of two near words the first common
   bigram in that order is among the three rarest of both, and its places differ by no
   more than the lengths do.
3. Words are joined on these bigrams.  The position limit is carried to the end: the edit is on
   one side of a common bigram and in one half of what is there, so all of the text outside
   such a stretch is equal, and with the place is the key of an equi-join.  Keys of this kind are nearly as many as
   words, so no key is hot; a pair counts if its edit distance is 1.
4. A word's form is its most frequent near word if that is twice as frequent.  Frequencies
   double along forms, so chains are short and a few doublings of pointers find the roots.

Defined results: null text has no words; a null doc_id counts as an empty one; repeated rows
count each; ties of forms go to the smaller word; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .storage import Workspace, fresh, small_batches

PREFIX = 3  # bigrams of a word that are joined: one more than an edit can break
PIECE = 1 << 20  # bytes that are looked at together
_ASCII = np.zeros(256, dtype=bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LONG_RUN = 64  # bytes
_ONES = np.uint32(0xFFFFFFFF)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the table of CRC-32 by its rule
    _CRC = np.where(_CRC & np.uint32(1), (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_LEAD = 0xC3  # first byte of all letters from U+00C0 to U+00FF, and of no other


def letter_runs(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of letters of the maximal runs of letters; none goes over an edge."""
    if not len(raw):
        return (np.zeros(0, dtype=np.int64),) * 3
    lead = raw == _LEAD
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    at = edges[(edges > 0) & (edges < len(raw))]
    begins[at] = inside[at]
    stops[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, ends - starts - (leads[ends] - leads[starts])


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, edges, rows) of about PIECE bytes: whole rows, or parts of a long one that are cut where no letter is."""
    for i, j, raw, offsets in hashing.slices(texts, PIECE):
        if j - i > 1 or len(raw) <= 2 * PIECE:
            yield raw, offsets, np.arange(i, j)
            continue
        at = 0
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            while end < len(raw) and (_ASCII[raw[end]] or raw[end] == _LEAD or raw[end - 1] == _LEAD):
                end += 1
            yield raw[at:end], np.array([0, end - at]), np.array([i])
            at = end


def crc32s(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, each carried on from the CRC-32 of what comes before it."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, n = starts[order], (ends - starts)[order]
    code = states[order] ^ _ONES
    common = int(np.searchsorted(-n, -LONG_RUN))  # longer ones are rare and go one by one
    for k in range(int(n[common]) if common < len(n) else 0):
        m = int(np.searchsorted(-n, -k))
        code[common:m] = _CRC[(code[common:m] ^ raw[at[common:m] + k]) & np.uint32(255)] ^ (code[common:m] >> np.uint32(8))
    out = np.empty_like(code)
    out[order] = code ^ _ONES
    for k in order[:common].tolist():
        out[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(states[k]))
    return out


def counted_runs(doc_ids: pa.Array, texts: pa.Array, least: int, every: int) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a batch of documents, words counted piece by piece."""
    ids = doc_ids.to_pylist()
    for raw, edges, rows in pieces(texts):
        raw = hashing.lower(raw)
        starts, ends, size = letter_runs(raw, edges)
        held = size >= least
        starts, ends, size = starts[held], ends[held], size[held]
        whole, lost = np.ones(len(starts), dtype=bool), []
        if every:
            states = np.array([zlib.crc32(f"{'' if ids[k] is None else ids[k]}:".encode()) for k in rows.tolist()], dtype=np.uint32)
            codes = crc32s(raw, starts, ends, states[np.searchsorted(edges, starts, "right") - 1])
            for k in np.flatnonzero(codes % np.uint32(every) == 0).tolist():
                whole[k] = False
                run, cut = raw[starts[k] : ends[k]].tobytes().decode(), int(codes[k]) % int(size[k])
                lost.append(run[:cut] + run[cut + 1 :])
        lost = [w for w in lost if len(w) >= least]
        starts, n = starts[whole], (ends - starts)[whole]
        at = np.concatenate([[0], np.cumsum(n)])
        data = raw[np.repeat(starts - at[:-1], n) + np.arange(at[-1])]
        words = pa.concat_arrays([pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)), pa.array(lost, pa.string())])
        told = words.value_counts()
        yield pa.RecordBatch.from_arrays([told.field(0), told.field(1)], names=["word", "n"])


def word_counts(docs: DataFrame, least: int = 5, often: int = 3, every: int = 97) -> DataFrame:
    """``word, n``: words of at least ``least`` letters that occur ``often`` times in ``docs`` (doc_id, text); with ``every``, one of so many runs loses a letter.

    A run's hash is the CRC-32 of doc_id, a colon and the run; where ``every`` divides it, its letter number hash % length goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            made = [b for b in counted_runs(batch.column(0), batch.column(1), least, every) if b.num_rows]
            if made:
                yield from pa.Table.from_batches(made).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=20_000)

    small_batches(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("string"), "text").where("text is not null").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """``word, n, size, gram, pos``: the rarest bigrams of each word (word, n), with their places from 0."""
    size = F.length("word")
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pos", "gram"))
    # Pairs of 90 letters: at most 8,100 rows.
    often = words.select(F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(often), F.col("gram") == F.col("_gram")).groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))), 1, PREFIX).alias("rare"))
    return ranked.select("word", "n", size.alias("size"), F.explode("rare").alias("g")).select("word", "n", "size", "g.gram", "g.pos")


def _keys(rare: DataFrame, longer: int) -> DataFrame:
    """``key, word, n, own`` of ``rare``: all of a word but the stretch that an edit may be in, by length and place in the shorter of two near words.

    The edit leaves the bigram whole, so it is in the first or second half of what comes after it, or of what comes
    before it; in the latter case the word that is ``longer`` by a letter has the bigram a place further on.
    """
    rows = rare.withColumns({"own": F.col("size"), "size": F.col("size") - longer, "before": F.col("pos") - longer})
    rows = rows.withColumns({"half": F.expr("pos + 2 + (size - pos - 2) div 2"), "front": F.expr("before div 2")})
    after, first = f"pos + 2 <= own - {longer}", "before >= 0"
    keys = [
        f"if({after}, xxhash64(0, size, pos, substr(word, 1, pos + 2), substr(word, int(half) + {longer} + 1)), null)",
        f"if({after}, xxhash64(1, size, pos, substr(word, 1, int(half))), null)",
        f"if({first}, xxhash64(2, size, before, substr(word, int(front) + {longer} + 1)), null)",
        f"if({first}, xxhash64(3, size, before, substr(word, 1, int(front)), substr(word, before + {longer} + 1)), null)",
    ]
    return rows.select(F.explode(F.array_compact(F.array(*map(F.expr, keys)))).alias("key"), "word", "n", "own")


def near_words(ws: Workspace, words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: pairs of words (word, n) at an edit distance of 1, once each."""
    rare = ws.cut(rare_bigrams(words), "rare")
    shorter, again = _keys(rare, 0), ws.again(rare)
    right = _keys(again, 0).unionByName(_keys(again, 1)).select(F.col("key").alias("_key"), F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("own").alias("other_own"))
    once = (F.col("other_own") > F.col("own")) | ((F.col("other_own") == F.col("own")) & (F.col("word") < F.col("other")))
    near = shorter.join(right, (F.col("key") == F.col("_key")) & once & (F.levenshtein("word", "other", 1) == 1))
    return near.select("word", "n", "other", "other_n").distinct()


def roots(ws: Workspace, forms: DataFrame) -> DataFrame:
    """``word, root`` for each word of ``forms`` (word, form): the end of its chain; the distance covered doubles with each round."""
    now = ws.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ws.again(now).select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = ws.cut(now.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        ws.drop(now)
        now = after
        if not now.where("moved").head(1):
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = 5, often: int = 3, every: int = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "spelling")
    words = ws.cut(word_counts(docs, least, often, every), "words")
    near = ws.cut(near_words(ws, words), "near")
    ends = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    of = near.select(ends.alias("e")).select("e.*").groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    twice = -F.col("best.less") >= 2 * F.col("n")
    told = ws.cut(of.select(F.col("word").alias("_word"), "n_near", F.when(twice, F.col("best.other")).alias("form"), F.when(twice, -F.col("best.less")).alias("form_n")), "forms")
    ends_at = roots(ws, told.where("form is not null").select(F.col("_word").alias("word"), "form")).withColumnRenamed("word", "_of")
    out = words.join(ws.again(told), F.col("word") == F.col("_word"), "left").join(ends_at, F.col("word") == F.col("_of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
