"""Repeated substrings by prefix-free parsing.

Goal: every byte that a string of ``length`` bytes covers which also starts earlier,
in a smaller doc_id or before in the same document.

1. Parse.  The smallest rolling hash of a ``gram`` in each window of ``length`` bytes is
   its anchor; windows with one anchor are a run, and a run whose anchor's hash is a
   trigger begins a phrase.  Triggers depend on content only, so copies parse alike.
   A phrase is known by the bytes that its windows cover, so phrases overlap and
   none is a prefix of another with the same windows.
2. Dictionary.  Equal phrases meet by a 128-bit hash.  All windows of all but the
   earliest are repeats; highly repetitive text ends here.
3. Active suffixes.  A window of the dictionary can repeat only where its anchor occurs in another run
   of the dictionary, so anchors are counted, and unique text ends here.  The runs that are left
   are dealt by anchor, as equal windows have one anchor.
4. Suffix arrays.  A task holds the runs of whole anchors as a dictionary of distinct byte strings and a
   parse, the numbers of the strings in corpus order.  Prefix doubling sorts the dictionary's suffixes by
   their first ``length`` bytes (exactly, in byte order); sorting the parse by number gives the places of each
   string in corpus order.  Both combined put the windows in the order of their bytes and then of their
   places in the corpus, and all but the first of an equal stretch repeat.
5. With an anchor of more than ``hot`` runs each task does the same with the runs it happens to hold
   and sends the first of each equal stretch only, dealt by a 128-bit hash of the window, so no anchor and no
   passage gathers in one task.

A window ends within the bytes that its run holds, so two windows never tie beyond the dictionary, and of the
parse's suffix array only the first level, the order of numbers and then places, is needed.

Defined results: null and empty text has 0 bytes; texts shorter than ``length`` keep all;
a null doc_id comes after all others; rows that agree in doc_id and text (or in text, where
doc_id is null) are one document, and each is returned; rows of one doc_id and other texts
are documents of their own, in the order of a hash of the text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .document_keys import KEY, with_keys
from .line_dedup import gram_hashes
from .storage import Workspace, fresh, partitions, send

U64 = np.uint64
CROWDED = 1 << 62  # marks the place of a run whose anchor has many
WINDOWS = 500_000  # of crowded anchors that one task settles: 16 MB
MOST_SENT = 8_000_000  # places of 8 bytes: 64 MB


def _sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minima of all ``width`` consecutive values."""
    out, k = g.copy(), 1
    while 2 * k <= width:
        np.minimum(out[: len(out) - k], out[k:], out=out[: len(out) - k])
        k *= 2
    n = len(g) - width + 1
    return np.minimum(out[:n], out[width - k : width - k + n])


class Parse:
    """Runs and phrases of a few documents side by side.

    run_at, run_n: first window and number of windows of each run; anchor: its
    anchor's hash; phrase: whether it begins a phrase; doc: the row it is in.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, trigger: int):
        self.raw, self.offsets, self.length = raw, offsets, length
        lasts = np.maximum(offsets[1:] - length + 1, offsets[:-1])  # behind the last window of each row
        firsts = offsets[:-1][lasts > offsets[:-1]]
        if not len(firsts):
            self.run_at = self.run_n = self.doc = np.zeros(0, dtype=np.int64)
            self.anchor, self.phrase = np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
            return
        g = gram_hashes(raw, gram)
        m = _sliding_min(g, length - gram + 1)
        edge = np.zeros(len(raw) + 1, dtype=np.int32)
        edge[firsts] += 1
        np.add.at(edge, lasts[lasts > offsets[:-1]], -1)
        valid = np.cumsum(edge)[: len(m)] > 0
        begin = np.zeros(len(m), dtype=bool)
        begin[1:] = (m[1:] != m[:-1]) | (g[: len(m) - 1] == m[:-1])
        begin[firsts] = True
        begin &= valid
        self.run_at = np.flatnonzero(begin)
        self.doc = np.searchsorted(offsets, self.run_at, "right") - 1
        self.run_n = np.minimum(np.append(self.run_at[1:], len(raw)), lasts[self.doc]) - self.run_at
        self.anchor = m[self.run_at]
        head = np.zeros(len(m), dtype=bool)
        head[firsts] = True
        self.phrase = head[self.run_at] | (hashing.mix(self.anchor.copy()) % U64(trigger) == 0)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and both halves of a hash of each phrase."""
        first = np.flatnonzero(self.phrase)
        at = self.run_at[first]
        last = np.append(first[1:], len(self.run_at)) - 1
        end = self.run_at[last] + self.run_n[last]
        return at, end - at, *hashing.strong_hashes(self.raw, at, end + self.length - 1)


def _pack(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A place in one 64-bit number: first window and number of windows."""
    return (at.astype(np.int64) << 31) | n.astype(np.int64)


def _unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return places >> 31, places & 0x7FFFFFFF


def suffix_ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """The place in byte order of the ``length`` bytes from each position on, by prefix doubling; equal bytes have one rank."""
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(U64)
    known = min(8, length)
    n = len(raw) - known + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    head = np.zeros(n, dtype=U64)
    for k in range(known):
        head = head << U64(8) | raw[k : k + n].astype(U64)
    rank = dense(head)
    while known < length:
        step = min(known, length - known)
        many = U64(len(raw) + 1)
        rank = dense(rank[: max(0, len(rank) - step)] * many + rank[step:])
        known += step
    return rank


def repeats(doc: np.ndarray, at: np.ndarray, n: np.ndarray, data: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the runs of one task, whose rows are in corpus order within each anchor: row, window, whether it repeats, its place in the dictionary's bytes, and these.

    ``data``: the bytes that the windows of each run cover.
    """
    told = data.dictionary_encode()
    raw, offsets = hashing.buffers(told.dictionary)
    parse = told.indices.to_numpy(zero_copy_only=False)
    rank = suffix_ranks(raw, length)
    _, first_row = np.unique(parse, return_index=True)  # of each string its first place
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + offsets[:-1][text]
    # Suffixes in byte order, equal ones in corpus order: the first of each stretch is the original.
    order = np.lexsort((start - offsets[:-1][text], first_row[text], rank[start]))
    ranked = rank[start[order]]
    new = np.ones(len(order), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    original = np.zeros(len(raw) + 1, dtype=np.int64)
    original[start[order]] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = offsets[:-1][parse[row]] + within
    first = original[place]
    of, window = first_row[text[first]], at[row] + within
    # A row that repeats the first one's doc_id is the first itself.
    return row, window, (doc[row] != doc[of]) | (window != at[of] + start[first] - offsets[:-1][text[first]]), place, raw


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _send(places: DataFrame) -> DataFrame:
    """Places by document, sent to all tasks if they are proven to fit, else to be joined by a shuffle."""
    total = places.agg(F.coalesce(F.sum(F.size("places") + 4), F.lit(0))).first()[0]
    return F.broadcast(places) if total <= MOST_SENT else places


def _by_doc(df: DataFrame) -> DataFrame:
    """``_doc, places``: the places of each document (at most its windows) from ``doc, place``."""
    return df.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("place").alias("places"))


def repeated_windows(docs: DataFrame, ws: Workspace, length: int, gram: int, trigger: int, hot: int) -> DataFrame:
    """``doc, places``: stretches of windows that start earlier too, from ``doc, text``."""

    def parse(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Parse]]:
        for i, j, raw, offsets in hashing.slices(batch.column(column), 1 << 20):
            yield i, j, Parse(raw, offsets, length, gram, trigger)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, p in parse(batch, 1):
                if len(p.run_at):
                    at, n, h1, h2 = p.phrases()
                    rows = np.searchsorted(p.offsets, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][rows]), pa.array(_pack(at - p.offsets[rows], n)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc", "place", "h1", "h2"])

    told = ws.cut(docs.mapInArrow(phrases, "doc long, place long, h1 long, h2 long"), "phrases")
    first = told.groupBy("h1", "h2").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = ws.cut(first.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("first.doc").alias("_doc"), F.col("first.place").alias("_place")), "first")
    again = ws.again(told).join(send(first), (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where("doc != _doc or place != _place").select("doc", "place")
    copied = ws.cut(again, "copied")
    ws.drop(told)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, p in parse(batch, 1):
                if not len(p.run_at):
                    continue
                gone = []
                for k in range(i, j):
                    if batch.column(2)[k].is_valid:
                        gone.append(p.offsets[k - i] + _unpack(batch.column(2)[k].values.to_numpy(zero_copy_only=False))[0])
                heads = p.run_at[p.phrase]
                original = ~np.isin(heads, np.concatenate(gone)) if gone else np.ones(len(heads), dtype=bool)
                keep = original[np.cumsum(p.phrase) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][p.doc[keep]]), pa.array(_pack(p.run_at[keep] - p.offsets[p.doc[keep]], p.run_n[keep])), pa.array(p.anchor[keep].view(np.int64))], names=["doc", "place", "anchor"])

    parsed = docs.join(_send(ws.cut(_by_doc(copied), "copied_by_doc")), F.col("doc") == F.col("_doc"), "left").select("doc", "text", "places")
    anchored = ws.cut(parsed.mapInArrow(runs, "doc long, place long, anchor long"), "runs")
    often = ws.cut(anchored.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_anchor"), "n"), "anchors")
    crowded = F.when(F.col("n") > hot, F.lit(CROWDED)).otherwise(F.lit(0))
    active = ws.again(anchored).join(send(often), F.col("anchor") == F.col("_anchor")).select("doc", F.col("place").bitwiseOR(crowded).alias("place"))
    wanted = ws.cut(_by_doc(active), "wanted")
    ws.drop(anchored)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes that the windows of active runs cover."""
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, p in parse(batch, 1):
                lists = batch.column(2).slice(i, j - i)
                told = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy(zero_copy_only=False))
                place = told & (CROWDED - 1)
                at, n = _unpack(place)
                start, size = p.offsets[row] + at, n + length - 1
                fit = start + size <= p.offsets[row + 1]
                row, place, told, start, size = row[fit], place[fit], told[fit], start[fit], size[fit]
                if not len(row):
                    continue
                ends = np.concatenate([[0], np.cumsum(size)])
                data = p.raw[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
                cut = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                anchor = p.anchor[np.searchsorted(p.run_at, start)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(place), pa.array(anchor), pa.array(told >= CROWDED), cut], names=["doc", "place", "anchor", "hot", "bytes"])

    held = docs.join(_send(wanted), F.col("doc") == F.col("_doc")).select("doc", "text", "places")
    held = ws.cut(held.mapInArrow(contexts, "doc long, place long, anchor long, hot boolean, bytes binary"), "contexts")

    def stretches(doc: np.ndarray, window: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        """Runs of consecutive windows as places."""
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(row)))
        return pa.RecordBatch.from_arrays([pa.array(doc[row[at]]), pa.array(_pack(window[at], n))], names=["doc", "place"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> pa.RecordBatch:
            doc = table["doc"].to_numpy()
            row, window, same, _, _ = repeats(doc, *_unpack(table["place"].to_numpy()), _one(table["bytes"]), length)
            return stretches(doc, window[same], row[same])

        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                waiting.append(part)
                size += part.num_rows
                if size >= 8192:
                    table = pa.Table.from_batches(waiting).combine_chunks()
                    anchors = table["anchor"].to_numpy()
                    cut = len(anchors) - int((anchors == anchors[-1]).sum())  # the last anchor may go on
                    if cut:
                        yield done(table.slice(0, cut))
                    waiting, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield done(pa.Table.from_batches(waiting).combine_chunks())

    many = partitions(docs.sparkSession)
    plain = held.where("not hot").select("doc", "place", "anchor", "bytes").repartition(many, "anchor").sortWithinPartitions("anchor", "doc", "place").mapInArrow(compare, "doc long, place long")

    # Crowded anchors: a task keeps the first of the equal windows that it holds, and sends
    # these firsts in one row for each bucket of hashes.
    crowded = ws.again(held).where("hot").agg(F.sum(F.col("place").bitwiseAND(0x7FFFFFFF))).first()[0] or 0
    buckets = max(many, -(-crowded // WINDOWS))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                part = part.take(pa.array(np.lexsort((part.column(1).to_numpy(), part.column(0).to_numpy()))))
                doc = part.column(0).to_numpy()
                row, window, same, place, raw = repeats(doc, *_unpack(part.column(1).to_numpy()), part.column(3), length)
                known = stretches(doc, window[same], row[same])
                docs_of = known.column(0).to_numpy()
                begin = np.flatnonzero(np.append(True, docs_of[1:] != docs_of[:-1])) if len(docs_of) else np.zeros(0, dtype=np.int64)
                places = pa.ListArray.from_arrays(pa.array(np.append(begin, len(docs_of)).astype(np.int32)), known.column(1))
                lone = [pa.nulls(len(begin), pa.int32()), pa.nulls(len(begin), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(docs_of[begin]), places, *lone], names=["doc", "places", "bucket", "blob"])
                own = np.flatnonzero(~same)
                h1, h2 = hashing.strong_hashes(raw, place[own], place[own] + length)
                told = np.stack([h1, h2, doc[row[own]], window[own]], 1)
                bucket = (h1.view(U64) % U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                names, begin = np.unique(bucket[by], return_index=True)
                blobs = [told[by[x:y]].tobytes() for x, y in zip(begin, [*begin[1:], len(by)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.list_(pa.int64())), pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], names=["doc", "places", "bucket", "blob"])

    def settle(table: pa.Table) -> pa.Table:
        h1, h2, doc, window = np.frombuffer(b"".join(table["blob"].to_pylist()), dtype=np.int64).reshape(-1, 4).T
        order = np.lexsort((window, doc, h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        same = order[(doc[order] != doc[first]) | (window[order] != window[first])]
        same = same[np.lexsort((window[same], doc[same]))]
        _, row = np.unique(doc[same], return_inverse=True)
        return pa.Table.from_batches([stretches(np.unique(doc[same]), window[same], row)])

    local = ws.cut(ws.again(held).where("hot").select("doc", "place", "anchor", "bytes").mapInArrow(firsts, "doc long, places array<long>, bucket int, blob binary"), "firsts")
    settled = ws.again(local).where("blob is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(settle, "doc long, place long")
    crowd = local.where("blob is null").select("doc", "places")
    return copied.unionByName(plain).unionByName(settled).select("doc", F.array("place").alias("places")).unionByName(crowd)


def covered(places: np.ndarray, n_bytes: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that repeated windows cover."""
    at, n = _unpack(places)
    fit = at + n + length - 1 <= n_bytes
    at, n = at[fit], n[fit]
    order = np.argsort(at, kind="stable")
    at, end = at[order], np.maximum.accumulate((at + n + length - 1)[order]) if len(order) else at
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] > end[:-1]
    first = np.flatnonzero(new)
    return at[first], end[np.append(first[1:], len(at)) - 1] if len(first) else at[first]


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 32, trigger: int = 4, hot: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, kept, starts, ends`` for each row of ``docs`` (doc_id, text).

    kept: the remaining bytes; starts and ends: the removed stretches of bytes.
    """
    ws = Workspace(docs.sparkSession, "pfp_dedup")
    keyed = with_keys(ws, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    found = ws.cut(repeated_windows(keyed.select(F.col(KEY).alias("doc"), "text"), ws, length, gram, trigger, hot), "repeats")
    spots = found.groupBy(F.col("doc").alias("_doc")).agg(F.flatten(F.collect_list("places")).alias("places"))
    spots = _send(ws.cut(spots, "repeats_by_doc"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[list] = [[], [], [], []]
                for text, places in zip(batch.column(1), batch.column(2), strict=True):
                    raw = text.as_buffer()
                    raw = raw.to_pybytes() if raw is not None else b""
                    a, b = covered(places.values.to_numpy(zero_copy_only=False) if places.is_valid else np.zeros(0, dtype=np.int64), len(raw), length)
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
                    for column, value in zip(rows, (len(raw), b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)), a, b), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "kept", "starts", "ends"])

    joined = keyed.join(spots, F.col(KEY) == F.col("_doc"), "left")
    return joined.select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")
