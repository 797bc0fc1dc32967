"""Best-fit packing in bulk-synchronous rounds.

A document is its token ids and then id 0; only longer ones are cut into full
pieces, and the rest is one shorter piece.  A piece above half the capacity opens a
sequence of its own, and as many empty ones are opened as the volume needs.  The others
follow by classes of length, longest first, in rounds.  A round sorts the waiting
pieces of a class and the gaps (what is left of open sequences) together by range and sweeps
each range: a gap takes the longest free piece below it, whose successor it is, and more
while they fit.  Pieces and gaps that a range leaves are matched with those of other
ranges by counts: the r-th piece of an interval takes the r-th gap, so no two pieces
want the same room.  The gaps are updated, and the next round follows with what still waits.
Where the open sequences took less than a fiftieth of it, as many are opened as it fills.

Every table of a round is written, so a lost executor repeats tasks and not rounds.
Ranges are cut at (size, key), so equal lengths spread over tasks; the driver sees
counts of each range (``task_rows`` rows) only.

Defined results: null and empty text is the one id 0; repeated rows are packed as
separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, fresh
from .tokens import Encoder, default_vocabulary

_END_ID = bytes(4)
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key long"
LEVELS = (3, 4, 6, 8, 12, 16, 32)  # pieces above a third of the capacity are placed before those above a quarter, and so on
FEW_SLOTS = 200_000  # rows of three numbers that go to all tasks; more are joined by a shuffle
PIECE, GAP, PLACED, CHANGED, SUMMARY = range(5)  # kinds of rows; a piece sorts before a gap of its size
_SWEPT = {"kind": pa.int32(), "size": pa.int64(), "key": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "ids_crc32": pa.int64()}
_SWEPT |= {"part": pa.int32(), "rank": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
SWEPT = ", ".join(f"{name} {'int' if kind == pa.int32() else 'long'}" for name, kind in _SWEPT.items())


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Every piece of every document (doc_id, text), with a key of its own once it is written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh(tokens=True)
        encoder = Encoder.of(vocabulary)
        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("key", pa.int64())]
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.raw(text.as_py()) + _END_ID
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(ids) // 4, zlib.crc32(ids), key), strict=True):
                        column.append(value)
                    key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(out, kinds, strict=True)], names=[k for k, _ in kinds])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def sweep(sizes: list[int], kinds: list[int], keys: list[int], capacity: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """One sweep over pieces and gaps sorted by (size, kind): kinds, sizes, sequences and offsets after it.

    A gap takes the longest piece below it that is still free, whose successor it then
    is, and further ones while they fit.  Pieces become PLACED, gaps that took one
    CHANGED with the room that is left; all other rows stay as they are.
    """
    kinds, sizes = list(kinds), list(sizes)
    sequences, offsets, free = [0] * len(kinds), [0] * len(kinds), []
    for i, kind in enumerate(kinds):
        if kind == PIECE:
            free.append(i)
            continue
        room = sizes[i]
        while free and sizes[free[-1]] <= room:
            k = free.pop()
            kinds[k], sequences[k], offsets[k] = PLACED, keys[i], capacity - room
            room -= sizes[k]
        if room < sizes[i]:
            kinds[i], sizes[i] = CHANGED, room
    return kinds, sizes, sequences, offsets


def swept(state: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """Sort pieces and gaps together by range and sweep each range; what a range leaves is numbered in its order.

    Each range ends with a SUMMARY: gaps left in rank, least room in size, pieces left in
    key, greatest length in sequence_id, pieces placed in offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        kinds, sizes, sequences, offsets = sweep(t["size"].to_pylist(), t["kind"].to_pylist(), t["key"].to_pylist(), capacity)
        ranks, n = [0] * len(kinds), {PIECE: 0, GAP: 0}
        for i, kind in enumerate(kinds):
            if kind in n:
                ranks[i] = n[kind]
                n[kind] += 1
        new = {"kind": kinds, "size": sizes, "sequence_id": sequences, "offset": offsets, "rank": ranks}
        new["part"] = [TaskContext.get().partitionId()] * len(kinds)
        out = pa.table({name: pa.array(new[name], kind) if name in new else t[name].cast(kind) for name, kind in _SWEPT.items()})
        yield from out.to_batches(max_chunksize=20_000)
        gaps, pieces = ([size for size, kind in zip(sizes, kinds, strict=True) if kind == want] for want in (GAP, PIECE))
        told = {"kind": SUMMARY, "part": TaskContext.get().partitionId(), "rank": len(gaps), "size": min(gaps, default=0), "key": len(pieces)}
        told |= {"sequence_id": max(pieces, default=0), "offset": kinds.count(PLACED)}
        yield pa.RecordBatch.from_arrays([pa.array([told.get(name)], kind) for name, kind in _SWEPT.items()], names=list(_SWEPT))

    order = ["size", "kind", "key"]
    ranges = state.repartitionByRange(tasks, *order) if tasks > 1 else state.coalesce(1)
    return ranges.sortWithinPartitions(*order).mapInArrow(run, SWEPT)


def across(parts: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple], list[tuple]]:
    """Match what the ranges left, by counts alone: intervals of ranks of pieces and of gaps, with equal numbers of slots.

    parts: (range, gaps left, least room, pieces left, greatest length), ascending.  The
    gaps left in a range lie below its pieces left, so they take pieces of ranges below,
    the nearest first; each takes as many as fit whatever their lengths are there.
    Result: (range, first rank, end, first slot, pieces a slot) and (range, first rank, end, first slot).
    """
    free: list[list[int]] = []  # range, pieces left, greatest length
    pieces, gaps, slot = [], [], 0
    for part, n_gaps, room, n_pieces, longest in parts:
        rank = 0
        while rank < n_gaps and free:
            low, left, length = free[-1]
            each = max(1, room // length)
            n = min(n_gaps - rank, -(-left // each))
            first = max(0, left - n * each)
            pieces.append((low, first, left, slot, each))
            gaps.append((part, rank, rank + n, slot))
            slot, rank = slot + n, rank + n
            if first:
                free[-1][1] = first
            else:
                free.pop()
        if n_pieces:
            free.append([part, n_pieces, longest])
    return pieces, gaps


def place(ws: Workspace, cut: DataFrame, capacity: int, task_rows: int) -> DataFrame:
    """Places for pieces (doc_id, piece, start, length, ids_crc32, key), whose keys are distinct."""
    spark = cut.sparkSession
    length = F.col("length")
    own = length * 2 > capacity  # no two of these share a sequence
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("piece", "int"), ("start", "long"), ("ids_crc32", "long"))]

    def new_gaps(first: int, end: int) -> DataFrame:
        return spark.range(first, end).select(F.lit(GAP).alias("kind"), F.lit(capacity).cast("long").alias("size"), (-1 - F.col("id")).alias("key"), *nothing)

    lows = sorted({capacity // k for k in LEVELS} | {0}, reverse=True)
    levels = list(zip([capacity, *lows], lows))  # length in (low, high]
    waiting = [F.count_if(~own & (length > low) & (length <= high)).alias(f"n{low}") for high, low in levels]
    whole = cut.agg(F.sum("length").alias("ids"), F.count_if(own).alias("own"), *waiting).first()
    opened = max(0, -(-(whole["ids"] or 0) // capacity) - whole["own"])  # any packing has as many
    placed = [cut.where(own).select(*COLUMNS, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps = cut.where(own & (length < capacity)).select(F.lit(GAP).alias("kind"), (F.lit(capacity) - length).alias("size"), "key", *nothing)
    gaps = gaps.unionByName(new_gaps(0, opened))
    for high, low in levels:
        if whole[f"n{low}"]:
            pieces = cut.where(~own & (length > low) & (length <= high)).select(F.lit(PIECE).alias("kind"), length.alias("size"), "key", "doc_id", "piece", "start", "ids_crc32")
            found, gaps, opened = rounds(ws, pieces.unionByName(gaps), low, capacity, task_rows, opened, new_gaps, nothing)
            placed += found
            gaps = ws.cut(gaps, "gaps")  # the plan of a class has no rounds of classes before it
    return reduce(DataFrame.unionByName, placed)


def rounds(ws: Workspace, state: DataFrame, low: int, capacity: int, task_rows: int, opened: int, new_gaps: Callable[[int, int], DataFrame], nothing: list[Column]) -> tuple[list[DataFrame], DataFrame, int]:
    """Rounds until all pieces of ``state``, longer than ``low``, are placed: the placed ones, the gaps after it and the number of gaps opened so far."""
    spark = state.sparkSession
    is_piece, is_gap = F.col("kind") == PIECE, F.col("kind") == GAP
    placed, resting, stuck = [], [], False
    while True:
        resting.append(state.where(is_gap & (F.col("size") <= low) & (F.col("size") > 0)))
        state = state.where(is_piece | (F.col("size") > low))
        total = state.agg(F.count("*").alias("rows"), F.count_if(is_piece).alias("pieces"), F.sum(F.when(is_piece, F.col("size"))).alias("ids")).first()
        if not total["pieces"]:
            return placed, reduce(DataFrame.unionByName, resting, state), opened
        # Next to nothing fits what is open: as many sequences as the waiting pieces fill.
        more = -(-total["ids"] // capacity) if stuck else 0
        if more:
            state, opened = state.unionByName(new_gaps(opened, opened + more)), opened + more
        rows = total["rows"] + more
        done = ws.cut(swept(state, capacity, -(-rows // task_rows)), "swept")
        left = done.where(F.col("kind") == SUMMARY).select("part", "rank", "size", "key", "sequence_id", "offset").collect()
        placed.append(done.where(F.col("kind") == PLACED).select(*(F.col("size").alias("length") if c == "length" else F.col(c) for c in COLUMNS), "sequence_id", "offset"))
        n_placed = sum(r["offset"] for r in left)
        keep = [c for c in state.columns if c != "kind"]
        rest = done.where(~F.col("kind").isin(PLACED, SUMMARY))
        state = rest.withColumn("kind", F.when(is_piece, PIECE).otherwise(GAP))
        of_pieces, of_gaps = across(sorted(tuple(r)[:5] for r in left))
        if of_pieces:
            n_placed += sum(end - start for _, start, end, _, _ in of_pieces)
            at = F.col("rank") - F.col("from")
            here = (F.col("part") == F.col("range")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
            by_pieces = F.broadcast(spark.createDataFrame(of_pieces, "range int, from long, to long, first long, each long"))
            by_gaps = F.broadcast(spark.createDataFrame(of_gaps, "range int, from long, to long, first long"))
            taken = done.where(is_piece).join(by_pieces, here).withColumn("slot", F.col("first") + F.floor(at / F.col("each")))
            taking = done.where(is_gap).join(by_gaps, here).select((F.col("first") + at).alias("slot"), F.col("size").alias("room"), F.col("key").alias("gap"))
            few = sum(end - start for _, start, end, _ in of_gaps) <= FEW_SLOTS
            both = taken.join(F.broadcast(taking) if few else taking, "slot")
            in_slot = Window.partitionBy("slot").orderBy("rank")
            both = both.withColumn("used", F.sum("size").over(in_slot.rowsBetween(Window.unboundedPreceding, -1))).withColumn("last", F.lead("rank").over(in_slot).isNull())
            both = both.select(
                "doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", F.col("gap").alias("sequence_id"),
                (F.lit(capacity) - F.col("room") + F.coalesce("used", F.lit(0))).alias("offset"), "last",
            )
            matched = ws.cut(both, "matched")
            placed.append(matched.drop("last"))
            changed = matched.where("last").select(F.lit(GAP).alias("kind"), (F.lit(capacity) - F.col("offset") - F.col("length")).alias("size"), F.col("sequence_id").alias("key"), *nothing)
            marks = [(p, 0, a, b) for p, a, b, *_ in of_pieces] + [(p, 1, a, b) for p, a, b, _ in of_gaps]
            marks = F.broadcast(spark.createDataFrame(marks, "range int, of int, from long, to long"))
            untouched = F.when(F.col("of") == 0, done["kind"] == PIECE).otherwise(done["kind"] == GAP)
            state = rest.join(marks, here & untouched, "left_anti").withColumn("kind", F.when(is_piece, PIECE).otherwise(GAP))
            state = state.select("kind", *keep).unionByName(changed)
        state = state.select("kind", *keep)
        stuck = n_placed * 50 < total["pieces"]


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, task_rows: int = 50_000) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "packing")
    return place(ws, ws.cut(pieces_of(docs, vocabulary or default_vocabulary(), capacity), "pieces"), capacity, task_rows)
