"""Fuzzy line dedup by MinHash.

Lines are split at line feeds.  Equal lines meet by a 128-bit hash.  Character shingles
(``size`` bytes) of each line give min-hash signatures, whose bands gather candidates
(``bands`` keys of ``band_rows`` minima: 998 of 1000 pairs at similarity 0.8, all but one
in a hundred thousand at 0.9); candidates are verified by exact Jaccard similarity of
their shingle sets, and distributed union-find joins verified pairs.  Of each
component the line that comes first by (doc_id, line number) stays, wherever it occurs
again it goes.

A line shorter than ``size`` bytes is one shingle, so it is like its exact copies only, which
meet by hash.  Empty lines always stay, and with a larger ``least`` all lines of fewer bytes.

Defined results: null text stays null and has no lines; an empty text has one empty
line; rows that agree in doc_id and text (or in text, where doc_id is null) are one document and
keep their lines together; rows of one doc_id and other texts are documents of their own, in
the order of a hash of the text; a null doc_id comes last; a text of which all
lines go is empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .document_keys import KEY, with_keys
from .graph import components
from .signature_tree import FANOUT, SignatureTree, band_links, exact_links, linked
from .storage import Workspace, fresh, send

U64 = np.uint64


def line_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the number of lines before each row (n + 1)."""
    feeds = np.flatnonzero(raw == 10)
    per = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    return starts, ends, np.concatenate([[0], np.cumsum(per)])


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on."""
    n = len(raw) - size + 1
    out = np.zeros(max(n, 0), dtype=U64)
    # Piece by piece, so that sums and powers of a long text are those of a piece.
    for at in range(0, n, hashing.PIECE):
        total = hashing.prefix_sums(raw[at : at + hashing.PIECE + size - 1])
        m = len(total) - size
        out[at : at + m] = hashing.mix((total[size:] - total[:m]) * hashing.powers(len(total))[1][:m])
    return out


def gram_sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    out: list[np.ndarray] = []
    for _, _, raw, offsets in hashing.slices(texts):
        grams = gram_hashes(raw, size)
        out.extend(np.unique(grams[a : max(a, b - size + 1)]) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    return out


def linked_by_prefix(nodes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`linked` finds, by the rarest shingles: two sets that link have one in common among as many of each as the threshold lets differ, and one more.

    A group of look-alikes, which bands have chained, shares its common shingles only, so hardly a pair of it is compared; in one of
    near copies, sets that are known to be connected are passed over.
    """
    if len(sets) <= FANOUT:
        return linked(nodes, sets, block, percent)
    by = np.argsort([len(s) for s in sets], kind="stable")
    by = by[np.array([len(sets[i]) for i in by]) > 0]
    sizes, side, n = np.array([len(sets[i]) for i in by], dtype=np.int64), block[by], len(by)
    if not n:
        return nodes[:0], nodes[:0]
    # Shingles by their rank of frequency in this group, the rarest of each set first.
    _, ids, count = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), dtype=np.int64)
    rare = np.argsort(count, kind="stable")
    rank[rare] = np.arange(len(count))
    owner, offsets = np.repeat(np.arange(n), sizes), np.concatenate([[0], np.cumsum(sizes)])
    ids = rank[ids]
    ids = ids[np.lexsort((ids, owner))]
    prefix = sizes - -(-percent * sizes // 100) + 1
    held = (np.arange(len(ids)) - np.repeat(offsets[:-1], sizes) < np.repeat(prefix, sizes)) & (count[rare][ids] > 1)
    shingle, own = ids[held], owner[held]
    order = np.lexsort((own, shingle))
    shingle, own = shingle[order], own[order]
    runs = np.flatnonzero(np.diff(shingle, prepend=-1))
    start = np.repeat(runs, np.diff(np.append(runs, len(own))))
    later = np.flatnonzero(np.arange(len(own)) > start)  # those with smaller sets before them
    later = later[np.argsort(own[later], kind="stable")]
    bounds = np.searchsorted(own[later], np.arange(n + 1))
    least = np.searchsorted(100 * sizes, percent * sizes)  # the first set that is large enough
    label, near_by, two = np.arange(n), np.zeros(n, dtype=bool), bool(side.any())
    classes = {i: [i] for i in range(n)}
    bits, _, _, hidden = SignatureTree([sets[i] for i in by]).levels[0]
    mark = np.zeros(len(count), dtype=bool)
    a, b = [], []
    for i in range(n):
        mine = later[bounds[i] : bounds[i + 1]]
        if not len(mine):
            continue
        for p, q in zip(start[mine].tolist(), mine.tolist(), strict=True):
            near_by[own[p:q]] = True
        low = least[i]
        other = near_by[low:i] & (label[low:i] != label[i])
        near = low + np.flatnonzero(other & (side[low:i] != side[i]) if two else other)
        near_by[:i] = False
        if len(near):  # what bitmaps can't rule out
            common = np.bitwise_count(bits[near] & bits[i]).sum(1).astype(np.int64)
            most = np.minimum(np.minimum(common + hidden[near], sizes[near]), np.minimum(common + hidden[i], sizes[i]))
            near = near[(100 + percent) * most >= percent * (sizes[near] + sizes[i])]
        if not len(near):
            continue
        words = ids[offsets[i] : offsets[i + 1]]
        mark[words] = True
        step = 16
        while len(near):
            some, near = near[:step], near[step:]
            step = min(4 * step, 1 << 12)
            ends = np.cumsum(sizes[some])
            begins = ends - sizes[some]
            both = np.add.reduceat(mark[ids[np.repeat(offsets[some] - begins, sizes[some]) + np.arange(ends[-1])]].astype(np.int64), begins)
            for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)].tolist():
                x, y = int(label[i]), int(label[j])
                if x != y:
                    if len(classes[x]) < len(classes[y]):
                        x, y = y, x
                    label[classes[y]] = x
                    classes[x] += classes.pop(y)
                    a.append(nodes[by[i]])
                    b.append(nodes[by[j]])
            near = near[label[near] != label[i]]
        mark[words] = False
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def signed_lines(docs: DataFrame, least: int, size: int, bands: int, band_rows: int, seed: int = 17) -> DataFrame:
    """``doc, line, hash, more, keys`` from ``_airgrid_doc, text``: each line of at least ``least`` bytes, with both halves of its hash; keys are null where this worker has given them before, and of lines below ``size`` bytes."""
    factors, shifts = hashing.hash_family(bands * band_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        given: set[int] = set()
        for batch in batches:
            for i, j, raw, offsets in hashing.slices(batch.column(1), 1 << 20):
                starts, ends, at = line_spans(raw, offsets)
                rows = np.repeat(np.arange(i, j), np.diff(at))
                number = np.arange(len(starts)) - np.repeat(at[:-1], np.diff(at))
                long_ = np.flatnonzero(ends - starts >= max(1, least))
                if not len(long_):
                    continue
                starts, ends, rows, number = starts[long_], ends[long_], rows[long_], number[long_]
                h, more = hashing.strong_hashes(raw, starts, ends)
                _, first = np.unique(h, return_index=True)
                first = np.sort(first[(ends - starts)[first] >= size])
                new = np.array([k for k in first.tolist() if h[k].item() not in given], dtype=np.int64)
                if len(given) < 200_000:
                    given.update(h[new].tolist())
                counts = np.zeros(len(h), dtype=np.int64)
                keys = np.zeros((0, bands), dtype=U64)
                if len(new):
                    # The bytes of the new lines side by side; a gram that leaves its line is skipped over.
                    grams = gram_hashes(raw, size)
                    n = ends[new] - starts[new] - size + 1
                    own = np.concatenate([[0], np.cumsum(n)])
                    values = grams[np.repeat(starts[new] - own[:-1], n) + np.arange(own[-1])]
                    keys = hashing.band_keys(hashing.min_hashes(values, own, factors, shifts), band_rows)
                    counts[new] = bands
                made = np.zeros(len(h), dtype=bool)
                made[new] = True
                ends_of = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(keys.ravel().view(np.int64)), mask=pa.array(~made))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(number.astype(np.int32)), pa.array(h), pa.array(more), lists], names=["doc", "line", "hash", "more", "keys"])

    return docs.select(KEY, "text").where("text is not null").mapInArrow(run, "doc long, line int, hash long, more long, keys array<long>")


def dedup_lines(docs: DataFrame, least: int = 1, size: int = 8, percent: int = 80, bands: int = 12, band_rows: int = 4, block_weight: int = 2_000_000) -> DataFrame:
    """``docs`` (doc_id, text and others) with the repeated lines taken out of text, and ``n_lines``, ``n_removed``.

    With ``least`` above 1, shorter lines are left alone however often they occur.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    keyed = with_keys(ws, docs)
    lines = ws.cut(signed_lines(keyed, least, size, bands, band_rows), "lines")
    place = F.struct("doc", "line")
    keys = ws.again(lines).where("keys is not null").select(F.col("hash").alias("node"), F.explode("keys").alias("key"))
    groups = ws.cut(components(ws, band_links(keys)), "groups")

    # One occurrence of each candidate line, and its text from the documents that hold one.
    found = lines.join(send(groups), F.col("hash") == F.col("node")).groupBy("node", "component").agg(F.min(place).alias("at"))
    wanted = found.groupBy(F.col("at.doc").alias("_id")).agg(F.collect_list(F.struct("node", F.col("component").alias("grp"), F.col("at.line").alias("line"))).alias("wanted"))
    texts = keyed.select(KEY, F.split("text", "\n", -1).alias("all")).where("all is not null").join(send(ws.cut(wanted, "wanted")), F.col(KEY) == F.col("_id"))
    taken = F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), w["grp"].alias("grp"), F.get("all", w["line"]).alias("text")))
    members = texts.select(F.explode(taken).alias("w")).select("w.*").where("text is not null")
    members = members.withColumn("weight", F.octet_length("text").cast("long"))
    links = ws.cut(exact_links(members, lambda t: gram_sets(t, size), percent, block_weight, linked_by_prefix, gather=True), "links")
    joined = ws.cut(components(ws, links), "components")

    # The class of a line is its component, or its own 128-bit hash.
    own = F.col("component").isNull()
    classed = lines.select("doc", "line", "hash", "more").join(send(joined), F.col("hash") == F.col("node"), "left")
    classed = ws.cut(classed.select("doc", "line", F.coalesce("component", "hash").alias("class"), F.when(own, F.col("more")).otherwise(0).alias("rest")), "classed")
    first = classed.groupBy("class", "rest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = ws.cut(first.select(F.col("class").alias("_class"), F.col("rest").alias("_rest"), F.col("first.doc").alias("_doc"), F.col("first.line").alias("_line")), "first")
    again = ws.again(classed).join(send(first), (F.col("class") == F.col("_class")) & (F.col("rest") == F.col("_rest"))).where("doc != _doc or line != _line")
    removed = ws.cut(again.groupBy(F.col("doc").alias("_airgrid_id")).agg(F.sort_array(F.collect_set("line")).alias("_airgrid_gone")), "removed")
    out = keyed.join(send(removed), F.col(KEY) == F.col("_airgrid_id"), "left").withColumn("_airgrid_lines", F.split("text", "\n", -1))
    all_lines, gone = F.col("_airgrid_lines"), F.col("_airgrid_gone")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    kept = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    rest = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return out.select(*rest, kept.alias("text"), F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size(gone), F.lit(0))).cast("long").alias("n_removed"))
