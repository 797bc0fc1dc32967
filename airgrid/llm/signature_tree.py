"""N-gram Jaccard join with signature trees.

A set of hashed word shingles stands for each document.  Documents with equal sets are
one class.  Classes are routed by min-hash bands into groups that hold every similar
pair but one in ten million (``bands`` keys of ``band_rows`` minima), the groups that
share a class are merged, and each group is joined exactly: a signature tree over its
sets has nodes with OR-combined token bitmaps and size ranges, and a dual traversal of
two trees goes down only where the largest overlap that bitmaps and sizes allow can
reach the threshold.  Sets that survive are intersected, unless they are known to be
connected.  A task returns a spanning forest, never all pairs of a group.

A group of more than ``block_weight`` shingles is cut into blocks; each pair of blocks is a
task of bounded size, so copies of a third of the corpus need no larger machine.

Defined results: null and empty text has an empty set and links with nothing; a text
of one to four words is one shingle; a null doc_id links with nothing and has a null
component; rows with one doc_id are one node and each is returned; ties need no
rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .graph import components, local_roots
from .storage import Workspace, fresh, partitions, send

U64 = np.uint64
FANOUT, BITS = 8, 2048


def band_links(keys: DataFrame) -> DataFrame:
    """``a, b``: each node of ``keys`` (node, key) with the smallest node that has a key in common."""
    first = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_most")).where("b < _most").select(F.col("key").alias("_key"), "b")
    return keys.join(first, F.col("key") == F.col("_key")).where("node != b").select(F.col("node").alias("a"), "b").distinct()


class SignatureTree:
    """Nodes over sorted sets of 64-bit hashes, level 0 the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = np.zeros((len(sets), BITS // 64), dtype=U64)
        for i, s in enumerate(sets):
            at = (s >> U64(7)) % U64(BITS)
            np.bitwise_or.at(bits[i], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        #: Of each level: bitmaps, smallest and largest size, and the largest number of
        #: tokens that bitmaps can't tell apart from others of the same set.
        self.levels = [(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1).astype(np.int64))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, hidden = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hidden, at)))


def _may_link(a: SignatureTree, b: SignatureTree, level_a: int, level_b: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    bits_a, lo_a, hi_a, hidden_a = a.levels[level_a]
    bits_b, lo_b, hi_b, hidden_b = b.levels[level_b]
    fit = (100 * hi_a[x] >= percent * lo_b[y]) & (100 * hi_b[y] >= percent * lo_a[x])
    out = np.flatnonzero(fit)
    common = np.bitwise_count(bits_a[x[out]] & bits_b[y[out]]).sum(1).astype(np.int64)
    most = np.minimum(np.minimum(common + hidden_a[x[out]], hi_a[x[out]]), np.minimum(common + hidden_b[y[out]], hi_b[y[out]]))
    fit[out] = (100 + percent) * most >= percent * (lo_a[x[out]] + lo_b[y[out]])
    return fit


def surviving_pairs(a: SignatureTree, b: SignatureTree, percent: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (x of a, y of b) that the dual traversal can't rule out; with ``same`` only x > y."""
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while todo:
        la, lb, x, y = todo.pop()
        keep = _may_link(a, b, la, lb, x, y, percent)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if not la and not lb:
            if same:
                x, y = x[x > y], y[x > y]
            if len(x):
                yield x, y
            continue
        na, nb = (la - 1 if la else 0), (lb - 1 if lb else 0)
        xs = (x[:, None] * FANOUT + np.arange(FANOUT)) if la else x[:, None]
        ys = (y[:, None] * FANOUT + np.arange(FANOUT)) if lb else y[:, None]
        x, y = np.repeat(xs, ys.shape[1], axis=1).ravel(), np.tile(ys, (1, xs.shape[1])).ravel()
        real = (x < len(a.levels[na][1])) & (y < len(b.levels[nb][1]))
        if same and na == nb:
            real &= x >= y
        x, y = x[real], y[real]
        for at in range(0, len(x), 1 << 15):
            todo.append((na, nb, x[at : at + (1 << 15)], y[at : at + (1 << 15)]))


def linked(nodes: np.ndarray, sets: list[np.ndarray], block: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between the sets of one task.

    ``block`` is 0 or 1: with both in use only pairs between the two are compared.
    """
    find, union = local_roots(len(sets))
    a, b = [], []

    def compare(i: int, j: int) -> None:
        s, t = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        if 100 * len(s) >= percent * len(t) and len(s) and find(i) != find(j):
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            both = int((t[at] == s).sum())
            if 100 * both >= percent * (len(s) + len(t) - both) and union(i, j):
                a.append(nodes[i])
                b.append(nodes[j])

    if len(sets) <= FANOUT:  # one node of a tree
        for i in range(len(sets)):
            for j in range(i):
                if block[i] != block[j] or not block.any():
                    compare(i, j)
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    parts = [np.flatnonzero(block == k) for k in (0, 1)]
    parts = [p[np.argsort([len(sets[i]) for i in p], kind="stable")] for p in parts if len(p)]
    trees = [SignatureTree([sets[i] for i in p]) for p in parts]
    for x, y in surviving_pairs(trees[0], trees[-1], percent, len(parts) == 1):
        for i, j in zip(parts[0][x].tolist(), parts[-1][y].tolist(), strict=True):
            compare(i, j)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def exact_links(members: DataFrame, to_sets: Callable[[pa.ChunkedArray], list[np.ndarray]], percent: int, block_weight: int, link: Callable = linked, gather: bool = False) -> DataFrame:
    """``a, b``: a spanning forest of the links in each group of ``members`` (node, grp, weight, text).

    Groups heavier than ``block_weight`` are cut into blocks by hash of node, and each
    pair of blocks is a task, which ``link`` joins.  With ``gather``, lighter groups go to Python many at a time,
    about ``block_weight`` together, as most have two members only; each is joined by itself.
    """
    blocks = members.groupBy("grp").agg(F.sum("weight").alias("_weight"), F.ceil(F.sum("weight") / block_weight).cast("int").alias("blocks")).select(F.col("grp").alias("_grp"), "blocks", "_weight")
    blocks = Workspace(members.sparkSession, "blocks").cut(blocks, "blocks")
    bins = max(4 * partitions(members.sparkSession), (blocks.where("blocks <= 1").agg(F.sum("_weight")).first()[0] or 0) // block_weight + 1) if gather else 1
    dealt = members.join(send(blocks.drop("_weight")), F.col("grp") == F.col("_grp")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    light = (F.col("blocks") <= 1) & F.lit(gather)
    dealt = dealt.withColumns({"bin": F.when(light, F.pmod(F.xxhash64("grp"), F.lit(bins))), "alone": F.when(~light, F.col("grp"))})
    dealt = dealt.select("node", "text", "grp", "bin", "alone", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        first = np.unique(nodes, return_index=True)[1]
        if len(first) < len(nodes):  # each text of a node counts, and counts once
            told: dict[tuple, int] = {}
            for i, known in enumerate(zip(nodes.tolist(), table["text"].to_pylist(), strict=True)):
                told.setdefault(known, i)
            first = np.array(list(told.values()), dtype=np.int64)
        table = table.take(first)
        nodes, sets, side, grp = nodes[first], to_sets(table["text"]), table["side"].to_numpy(), table["grp"].to_numpy()
        order = np.argsort(grp, kind="stable")
        links = []
        for at in np.split(order, np.flatnonzero(np.diff(grp[order])) + 1):
            links.append(link(nodes[at], [sets[i] for i in at], side[at], percent))
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("alone", "bin", "p", "q").applyInArrow(run, "a long, b long")


def shingle_sets(texts: pa.ChunkedArray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, _, raw, offsets in hashing.slices(texts):
        values, at = hashing.shingles(raw, offsets, size)
        out.extend(np.unique(values[at[i] : at[i + 1]]) for i in range(len(at) - 1))
    return out


def prefix_keys(own: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a sorted set, as many as any set linked with it must share one of."""
    return own[: len(own) - -(-percent * len(own) // 100) + 1]


def signatures(docs: DataFrame, size: int, bands: int, band_rows: int, percent: int, exact: bool, seed: int = 3) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, keys`` of each row: set size, a 128-bit hash of the set, band keys or those of the exact way."""
    factors, shifts = hashing.hash_family(bands * band_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            for i, j, raw, offsets in hashing.slices(batch.column(1)):
                values, at = hashing.shingles(raw, offsets, size)
                n, h, prefixes = np.zeros(j - i, dtype=np.int64), np.zeros((2, j - i), dtype=U64), []
                for k in range(j - i):
                    own = np.unique(values[at[k] : at[k + 1]])
                    n[k] = len(own)
                    h[0, k], h[1, k] = own.sum(), hashing.mix(own ^ U64(0x2545F4914F6CDD1D)).sum()
                    if exact:
                        prefixes.append(prefix_keys(own, percent) if len(own) else own)
                held = np.flatnonzero(n)
                keys = np.concatenate(prefixes) if exact else np.zeros((0, bands), dtype=U64)
                per = np.array([len(p) for p in prefixes]) if exact else np.where(n > 0, bands, 0)
                if len(held) and not exact:
                    minima = hashing.min_hashes(values, np.append(at[:-1][held], at[-1]), factors, shifts)
                    keys = hashing.band_keys(minima, band_rows)
                ends = np.zeros(j - i + 1, dtype=np.int32)
                np.cumsum(per, out=ends[1:])
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def similar_documents(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = 40, band_rows: int = 5, block_weight: int = 2_000_000, exact: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text).

    With ``exact`` documents are routed by the prefixes of their sets in the order of hashes, which miss no
    link at all; passages that many documents share then make large groups, so it costs much more.
    """
    ws = Workspace(docs.sparkSession, "signature_tree")
    signed = ws.cut(signatures(docs, size, bands, band_rows, percent, exact), "signatures")
    narrow = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "h1", "h2")
    classes = ws.cut(narrow.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("first")), "classes")
    # The first document of each class, with its band keys.
    told = ws.again(signed).where("n_shingles > 0 and doc_id is not null").join(classes.select(F.col("first").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), (F.col("doc_id") == F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    keys = ws.cut(told.select(F.col("doc_id").alias("node"), "n_shingles", "keys"), "keys")
    groups = components(ws, band_links(keys.select("node", F.explode("keys").alias("key"))))
    groups = ws.cut(groups.join(ws.again(keys).groupBy("node").agg(F.max("n_shingles").alias("weight")), "node"), "groups")
    wanted = groups.select(F.col("node").alias("_id"), F.col("component").alias("grp"), "weight")
    members = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(send(wanted), F.col("node") == F.col("_id")).select("node", "grp", "weight", "text")
    # A doc_id with several texts has all of them as sets of the one node.
    links = ws.cut(exact_links(members, lambda texts: shingle_sets(texts, size), percent, block_weight), "links")
    same = narrow.join(classes, ["n_shingles", "h1", "h2"]).where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    joined = components(ws, links.unionByName(same)).withColumnRenamed("node", "_node")
    return signed.select("doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("_node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
