"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long bit string of random hyperplane signs and keeps
the strings as a sorted array.  A search descends in all trees to the variable-length
prefix that its own string shares, then ascends in all trees at once, a bit at a time,
until the prefixes hold enough candidates; these are scored exactly.  Largest inner
product becomes smallest angle by one more dimension, which fills every vector up to
the largest norm.

The vectors are dealt into shards by hash of their id and the queries into blocks, each
between a least and a largest number of rows; a task builds the forest of one shard and
answers one block, so its memory has a bound and no key is hot.  Equal prefixes, as of copies, are one interval of an array.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those of another length than most; rows without an id take no
part; of rows with one id the smallest vector counts; ties go to the smaller id; a
query with fewer candidates than ``k`` gets all; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import partitions

FOUND = "query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that can take part; floats stay floats, as they move at half the size."""
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where("vec_id is not null and v is not null")
    return rows.where(sound("v"))


def sound(v: str) -> Column:
    """Whether a vector has components, none of them null or not finite, and isn't zero."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64, copy=False)


def dot_rows(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(rows))
    for d in range(rows.shape[1]):
        out += rows[:, d] * q[d]
    return out


class Forest:
    """Sorted arrays of hash strings over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, norm: float, trees: int, bits: int, seed: int):
        self.vectors, self.bits, self.trees = vectors, bits, trees
        planes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, trees * bits)).astype(np.float32)
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", vectors, vectors) / norm**2))
        self.planes = planes
        codes = self._codes(np.hstack([vectors / norm, rest[:, None]]).astype(np.float32))
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def _codes(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows) of hash strings, the first bit highest."""
        out = np.zeros((self.trees, len(rows)), dtype=np.uint64)
        for a in range(0, len(rows), 4096):
            signs = (rows[a : a + 4096] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[:, a : a + 4096] |= signs[:, :, b].T.astype(np.uint64) << np.uint64(self.bits - 1 - b)
        return out

    def _range(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals (trees, queries) of entries that share ``depth`` bits with each query."""
        free = ((np.uint64(1) << (np.uint64(self.bits) - depth.astype(np.uint64))) - np.uint64(1))[None, :]
        lo, hi = np.empty(codes.shape, dtype=np.int64), np.empty(codes.shape, dtype=np.int64)
        for t in range(self.trees):
            base = codes[t] & ~free[0]
            lo[t] = np.searchsorted(self.codes[t], base, "left")
            hi[t] = np.searchsorted(self.codes[t], base | free[0], "right")
        return lo, hi

    def candidates(self, queries: np.ndarray, want: int, k: int):
        """For each query, the entries under the deepest common depth that holds ``want`` entries over all trees, and more than ``k`` distinct ones (its own may be among them) if there are as many."""
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        codes = self._codes(np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32))
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), self.bits, dtype=np.int64)
        while (low < high).any():  # the number of entries falls as the depth grows
            middle = (low + high + 1) // 2
            lo, hi = self._range(codes, middle)
            enough = (hi - lo).sum(0) >= want
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        lo, hi = self._range(codes, low)
        for i in range(len(queries)):
            depth = low[i : i + 1]
            found = self._entries(lo[:, i], hi[:, i])
            while len(found) <= k and depth[0] > 0:
                depth = depth - 1
                a, b = self._range(codes[:, i : i + 1], depth)
                found = self._entries(a[:, 0], b[:, 0])
            yield found

    def _entries(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The distinct vectors in one interval of each tree."""
        met = np.zeros(len(self.vectors), dtype=bool)
        for order, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True):
            met[order[a:b]] = True
        return np.flatnonzero(met)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, norm: float, trees: int, bits: int, share: float, least: int, seed: int) -> tuple[list, list, list]:
    """The best ``k`` of one shard for each query."""
    forest = Forest(vectors, norm, trees, bits, seed)
    want = max(least, int(share * len(ids)))
    single, slack = vectors.astype(np.float32), 4 * (vectors.shape[1] + 2) * np.finfo(np.float32).eps * norm
    out: tuple[list, list, list] = ([], [], [])
    for i, found in enumerate(forest.candidates(queries, want, k)):
        found = found[ids[found] != query_ids[i]]
        if not len(found):
            continue
        if len(found) > k:  # in single precision, with all that its rounding could bring among the first k
            rough = single[found] @ queries[i].astype(np.float32)
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack * np.linalg.norm(queries[i])]
        rows = vectors[found]
        exact = dot_rows(rows, queries[i])
        best = np.lexsort((ids[found], -exact))[:k]
        out[0].append(np.full(len(best), query_ids[i]))
        out[1].append(ids[found][best])
        out[2].append(exact[best])
    return out


def search(
    base: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = 48,
    bits: int = 32,
    share: float = 0.5,
    least: int = 2_048,
    shard_rows: tuple[int, int] = (2_048, 65_536),
    block_rows: tuple[int, int] = (256, 16_384),
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query, its own id left out.

    ``share`` of a shard's entries, counted with repeats over all trees, are candidates, and at least ``least``.
    Vectors without any structure need that many for a recall of 0.9; clustered ones do with a small share.
    """
    spark = base.sparkSession
    rows = usable(base, id_col, vector_col)
    told = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("square")).orderBy(F.desc("n"), "width").head(1)
    if not told:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, norm = told[0]["width"], told[0]["n"], float(np.sqrt(told[0]["square"]))
    one = lambda df: df.where(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = one(usable(queries, id_col, vector_col))
    # Few shards, so each query gets few lists to merge; blocks of queries give the other tasks.
    shards = max(-(-n // shard_rows[1]), min(4, -(-n // shard_rows[0])))
    count = asked.count()
    blocks = max(-(-count // block_rows[1]), min(-(-2 * partitions(spark) // shards), -(-count // block_rows[0]))) or 1
    deal = lambda column, many, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(many)).cast("int")
    left = one(rows).withColumn("part", deal("vec_id", shards, 1) * blocks)
    left = left.withColumn("part", F.explode(F.sequence(F.col("part"), F.col("part") + (blocks - 1))))
    right = asked.withColumn("block", deal("vec_id", blocks, 2)).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * blocks + F.col("block")))).drop("block")

    def run(mine: pa.Table, asks: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not mine.num_rows or not asks.num_rows:
            return none
        found = search_shard(mine["vec_id"].to_numpy(), matrix(mine["v"], width), asks["vec_id"].to_numpy(), matrix(asks["v"], width), k, norm, trees, bits, share, least, seed)
        if not found[0]:
            return none
        return pa.table({"query_id": np.concatenate(found[0]), "vec_id": np.concatenate(found[1]), "score": np.concatenate(found[2])})

    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
