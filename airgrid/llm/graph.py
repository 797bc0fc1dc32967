"""Distributed union-find: connected components of an edge table.

Each task first contracts the edges it holds to a forest, in runs of bounded size, so
what moves afterwards is at most one edge a node and task.  A forest that is counted
and proven to fit is finished by one more contraction.  A larger one goes through
rounds of star contraction: every round hangs the neighbours of a node below the
smallest node it knows, first towards larger nodes and then towards smaller ones, which
keeps the components and at least halves the depth.  A round is a grouped minimum
(combined on the map side) and an equi-join; a node with a very large neighbourhood is
never gathered into a list, and Spark may split such a join's partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

RUN = 1 << 20  # edges that a task contracts at once
MOST_EDGES = 4_000_000  # of a forest that one task finishes: 64 MB


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of depth one with the same components: each node but the smallest with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], least)
        np.minimum.at(after, root[y], least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    while not (root == root[root]).all():
        root = root[root]
    low = root != np.arange(len(nodes))
    return nodes[low], nodes[root[low]]


def _forest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts)
    u, v = contract(table["u"].to_numpy(), table["v"].to_numpy())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _contract_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, v``: the forests of a task's edges, each of a run of bounded size."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= RUN:
            held = [_forest(held)]
            size = held[0].num_rows
            if size > RUN // 2:  # few nodes met again
                yield held.pop()
                size = 0
    if size:
        yield _forest(held)


def _contract_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of all edges of a task, of which there are few."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield _forest(held)


def _stats(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).cast("string")).first())


def _star_round(now: DataFrame) -> DataFrame:
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    below = large.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m")))
    return large.join(below, "u").select(ends.alias("e")).select("e.u", F.col("e.m").alias("v")).where("u != v").distinct()


def components(ws: Workspace, edges: DataFrame, a: str = "a", b: str = "b", most_edges: int = MOST_EDGES) -> DataFrame:
    """``node, component`` for every node that occurs in an edge with another node.

    component is the smallest node that is reachable.  Edges with a null end and
    loops are ignored; repeated edges do no harm; without edges the result is empty.
    """
    plain = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u != v")
    now = ws.cut(plain.mapInArrow(_contract_runs, "u long, v long"), "forest")
    seen = _stats(now)
    if seen[0] <= most_edges:
        after = ws.cut(now.repartition(1).mapInArrow(_contract_all, "u long, v long"), "forest")
        ws.drop(now)
        now = after
    else:
        while True:
            after = ws.cut(_star_round(now), "forest")
            told = _stats(after)
            ws.drop(now)
            now = after
            if told == seen:
                break
            seen = told
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def local_roots(n: int):
    """A union-find over 0..n-1 for use inside one task: (find, union)."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        if x == y:
            return False
        if x < y:
            up[y] = x
        else:
            up[x] = y
        return True

    return find, union
