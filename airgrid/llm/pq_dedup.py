"""Near-duplicate embeddings by product quantisation, within equal labels.

Equal vectors of one label are one class, which the smallest id stands for: what follows sees
classes with their numbers of vectors, so any number of copies costs as much as one.

A coarse quantiser and the codebooks of its residuals are fitted on a bounded sample
(``sample`` vectors, by hash of id).  Every vector joins the inverted list of its
nearest centroid with the codes of its residual, and probes each list whose bisector
with its own is within the threshold's length, so no pair at the threshold is left out,
whatever the directions of the differences.  Of two lists the one with the smaller number
probes the other, and such a pair counts for both ends.  (``deviations`` below the root of
the width cuts the reach to that many deviations of a step in a random direction: fewer probes,
and pairs are missed; the default leaves it out.)  Vectors without structure reach most lists, so a list
holds about ``list_rows`` vectors and there are no more of them than that asks for.
In a list, table lookups give asymmetric distances to all members; a pair
goes only if it stays below the threshold with the member's own quantisation error
added, and the rest is measured exactly.

A list of one label is cut into blocks of members and of probers of bounded size and each
pair of blocks is a task; a task returns counts and a spanning forest, never pairs.

Defined results: vectors that are null, empty, zero, of another length than most or
hold null or non-finite components, and those without a label, link with nothing and
are kept; of rows with one id the smallest (label, vector) counts; a null id is left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann_forest import matrix, sound
from .graph import components, contract
from .storage import Workspace, send


def units(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equally long lists in double precision, divided by their norms."""
    rows = matrix(column, width)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class Quantiser:
    """Coarse centroids, and codebooks of the residuals in each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, spaces: int, codes: int, rounds: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.centroids = _means(sample, lists, rounds, rng)
        own = _nearest(sample, self.centroids)
        residual = sample - self.centroids[own]
        self.spaces = np.array_split(np.arange(sample.shape[1]), min(spaces, sample.shape[1]))
        self.books = [_means(residual[:, s], codes, rounds, rng) for s in self.spaces]

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes and quantisation error of each row."""
        own = _nearest(rows, self.centroids)
        residual = rows - self.centroids[own]
        codes = np.stack([_nearest(residual[:, s], b) for s, b in zip(self.spaces, self.books, strict=True)], 1).astype(np.uint8)
        back = np.hstack([b[codes[:, k]] for k, b in enumerate(self.books)])
        return own, codes, np.linalg.norm(residual - back, axis=1)

    def probes(self, rows: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """(rows, lists): whether a vector within ``reach`` can be in the list."""
        length = (self.centroids**2).sum(1)
        near = length[None, :] - 2 * rows @ self.centroids.T  # squared distances but for the row's own length
        apart = length[own][:, None] + length[None, :] - 2 * self.centroids[own] @ self.centroids.T
        far = near - near[np.arange(len(rows)), own][:, None]
        return far <= 2 * reach * np.sqrt(np.maximum(apart, 0)) + 1e-7


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * rows @ centres.T, axis=1)


def _means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.permutation(len(rows))[: min(k, len(rows))]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def link_block(model: Quantiser, which: int, members: tuple, asks: tuple, ask_lists: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one list: ids, numbers of linked vectors, and the smallest id each is joined with.

    members: ids, rows, numbers of vectors, codes and errors; asks: ids, rows and numbers of vectors.
    A pair of the list itself is met from both ends and counts for the asking one; a pair with
    another list is met once and counts for both.
    """
    ids, rows, weights, codes, errors = members
    ask_ids, ask_rows, ask_weights = asks
    every = np.unique(np.concatenate([ids, ask_ids]))
    member, asker = np.searchsorted(every, ids), np.searchsorted(every, ask_ids)
    links = np.zeros(len(every), dtype=np.int64)
    tree = [np.zeros(0, dtype=np.int64)] * 2
    centre = model.centroids[which]
    for a in range(0, len(ask_rows), 256):
        q = ask_rows[a : a + 256]
        near = np.repeat((q @ centre)[:, None], len(ids), axis=1)
        for k, (space, book) in enumerate(zip(model.spaces, model.books, strict=True)):
            near += (q[:, space] @ book.T)[:, codes[:, k]]
        i, j = np.nonzero(near + errors[None, :] >= threshold - 1e-9)
        for b in range(0, len(i), 1 << 18):
            x, y = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
            good = (np.einsum("ij,ij->i", q[x], rows[y]) >= threshold) & (asker[a + x] != member[y])
            x, y = a + x[good], y[good]
            other = ask_lists[x] != which
            np.add.at(links, asker[x], weights[y])
            np.add.at(links, member[y[other]], ask_weights[x[other]])
            # A forest of the links so far is all that is kept of them.
            tree = list(contract(np.concatenate([tree[0], asker[x]]), np.concatenate([tree[1], member[y]])))
    root = np.arange(len(every))
    root[tree[0]] = tree[1]
    told = (links > 0) | (root != np.arange(len(every)))
    return every[told], links[told], every[root[told]]


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    sample: int = 8_192,
    list_rows: int = 6_144,
    most_lists: int = 4_096,
    spaces: int = 8,
    codes: int = 64,
    block_rows: int = 4_096,
    deviations: float = float("inf"),
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each id."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "pq_dedup")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("v")).where("vec_id is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    ids = ws.cut(rows.select("vec_id"), "ids")
    fit_for = rows.where("label is not null and v is not null").where(sound("v"))
    told = fit_for.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").head(1)
    nothing = ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not told:
        return nothing
    width = told[0]["width"]
    # Equal vectors meet by 128 bits.
    coded = fit_for.where(F.size("v") == width).select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit("more"), "v", "label").alias("h2"))
    same = ["label", "h1", "h2"]
    unit = ws.cut(coded.groupBy(*same).agg(F.min("vec_id").alias("id"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("n")), "classes")
    n = unit.count()
    taken = unit.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    lists = int(min(most_lists, max(8, n // list_rows), max(1, n // 64)))
    model = Quantiser(units(taken["v"], width), lists, spaces, codes)
    shared = spark.sparkContext.broadcast(model)  # most_lists centroids and spaces * codes code words
    reach = float(np.sqrt(2 - 2 * threshold)) * min(1.0, deviations / np.sqrt(width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = units(batch.column(2), width)
                n = batch.column(3)
                own, code, error = shared.value.encode(x)
                probes = shared.value.probes(x, own, reach) & (np.arange(len(shared.value.centroids)) >= own[:, None])
                offsets = np.concatenate([[0], np.cumsum(probes.sum(1))]).astype(np.int32)
                probed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(probes)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), probed, n], names=["vec_id", "label", "v", "list", "code", "error", "probes", "n"])

    listed = ws.cut(unit.select("id", "label", "v", "n").mapInArrow(assign, "vec_id long, label string, v " + kind + ", list int, code binary, error double, probes array<int>, n long"), "lists")
    members = listed.select("vec_id", "label", "list", "v", "n", "code", "error")
    probers = ws.again(listed).select("vec_id", "label", F.explode("probes").alias("list"), "v", "n", F.col("list").alias("own"))
    counts = members.groupBy("label", "list").agg(F.count("*").alias("n_members")).join(probers.groupBy("label", "list").agg(F.count("*").alias("n_probers")), ["label", "list"])
    counts = counts.select("label", "list", F.ceil(F.col("n_members") / block_rows).cast("int").alias("mb"), F.ceil(F.col("n_probers") / block_rows).cast("int").alias("pb"))
    pick = lambda many, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(many)).cast("int")
    left = members.join(counts, ["label", "list"]).withColumn("m", pick("mb", 1)).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pb") - 1))).drop("mb", "pb")
    right = probers.join(counts, ["label", "list"]).withColumn("p", pick("pb", 2)).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).drop("mb", "pb")

    def run(mine: pa.Table, asks: pa.Table) -> pa.Table:
        if not mine.num_rows or not asks.num_rows:
            found = (np.zeros(0, dtype=np.int64),) * 3
        else:
            code = np.frombuffer(b"".join(mine["code"].to_pylist()), dtype=np.uint8).reshape(mine.num_rows, -1)
            held = (mine["vec_id"].to_numpy(), units(mine["v"], width), mine["n"].to_numpy(), code, mine["error"].to_numpy())
            found = link_block(shared.value, mine["list"][0].as_py(), held, (asks["vec_id"].to_numpy(), units(asks["v"], width), asks["n"].to_numpy()), asks["own"].to_numpy(), threshold)
        return pa.table(dict(zip(("vec_id", "links", "root"), map(pa.array, found), strict=True)))

    keys = ["label", "list", "m", "p"]
    found = ws.cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "vec_id long, links long, root long"), "links")
    linked = found.groupBy(F.col("vec_id").alias("_linked")).agg(F.sum("links").alias("n_links"))
    joined = components(ws, found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    several = unit.where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], F.col("id").alias("class"), "n")
    of = coded.select("vec_id", *same).join(send(ws.cut(several, "several")), (F.col("label") == F.col("_label")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select(F.col("vec_id").alias("_member"), "class", "n")
    out = ids.join(of, F.col("vec_id") == F.col("_member"), "left").withColumn("class", F.coalesce("class", "vec_id"))
    out = out.join(send(ws.cut(linked, "linked")), F.col("class") == F.col("_linked"), "left").join(send(joined), F.col("class") == F.col("node"), "left")
    component, n_links = F.coalesce("component", "class"), F.coalesce("n_links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
