"""Nearest neighbours and near-duplicate vectors against brute force."""

import os

import numpy as np
import pytest

from airgrid.llm.ann_forest import Forest, search
from airgrid.llm.graph import local_roots
from airgrid.llm.pq_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, v array<double>, part int, rank int, n_links long, component_id long, list int"


def _vectors(spark, n=700, width=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.standard_normal((n - n // 2, width)).astype(np.float32) * 0.12
    x *= rng.uniform(0.5, 2, (n, 1)).astype(np.float32)
    rows = [(i, [float(a) for a in x[i]], int(i % (n // 2) % 3), [1.0], 1, 1, 1, 1, 1) for i in range(n)]
    rest = [1.0], 1, 1, 1, 1, 1
    bad = [
        (n, None, 0, *rest), (n + 1, [], 0, *rest), (n + 2, [0.0] * width, 0, *rest), (n + 3, [None] + [1.0] * (width - 1), 0, *rest), (n + 4, [float("nan")] * width, 0, *rest), (n + 5, [float("inf")] * width, 0, *rest),
        (n + 6, [1.0] * (width + 1), 0, *rest), (None, rows[0][1], 0, *rest), (n + 7, rows[0][1], None, *rest), rows[5], (n + 20, rows[0][1], 0, *rest), (n + 21, rows[0][1], 0, *rest),
    ]
    return spark.createDataFrame(rows + bad, SCHEMA).repartition(3)


def _usable(df, width=16):
    out = {}
    for r in df.select("vec_id", "embedding", "label").collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out[r["vec_id"]] = (np.array(v, dtype=np.float64), r["label"])
    return out


def test_search(spark):
    df = _vectors(spark)
    k, vectors = 7, _usable(df)
    ids = np.array(sorted(vectors))
    x = np.stack([vectors[i][0] for i in ids])
    rows = search(df, df.where("vec_id % 20 = 0"), k=k, shard_rows=(200, 65_536), block_rows=(8, 16), least=100).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in by.items():
        assert [r["rank"] for r in found] == list(range(1, k + 1)) and q not in {r["vec_id"] for r in found}
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        score = dict(zip(ids.tolist(), (x @ vectors[q][0]).tolist(), strict=True))
        assert all(abs(score[r["vec_id"]] - r["score"]) < 1e-9 for r in found)
        best = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:k]
        hits += len(set(best) & {r["vec_id"] for r in found})
    assert hits >= 0.9 * k * len(by)


def test_search_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    one = few.where("vec_id = 0")
    assert search(one, one).count() == 0
    assert search(few.limit(0), few.limit(0)).count() == 0 and search(few, few.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["isotropic", "clustered", "sf0.1"])
def test_recall_of_production_parameters(spark, table):
    """Recall of 0.9 against brute force, on vectors without structure too; clustered ones need few candidates."""
    rng = np.random.default_rng(6)
    if table == "sf0.1":
        if not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"):
            pytest.skip("the driver's tables are not here")
        rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    else:
        ids, x = np.arange(3000), rng.standard_normal((3000, 64)).astype(np.float32).astype(np.float64)
        if table == "clustered":
            x = x[rng.integers(0, 40, 3000)] + 0.15 * rng.standard_normal((3000, 64))
            x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), "vec_id long, embedding array<float>").repartition(3)
    found = {}
    for r in search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0).tolist():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & found[int(ids[q])])
    assert hits >= 0.9 * 20 * len(found)
    forest = Forest(x, float(np.linalg.norm(x, axis=1).max()), 48, 32, 11)
    if table == "clustered":  # the number asked for, not the size of the table, says how much is scored
        assert np.mean([len(c) for c in forest.candidates(x[:50], 1024, 20)]) < 0.25 * len(x)


def test_copies_count_in_full(spark):
    """Classes of equal vectors: every copy is a link, and joins by shuffle give the same."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((6, 16)).astype(np.float32)
    base[1] = base[0] + 0.01
    rows = [(i, base[i % 6].tolist(), 0 if i < 540 else 1) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    links = {i: (179 if i % 6 < 2 else 89) if i < 540 else (19 if i % 6 < 2 else 9) for i in range(600)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == {i: (links[i], (0 if i < 540 else 540) + (0 if i % 6 < 2 else i % 6)) for i in range(600)}


@pytest.mark.parametrize("block", [4_096, 40])
def test_near_duplicates(spark, block):
    df = _vectors(spark)
    vectors = {i: (v / np.linalg.norm(v), label) for i, (v, label) in _usable(df).items() if label is not None}
    every = sorted({r["vec_id"] for r in df.select("vec_id").collect() if r["vec_id"] is not None})
    at = {n: k for k, n in enumerate(every)}
    find, union = local_roots(len(every))
    links = dict.fromkeys(every, 0)
    ids = sorted(vectors)
    for i in ids:
        for j in ids:
            if j < i and vectors[i][1] == vectors[j][1] and vectors[i][0] @ vectors[j][0] >= 0.93:
                links[i] += 1
                links[j] += 1
                union(at[i], at[j])
    assert sum(links.values()) > 100
    got = near_duplicates(df, block_rows=block, list_rows=120).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {n: (links[n], every[find(at[n])], every[find(at[n])] == n) for n in every}
    assert len(got) == len(every)


def test_near_duplicates_of_nothing(spark):
    df = _vectors(spark, 20)
    assert near_duplicates(df.limit(0)).count() == 0
    unlabelled = df.where("vec_id is not null").selectExpr("vec_id", "embedding", "cast(null as int) label")
    assert {(r["n_links"], r["kept"]) for r in near_duplicates(unlabelled).collect()} == {(0, True)}


def test_near_duplicates_at_full_reach(spark):
    """Defaults at width 64, where the differences of near vectors lie along a few directions."""
    rng = np.random.default_rng(3)
    scale = 1 / np.arange(1, 65)
    x = (rng.standard_normal((3000, 64)) * scale).astype(np.float32)
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(3)
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93).sum(1) - 1
    assert links.sum() > 1000
    assert {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()} == dict(enumerate(links.tolist()))


def test_search_among_copies(spark):
    """A query in a group of copies gets k rows all the same."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16))
    x[:11] = 10 * x[0]  # of the largest norm, so their strings are the query's
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = search(df, df.where("vec_id < 2")).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in rows} == {0: 20, 1: 20}
