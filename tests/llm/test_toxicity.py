"""Held-out accuracy, the order of thresholds, and hard cases."""

import hashlib
import random

import numpy as np

from airgrid.llm.queries import op3_toxicity
from airgrid.llm.toxicity import features, fit, keep_clean, likelihood, score, train

from .fixtures import hard_documents, no_documents, prose

BAD = ["blorg", "snarfet", "snarfing", "snarfed", "vexatrix"]


def _corpus(n=900, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(seed * 10_000 + i, rng.randrange(5, 120)).split()
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.choice([2, 3, 8])):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:500]] + [(None, 1, 1), (7_000, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    assert model.thresholds[0] < model.thresholds[1] and len(model.weights) <= 4096
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    right = sum(got[i]["toxic"] == bool(y) for i, _, y in rows[500:])
    assert right >= 0.99 * 400
    assert all(0 <= r["severity"] <= 2 and (r["grade"] > 0) == (r["p_toxic"] > 0.5) or r["grade"] in (0, 1, 2) for r in got.values())
    mild, severe = ([got[i]["severity"] for i, t, y in rows[500:] if y and lo <= sum(w in BAD for w in set(t.split())) < hi] for lo, hi in ((1, 3), (4, 9)))
    assert np.mean(severe) > np.mean(mild)
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}
    assert score(docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1")), model).distinct().count() == 1


def test_stems_generalise(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    p = model.at_least(model.margins(iter(["w1 w2 snarfology snarfish", "w1 w2 w3", None, ""])))
    assert p[0, 0] > p[1, 0] and p[1, 0] < 0.5 and p[2, 0] == p[3, 0] < 0.5


def test_likelihood():
    """The plain formula, and its gradients by differences."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(9) < 0.4) for _ in range(40)]
    grade, weigh = rng.integers(0, 3, 40), rng.uniform(0.5, 2, 40)
    w, b = rng.standard_normal(9), np.array([0.3, 1.1])

    def plain(w, b):
        total = 0.0
        for r, g, c in zip(rows, grade, weigh, strict=True):
            above = [1.0, *[1 / (1 + np.exp(t - w[r].sum())) for t in b], 0.0]
            total += c * np.log(above[g] - above[g + 1])
        return total

    value, by_w, by_b = likelihood(w, b, rows, grade, weigh)
    assert abs(value - plain(w, b)) < 1e-9
    for k in range(9):
        e = np.eye(9)[k] * 1e-6
        assert abs((plain(w + e, b) - plain(w - e, b)) / 2e-6 - by_w[k]) < 1e-5
    for k in range(2):
        e = np.eye(2)[k] * 1e-6
        assert abs((plain(w, b + e) - plain(w, b - e)) / 2e-6 - by_b[k]) < 1e-5


def test_query_against_plain_fit(spark, tmp_path):
    """The registered query against features, counts, grades and severities worked out in plain Python."""
    rows = _corpus(400, 3)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for _, t, y in rows:
        seen[(y, frozenset(t.split()))] = {f for w in set(t.split()) for f in features(w)}
    n = [sum(k[0] == c for k in seen) for c in (0, 1)]
    counts = {}
    for (y, _), held in seen.items():
        for f in held:
            counts.setdefault(f, [0, 0])[y] += 1

    def gain(k):
        rate = sum(k) / sum(n)
        parts = [(p, e) for s, m in zip(k, n, strict=True) for p, e in ((s, m * rate), (m - s, m * (1 - rate)))]
        return 2 * sum(p * np.log(p / e) for p, e in parts if p)

    names = sorted((f for f, k in counts.items() if sum(k) >= 3 and gain(k) >= 24), key=lambda f: (-gain(counts[f]), f))
    odds = np.array([np.log((counts[f][1] + 0.5) / (n[1] + 1)) - np.log((counts[f][0] + 0.5) / (n[0] + 1)) for f in names])
    order = sorted(seen, key=lambda k: (k[0], hashlib.blake2b("\n".join(sorted(k[1])).encode(), digest_size=16).digest()))
    model = fit(names, odds, [np.array([i for i, f in enumerate(names) if f in seen[k]], dtype=np.int64) for k in order], np.array([k[0] for k in order]))
    texts = {i: t for i, t, _ in rows}
    for r in op3_toxicity(spark, str(tmp_path)).collect():
        x = sum(model.weights.get(f, 0.0) for f in {f for w in set(texts[r["doc_id"]].split()) for f in features(w)})
        p = [1 / (1 + np.exp(b - x)) for b in model.thresholds]
        assert abs(r["severity"] - sum(p)) < 1e-6 and abs(r["p_toxic"] - p[0]) < 1e-6
        assert r["grade"] == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))


def test_conflicting_labels_and_long_texts(spark):
    """A document with both labels is toxic; a text of 2 MB sends a bounded row to the driver."""
    rows = [(i, prose(i, 20) + (" blorg vexatrix" if i % 2 else "")) for i in range(60)]
    rows.append((61, " ".join(f"q{k}" for k in range(300_000)) + " " + "z" * 100_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    both = [(i, 0) for i, _ in rows] + [(i, 1) for i in range(60) if i % 2]
    models = [train(docs, spark.createDataFrame(told, "doc_id long, toxic int")) for told in (both, both[::-1])]
    assert models[0] == models[1] and len(models[0].weights) < 100
    assert {r["doc_id"] for r in score(docs, models[0]).collect() if r["toxic"]} == {i for i in range(60) if i % 2}


def test_hard_cases(spark):
    docs = hard_documents(spark)
    none = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {(r["severity"] < 1e-9, r["toxic"]) for r in score(docs, none).collect()} == {(True, False)}
    assert keep_clean(docs, none).count() == docs.count()
    some = train(docs, spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int"))
    assert score(docs, some).count() == docs.count() and score(no_documents(spark), some).count() == 0
