"""Kept lines against all pairs."""

import hashlib
import time
import uuid

import numpy as np
import pytest

from airgrid.llm import hashing, line_dedup, signature_tree, storage
from airgrid.llm.graph import contract, local_roots
from airgrid.llm.line_dedup import dedup_lines
from airgrid.llm.queries import op9_line_dedup

from .fixtures import hard_documents, no_documents, prose, texts_of


def want(texts, least=1, size=8):
    occurrences = {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            if len(line.encode()) >= least:
                occurrences.setdefault(line.encode(), []).append((i, k))
    lines = list(occurrences)
    sets = [frozenset(x[q : q + size] for q in range(max(1, len(x) - size + 1))) for x in lines]
    find, union = local_roots(len(lines))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                union(i, j)
    classes = {}
    for i, x in enumerate(lines):
        classes.setdefault(find(i), []).extend(occurrences[x])
    gone = {place for places in classes.values() for place in places if place != min(places)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}


@pytest.mark.parametrize("weight", [2_000_000, 400])
def test_hard_documents(spark, weight):
    docs = hard_documents(spark)
    out = dedup_lines(docs, block_weight=weight)
    assert sorted(out.columns) == sorted([*docs.columns, "n_lines", "n_removed"])
    assert texts_of(out) == want(texts_of(docs))


def test_one_line_everywhere(spark):
    common = "this very line is found in each of the documents, which is long enough that the change of a letter leaves it alike"
    texts = {i: "\n".join([prose(i, 15), common if i % 2 else common.replace("very", "vary"), "short", prose(i + 500, 9)]) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert {i: r["text"] for i, r in rows.items()} == want(texts)
    assert sum(common in r["text"] or common.replace("very", "vary") in r["text"] for r in rows.values()) == 1
    assert all(r["n_lines"] == 4 for r in rows.values()) and sum("short" in r["text"] for r in rows.values()) == 1
    longer = {r["doc_id"]: r["text"] for r in dedup_lines(docs, least=24).collect()}
    assert longer == want(texts, least=24) and all("short" in t for t in longer.values())


def test_nothing(spark):
    assert dedup_lines(no_documents(spark)).count() == 0


def test_short_lines(spark, tmp_path):
    docs = hard_documents(spark)
    texts = texts_of(docs)
    short = ["x", "Les.", "1234567", "12345678", "All rights reserved.", "All rights reserved!", "", "é"]
    texts |= {100 + i: "\n".join([short[i % 8], prose(900 + i, 9), short[(i * 3 + 1) % 8], short[i % 5]]) for i in range(40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = want(texts)
    assert texts_of(dedup_lines(table)) == kept
    rows = op9_line_dedup(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in rows} == {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}


def test_null_and_repeated_ids(spark):
    """Each distinct text of one doc_id, or of none, is a document of its own."""
    shared = prose(41, 12)
    texts = ["\n".join([*[prose(600 + 9 * i + k, 12) for k in range(i % 4 + 1)], shared, *[prose(800 + 9 * i + k, 12) for k in range(4)]]) for i in range(12)]
    rows = [(None if i < 6 else 3, t) for i, t in enumerate(texts)] + [(1, shared), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in dedup_lines(docs).collect())
    assert got == sorted((i or 0, t if i == 1 else t.replace(f"\n{shared}\n", "\n")) for i, t in rows)


def test_tables_too_large_to_send(spark, monkeypatch):
    """The joins by shuffle that stand behind the count."""
    monkeypatch.setattr(storage, "MOST_CELLS", -1)
    docs = hard_documents(spark)
    assert texts_of(dedup_lines(docs)) == want(texts_of(docs))


def thue_morse(k):
    """Two strings of 2**k bytes that polynomial hashes modulo 2**64 can't tell apart from k = 11 on."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_lines_of_one_weak_hash(spark):
    """Lines that only differ where a weak hash is blind are no copies, unless their shingles are alike."""
    one, two = thue_morse(12)
    raw = np.frombuffer((one + two).encode(), dtype=np.uint8)
    low, high = hashing.strong_hashes(raw, np.array([0, 4096]), np.array([4096, 8192]))
    assert low[0] != low[1] and high[0] != high[1]
    docs = spark.createDataFrame([(0, one + prose(1, 4)), (1, one + prose(1, 4))], "doc_id long, text string")
    assert [r["n_removed"] for r in dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1]


@pytest.mark.parametrize("sides", [1, 2])
def test_links_of_a_chained_group(sides):
    """Look-alikes and near copies in one group: the links of all pairs, without comparing all of them."""
    import random

    import pyarrow as pa

    from airgrid.llm.line_dedup import gram_sets, linked_by_prefix

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    head = " ".join(words[:8])
    texts = [head + " " + " ".join(rng.choice(words) for _ in range(8)) for _ in range(150)]
    texts += [t[:k] + "#" + t[k + 1 :] for t in texts[:90] for k in (5, rng.randrange(len(t) - 1))] + ["short", "8 bytes.", "8 bytes.."]
    sets = gram_sets(pa.chunked_array([texts]), 8)
    block = np.arange(len(texts)) % sides
    find, union = local_roots(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (sides == 1 or block[i] != block[j]) and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                union(i, j)
    a, b = linked_by_prefix(np.arange(len(texts)), sets, block, 80)
    found, join = local_roots(len(texts))
    assert all(join(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)), "a forest"
    assert [found(i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    many = gram_sets(pa.chunked_array([[head[:30] + " " + " ".join(rng.choice(words) + str(k) for _ in range(8)) for k in range(6000)]]), 8)
    at = time.process_time()
    linked_by_prefix(np.arange(len(many)), many, np.zeros(len(many), dtype=int), 80)
    assert time.process_time() - at < 3, "all pairs took 6 seconds"


def test_small_groups_go_to_python_many_at_a_time(spark, tmp_path):
    """Pairs of near copies, a group of many, one cut into blocks and one node with two texts: the same classes as group by group, in few calls."""
    text = "concat(repeat(concat(g, ' some words '), 6), if(g % 3 = 0, repeat(concat('x', k), 20), 'x'), k)"
    rows = spark.range(3000).selectExpr("id div 2 g", "id k", "id node").union(spark.range(40).selectExpr("9001L g", "id k", "10000 + id node")).union(spark.range(600).selectExpr("9002L g", "id k", "20000 + id node"))
    members = rows.selectExpr("node", "g grp", f"{text} text").union(spark.createDataFrame([(0, 0, "other words of the first")], "node long, grp long, text string")).selectExpr("*", "cast(octet_length(text) as bigint) weight")

    def links(name, **kind):
        told = tmp_path / name
        told.mkdir()

        def sets(texts):
            (told / uuid.uuid4().hex).touch()
            return line_dedup.gram_sets(texts, 8)

        got = signature_tree.exact_links(members, sets, 80, 20_000, line_dedup.linked_by_prefix, **kind).toPandas()
        assert len(got)
        a, b = contract(got["a"].to_numpy(), got["b"].to_numpy())
        return sorted(zip(a.tolist(), b.tolist(), strict=True)), len(list(told.iterdir()))

    one, calls = links("one")
    many, fewer = links("many", gather=True)
    assert many == one and calls > 1500 and fewer < 60


def test_min_hashes_stay_near(monkeypatch):
    """Rows are hashed some at a time, with the minima of all at once."""
    from airgrid.llm import hashing

    rng = np.random.default_rng(5)
    offsets = np.concatenate([[0], np.cumsum(np.append(rng.integers(1, 60, 200), [500, 1, 99, 1]))])
    values = rng.integers(0, 1 << 63, offsets[-1]).astype(np.uint64)
    factors, shifts = hashing.hash_family(8, 3)
    x = (values >> np.uint64(32)).astype(np.uint32)
    want = [np.minimum.reduceat(x * f ^ s, offsets[:-1]) for f, s in zip(factors, shifts, strict=True)]
    for near in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(hashing, "NEAR", near)
        assert (hashing.min_hashes(values, offsets, factors, shifts) == want).all()
    assert hashing.min_hashes(values[:0], offsets[:1], factors, shifts).shape == (8, 0)
