"""The join against all pairs."""

import math
import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from airgrid.llm import hashing
from airgrid.llm.graph import local_roots
from airgrid.llm.line_dedup import gram_hashes
from airgrid.llm.signature_tree import SignatureTree, linked, prefix_keys, shingle_sets, similar_documents, surviving_pairs

from .fixtures import hard_documents, no_documents, prose, texts_of

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def want(texts):
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    find, union = local_roots(len(ids))
    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                union(i, j)
    return {n: (len(sets[k]), ids[find(k)]) for k, n in enumerate(ids)}


@pytest.mark.parametrize("weight", [2_000_000, 300])
def test_hard_documents(spark, weight):
    docs = hard_documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(docs, block_weight=weight).collect()}
    assert got == want(texts_of(docs))


def test_chains_and_thresholds(spark):
    rng, texts, n = random.Random(3), {}, 0
    for group in range(6):
        words = prose(group, 100).split()
        for _ in range(25):  # each a few edits away from the one before
            texts[n] = " ".join(words)
            n += 1
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    rows = [*texts.items(), (None, texts[0]), (3, texts[3])]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_weight=1_500).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want(texts)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_nothing(spark):
    assert similar_documents(no_documents(spark)).count() == 0


def test_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = []
    for _ in range(90):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.choice(pool, rng.integers(1, 200), replace=False)
        sets.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.choice(pool, rng.integers(1, 6))])))
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    tree = SignatureTree(sets)
    found = {(int(i), int(j)) for x, y in surviving_pairs(tree, tree, 80, True) for i, j in zip(x, y, strict=True)}
    assert similar <= found and len(similar) > 20 and len(found) < 90 * 89 // 2
    half = np.arange(90) % 2
    other = SignatureTree([s for s, h in zip(sets, half, strict=True) if h]), SignatureTree([s for s, h in zip(sets, half, strict=True) if not h])
    crossed = {tuple(sorted((2 * int(i) + 1, 2 * int(j)), reverse=True)) for x, y in surviving_pairs(*other, 80, False) for i, j in zip(x, y, strict=True)}
    assert {p for p in similar if (p[0] + p[1]) % 2} <= crossed
    a, b = linked(np.arange(90), sets, half, 80)
    assert all((max(p), min(p)) in similar for p in zip(a.tolist(), b.tolist(), strict=True))


def test_exact_way(spark):
    """Routing by prefixes misses nothing: every link of brute force, also at a similarity of exactly 0.8."""
    docs = hard_documents(spark)
    more = []
    for k in range(40):
        words = prose(2000 + k // 2, 22 + k % 2 * 2).split()
        more.append((300 + k, " ".join(words[: 20 + k % 3])))
    edge = [" ".join(f"e{i}" for i in range(a, b)) for a, b in ((0, 13), (1, 14), (0, 12), (30, 34), (30, 35))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more + [(400 + i, t) for i, t in enumerate(edge)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(table, exact=True).collect()}
    assert got == want(texts_of(table))
    for n in range(1, 60):  # a prefix is no longer than it must be
        assert len(prefix_keys(np.arange(n), 80)) == n - math.ceil(0.8 * n - 1e-9) + 1


def test_all_texts_of_a_doc_id_link(spark):
    """A doc_id with two texts is one node that has the links of both."""
    one, two = prose(1, 120), prose(2, 120)
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(5, one), (5, two), (5, two), (5, None), (6, near(one)), (7, near(two)), (8, prose(3, 120))]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (6, 5), (7, 5), (8, 8)}


def test_words_that_a_rolling_hash_takes_for_equal(spark):
    """Thue-Morse and its complement: a polynomial modulo 2**64 has the same value for both."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    b = "".join("ba"[bin(i).count("1") & 1] for i in range(4096))
    words = [f"w{i}" for i in range(10)]
    rows = [(1, a), (2, b), (3, " ".join([*words, a])), (4, " ".join([*words, b])), (5, a.upper())]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


LONG = """
import resource, sys
import numpy as np, pyarrow as pa
from airgrid.llm import hashing, line_dedup, signature_tree
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "sets":
    text = " ".join(f"w{i % 99991}" for i in range(11_000_000))[: 64 << 20]
    own, = signature_tree.shingle_sets(pa.array([text]))
    assert 99991 <= len(own) <= 99995, len(own)
else:
    raw = np.frombuffer((b"0123456789abcdef" * (4 << 20)), dtype=np.uint8)
    assert len(np.unique(line_dedup.gram_hashes(raw, 8))) == 16
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss) // 1024)
"""


@pytest.mark.parametrize("what", ["sets", "grams"])
def test_memory_of_a_text_of_64_mb(what):
    done = subprocess.run([sys.executable, "-c", LONG, what], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 1024 * (2 if what == "grams" else 1.2), done.stdout


def test_pieces_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("xyzé"[k] * int(n) for k, n in zip(rng.integers(0, 4, 400), rng.integers(1, 30, 400), strict=True)) for _ in range(3)] + ["", None, "a" * 9000, " b "]
    column = pa.array(texts)
    want = [s.tolist() for s in shingle_sets(column)]
    grams = gram_hashes(hashing.buffers(column)[0], 8).tolist()
    monkeypatch.setattr(hashing, "PIECE", 64)
    assert [s.tolist() for s in shingle_sets(column)] == want
    assert gram_hashes(hashing.buffers(column)[0], 8).tolist() == grams
