"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from airgrid.llm import spelling

from .fixtures import EXTRA, hard_documents, no_documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(docs, every=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    of = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(of[w]), words[form[w]] if form[w] else None) for w in words}


def check(docs, **options):
    rows = spelling.variants(docs, **options).collect()
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows]
    assert len(set(got)) == len(got)
    assert set(got) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], options.get("every", 97))


def variants_of(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])


def test_edits_at_every_place(spark):
    rng = random.Random(4)
    words = []
    for letters in ("ab", "abcdefgh", "abcèéêñß÷×ÿÀ"):
        for size in (5, 6, 7, 9, 12, 17):
            for _ in range(12):
                word = "".join(rng.choice(letters) for _ in range(size))
                words.append(word)
                for _ in range(4):
                    words.append(variants_of(rng, word, letters))
                words.append(variants_of(rng, words[-1], letters))
    texts = [" ".join(w for w in words for _ in range(rng.choice((1, 2, 3, 3, 4, 8, 20)))) for _ in range(3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check(docs)
    check(docs, every=2)


def test_long_chains(spark):
    words, n = ["abcdefghij"], 3
    for k in range(7):
        words.append(words[-1][:k] + "z" + words[-1][k + 1 :])
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k))
    check(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_hard_cases(spark):
    docs = hard_documents(spark)
    more = ["Straße STRASSE straße Straße strasse strasse", "a" * 3000 + " " + "a" * 3001, "łabędź łabędź łabędź ĀĂĄ Ā", "naïve-naïve/naïve naive naive naive naive naive naive", "x" * 100 + "é"]
    rows = [(i, t, "en", None, 1, 7, 7, 7, "r", 7, 7, 7, 7, "h") for i, t in zip([None, None, 5, 5, 900], more, strict=True)]
    both = docs.unionByName(spark.createDataFrame(rows * 3, EXTRA))
    check(both)
    check(both, every=1)


def test_empty(spark):
    assert spelling.variants(no_documents(spark)).collect() == []


def test_long_text_in_pieces():
    """A text of some megabytes is cut where no letter is, and its counts are those of the whole."""
    text = ("été " + "abcdefg " * 3 + "x" * 300_000 + " ") * 20 + "é" * 1_200_000 + " last words"
    got = Counter()
    for batch in spelling.counted_runs(pa.array(["1"]), pa.array([text]), 5, 0):
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert got == {"abcdefg": 60, "x" * 300_000: 20, "é" * 1_200_000: 1, "words": 1}


def test_crc():
    raw = np.frombuffer(("ab" + "x" * 200 + "é" * 40).encode(), dtype=np.uint8)
    starts, ends = np.array([0, 2, 1, 202, 5, 7]), np.array([2, 202, 66, 282, 5, 71])
    states = np.array([zlib.crc32(f"{k}:".encode()) for k in range(6)], dtype=np.uint32)
    want = [zlib.crc32(f"{k}:".encode() + raw[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.crc32s(raw, starts, ends, states).tolist() == want
