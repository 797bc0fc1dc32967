"""Removed bytes against a scan of all windows."""

import hashlib

import numpy as np
import pytest

from airgrid.llm import pfp_dedup, storage
from airgrid.llm.pfp_dedup import remove_repeats, suffix_ranks

from .fixtures import hard_documents, no_documents, prose, texts_of
from .test_line_dedup import thue_morse


def want(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), hashlib.sha256(kept).hexdigest(), spans)
    return out


def got(docs, **options):
    rows = remove_repeats(docs, **options).collect()
    assert all(len(r["kept"]) + sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True)) == r["n_bytes"] for r in rows)
    return {r["doc_id"]: (r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), len(r["starts"])) for r in rows}


@pytest.mark.parametrize("hot", [4096, 1])
def test_hard_documents(spark, hot):
    docs = hard_documents(spark)
    assert got(docs, hot=hot) == want(texts_of(docs))


def test_edges_of_100_bytes(spark):
    passage = prose(1, 40)[:160]
    texts = {0: prose(2, 50) + passage + prose(3, 50)}
    for k, n in enumerate([98, 99, 100, 101, 102, 130, 160]):
        texts[k + 1] = prose(10 + k, 30) + "#" + passage[:n] + "#" + prose(30 + k, 30)
        texts[k + 20] = "é" * k + "#" + passage[-n:] + "#" + prose(60 + k, 40)
    texts[50] = passage[:99]
    texts[51] = passage[:100]
    texts[52] = "0123456789" * 60
    texts[53] = "z" * 99
    texts[54] = "z" * 101
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    for hot in (4096, 2):
        assert got(docs, hot=hot) == want(texts)
    assert got(docs, length=20, gram=8) == want(texts, 20)


def test_passage_of_all(spark):
    passage = prose(5, 60)
    texts = {i: prose(i + 100, 20 + i % 7) + " " + passage + " " + prose(i + 500, 25) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for hot in (4096, 10):
        assert got(docs, hot=hot) == want(texts)


def test_repeated_rows_and_nothing(spark):
    text = prose(3, 100)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, len(r["kept"])) for r in remove_repeats(docs).collect()) == [(-1, 0), (-1, 0), (1, len(text)), (1, len(text))]
    assert remove_repeats(no_documents(spark)).count() == 0


def test_null_and_repeated_ids(spark):
    """The windows of one text take nothing of another with the same doc_id, or none."""
    passage = prose(8, 50)
    texts = [prose(400 + i, 20 + i) + chr(65 + i) + passage + chr(85 - i) + prose(430 + i, 25) for i in range(10)]
    docs = spark.createDataFrame([(None if i < 5 else 3, t) for i, t in enumerate(texts)] + [(1, passage)], "doc_id long, text string").repartition(3)
    expected = sorted(want({0: passage} | {1 + i: t for i, t in enumerate(texts)}).values())
    for hot in (4096, 2):
        rows = remove_repeats(docs, hot=hot).collect()
        assert sorted((r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), len(r["starts"])) for r in rows) == expected


@pytest.mark.parametrize("length", [3, 8, 20, 100])
def test_suffix_ranks(length):
    raw = np.frombuffer((prose(4, 60, 9) + "z" * 150 + prose(4, 30, 9)).encode(), dtype=np.uint8)
    rank = suffix_ranks(raw, length)
    words = [raw[i : i + length].tobytes() for i in range(len(raw) - length + 1)]
    assert rank.tolist() == [sorted(set(words)).index(w) for w in words]


def test_strings_of_one_weak_hash(spark, monkeypatch):
    """Strings that polynomial hashes modulo 2**64 can't tell apart, and joins by shuffle behind the count."""
    monkeypatch.setattr(pfp_dedup, "MOST_SENT", -1)
    monkeypatch.setattr(storage, "MOST_CELLS", -1)
    one, two = thue_morse(12)
    texts = {0: one, 1: two, 2: prose(1, 30) + one[:700] + prose(2, 30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for hot in (4096, 1):
        assert got(docs, hot=hot) == want(texts)
