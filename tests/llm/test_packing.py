"""Pieces against the tokenizer itself, sequences against plain best-fit decreasing."""

import bisect
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airgrid.llm.packing import CHANGED, GAP, PIECE, PIECES, PLACED, across, pack, place, sweep
from airgrid.llm.storage import Workspace
from airgrid.llm.tokens import Encoder, default_vocabulary

from .fixtures import hard_documents, no_documents, texts_of


def checked(rows, capacity):
    """Sequences that the rows (sequence, offset, length) fill; each without holes or overlaps."""
    by = {}
    for sequence, offset, n in rows:
        by.setdefault(sequence, []).append((offset, n))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("task_rows", [1_000_000, 60])
def test_rounds(spark, seed, task_rows):
    rng = random.Random(seed)
    capacity = (7, 64, 2048, 2048)[seed % 4]
    lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else rng.choice([1, capacity // 2 + 1, capacity // 3, capacity]) for _ in range(rng.randint(1, 800))]
    if seed > 5:  # short ones only
        lengths = [1 + n % (capacity // 4) for n in lengths]
    docs = [(i % 5, 0, 0, n, i, i) for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(docs, PIECES)
    rows = place(Workspace(spark, "test"), cut, capacity, task_rows).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(d[:5] for d in docs)
    used = checked([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert used <= 1.03 * best_fit_decreasing(lengths, capacity) + 1


@pytest.mark.parametrize("seed", range(20))
def test_sweep_and_across(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(1, 30), rng.choice([PIECE, GAP]), i) for i in range(rng.randint(0, 200)))
    at = sorted(rng.randint(0, len(rows)) for _ in range(rng.randint(0, 5)))
    left, parts = {}, []
    for part, (a, b) in enumerate(zip([0, *at], [*at, len(rows)])):
        sizes, before, keys = ([r[k] for r in rows[a:b]] for k in range(3))
        kinds, now, sequences, offsets = sweep(sizes, before, keys, 30)
        room = {k: n for k, n, kind in zip(keys, sizes, before) if kind == GAP}
        for k in sorted(range(len(kinds)), key=offsets.__getitem__):
            if kinds[k] == PLACED:
                assert before[k] == PIECE and offsets[k] == 30 - room[sequences[k]]
                room[sequences[k]] -= sizes[k]
        for k, kind in enumerate(kinds):
            if kind in (GAP, CHANGED):
                assert now[k] == room[keys[k]] >= 0 and (kind == GAP) == (now[k] == sizes[k])
        gaps, pieces = ([n for n, kind in zip(now, kinds) if kind == want] for want in (GAP, PIECE))
        assert not gaps or not pieces or max(gaps) < min(pieces)
        left[part] = gaps, pieces
        parts.append((part, len(gaps), min(gaps, default=None), len(pieces), max(pieces, default=None)))
    of_pieces, of_gaps = across(parts)
    taking, taken = {}, {}
    for part, a, b, first in of_gaps:
        for r in range(a, b):
            assert first + r - a not in taking
            taking[first + r - a] = (part, r)
    for part, a, b, first, each in of_pieces:
        for r in range(a, b):
            taken.setdefault(first + (r - a) // each, []).append((part, r))
    assert taking.keys() == taken.keys()
    for slot, (part, r) in taking.items():
        assert sum(left[p][1][k] for p, k in taken[slot]) <= left[part][0][r]
    seen = [x for xs in taken.values() for x in xs]
    assert len(set(seen)) == len(seen)
    # What nobody takes has no free gap in a later range.
    for part, (_, pieces) in left.items():
        if any((part, r) not in set(seen) for r in range(len(pieces))):
            assert all((q, r) in set(taking.values()) for q in left if q > part for r in range(len(left[q][0])))


@pytest.mark.parametrize("text", ["", "a  b", "don't 's x's", "İstanbul ΣΑΣ", "<|endoftext|> x<|endoftext|>y", "é ́a é", "\x1c a\x85b \xa0 c", "x" * 300, "1234 5.6!!", "日本語 テキスト", "​ a", "it 's '  s", "a\x01b \x01", "ǅ ŉ ß ĳ"])
def test_ids(text):
    assert np.frombuffer(Encoder.of(default_vocabulary()).raw(text), "<u4").tolist() == Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False).ids


def test_hard_documents(spark):
    docs = hard_documents(spark)
    tokenizer, capacity = Tokenizer.from_file(default_vocabulary()), 64
    rows = pack(docs, capacity).collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for i, t in texts_of(docs).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert got == sorted(want)
    used = checked([(r["sequence_id"], r["offset"], r["length"]) for r in rows], capacity)
    assert used <= -(-sum(w[3] for w in want) // capacity) + 2


def test_ties_and_nothing(spark):
    docs = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.lit("same words here").alias("text"))
    rows = pack(docs).collect()
    assert len(rows) == 500 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    assert pack(no_documents(spark)).count() == 0
    (row,) = pack(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert row["doc_id"] is None and row["length"] == 1 and row["ids_crc32"] == zlib.crc32(bytes(4))
