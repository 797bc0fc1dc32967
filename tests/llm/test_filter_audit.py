"""The audit against one run of each order over each document."""

import re
from collections import Counter
from itertools import permutations

from airgrid.llm import filter_audit

from .fixtures import hard_documents, no_documents


def failed(text: str) -> set[str]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def by_hand(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, text, _ in docs:
        first[text or ""] = min(first.get(text or "", rank(i)), rank(i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(part or "", failed(text or "") | ({"E"} if rank(i) > first[text or ""] else set()), i in good, i in toxic) for i, text, part in docs]
    out, lost = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before, left = left, [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in own) - sum(f in r[1] for r in before), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                lost[part, f] += len(gone)
    return {(p, o, s): tuple(v + [lost[p, o[s - 1]]]) for (p, o, s), v in out.items()}


def check(spark, docs, labels, part="lang"):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), part).collect()
    told = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(told) == len(rows)
    want = by_hand([(r["doc_id"], r["text"], r[part]) for r in docs.collect()], [r[:3] for r in labels])
    assert told == want


def test_hard_cases(spark):
    docs = hard_documents(spark)
    extra = spark.createDataFrame(
        [(None, "one two", "en"), (None, None, None), (None, "alone # 5", ""), (None, "alone # 5", "fr"), (6, "one two", "fr"), (6, "one two", "fr"), (0, "ABC " * 300, None), (90, "ABC " * 300, "de"), (91, " ".join(f"w{i}" for i in range(250)), "de")],
        "doc_id long, text string, lang string",
    )
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    labels = [(6, 1, 0, "x"), (6, 0, 1, "x"), (1, 1, None, "x"), (2, None, 1, "x"), (None, 1, 1, "x"), (90, 1, 1, "x"), (777, 1, 1, "x")]
    check(spark, both, labels)
    check(spark, docs, labels, "source")


def test_empty(spark):
    assert filter_audit.audit(no_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    check(spark, hard_documents(spark), [])
