"""Totals after signed, repeated and broken batches."""

import re
from collections import Counter

from tokenizers import Tokenizer

from airgrid.llm.token_rollup import TokenRollup, count_tokens, deletes, inserts, revisions
from airgrid.llm.tokens import default_vocabulary

from .fixtures import hard_documents, no_documents


def _totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def _want(docs):
    tokenizer, docs_of, tokens_of = Tokenizer.from_file(default_vocabulary()), Counter(), Counter()
    for r in docs.collect():
        for name, n in (("word_bpe_49k", len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)), ("words_1", len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))):
            docs_of[(r["source"], r["lang"], name)] += 1
            tokens_of[(r["source"], r["lang"], name)] += n
    return {k: (docs_of[k], tokens_of[k]) for k in docs_of}


def test_batches(spark, tmp_path):
    docs = hard_documents(spark)
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert _totals(rollup) == {}
    old, new = docs.where("doc_id < 12"), docs.where("doc_id >= 12")
    assert rollup.commit("b1", inserts(count_tokens(old))) and not rollup.commit("b1", inserts(count_tokens(docs)))
    assert _totals(rollup) == _want(old)
    assert rollup.commit("b2", inserts(count_tokens(new)))
    assert _totals(rollup) == _want(docs)
    gone = docs.where("doc_id in (0, 11)")
    rollup.commit("b3", deletes(count_tokens(gone)))
    assert _totals(rollup) == _want(docs.where("doc_id not in (0, 11)"))
    before = docs.where("doc_id = 2")
    after = before.selectExpr("doc_id", "'one more text' text", "'fr' lang", "source")
    rollup.commit("b4", revisions(count_tokens(before), count_tokens(after)))
    want = _want(docs.where("doc_id not in (0, 2, 11)").select("doc_id", "text", "lang", "source").unionByName(after))
    assert _totals(rollup) == want
    rollup.commit("b5", inserts(count_tokens(no_documents(spark))))
    rollup.compact()
    assert _totals(rollup) == want and rollup.batches() == ["b1", "b2", "b3", "b4", "b5"]
    assert not rollup.commit("b4", inserts(count_tokens(docs)))
    rollup.commit("b6", inserts(count_tokens(before)))
    rollup.compact()
    rollup.vacuum()
    rollup.commit("b7", deletes(count_tokens(before)))
    assert _totals(rollup) == want and not rollup.commit("b6", inserts(count_tokens(docs)))
    assert sorted(p.name for p in (tmp_path / "rollup").iterdir()) == ["batch=b7", "state=2"]


def test_two_writers_and_broken_compaction(spark, tmp_path, monkeypatch):
    """Whoever comes second finds the batch there; a compaction that breaks off before its rename changes nothing."""
    docs = hard_documents(spark).limit(5)
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert rollup.commit("b1", inserts(count_tokens(docs)))
    want = _totals(rollup)
    monkeypatch.setattr(TokenRollup, "batches", lambda self: [])  # the other writer's look came too early
    assert not rollup.commit("b1", inserts(count_tokens(docs)))
    monkeypatch.undo()
    monkeypatch.setattr(TokenRollup, "_publish", lambda self, staged, final: False)
    rollup.compact()
    monkeypatch.undo()
    assert _totals(rollup) == want and rollup.batches() == ["b1"]
    rollup.compact()
    assert _totals(rollup) == want


def test_interrupted_batch(spark, tmp_path):
    docs = hard_documents(spark).limit(3)
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    (tmp_path / "rollup" / "_staged-b1").mkdir(parents=True)
    (tmp_path / "rollup" / "_staged-b1" / "part-0.parquet").write_bytes(b"cut short")
    assert rollup.commit("b1", inserts(count_tokens(docs))) and _totals(rollup) == _want(docs)
