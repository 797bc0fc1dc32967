"""Small tables with the cases that break things: nulls, empty and long texts, ties, copies, clashing columns."""

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, component long, removed string, _id long, a long, b long, shard int, hash string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(words))


def hard_documents(spark):
    """Documents with every hard case, and columns whose names the operators use inside."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    passage = prose(9, 80)
    lines = "\n".join(prose(50 + i, 12) for i in range(6))
    texts = [
        base, base, near, None, "", " \t\n ", "one two", "one two", "One TWO", "a b c d e", "é ß 日本 ñ " * 30, prose(2, 6000), prose(3, 40) + " " + passage + " " + prose(4, 40),
        prose(5, 30) + " " + passage, lines, lines + "\n" + prose(77, 12), "x" * 5000, "ab" * 400, prose(6, 90), prose(6, 90).upper(), "\n\n\n", prose(7, 300) + "\n" + base,
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None if t is None else len(t), 7, 7, 7, "r", 7, 7, 7, 7, "h") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def no_documents(spark):
    return spark.createDataFrame([], EXTRA)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
