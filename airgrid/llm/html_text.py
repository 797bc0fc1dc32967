"""Main text of HTML pages by a tree-structured graphical model.

A page is a tree of blocks and runs of text (:mod:`dom`).  Each node is main text or not.  A node's potential
comes from its tag, the names in its class, id and role, and what it holds; the potential of an edge joins
the states of parent and child.  Sum-product messages go upward from the runs and downward
from the root, for all pages of a batch level by level, and give the exact marginal of each
node.  A run is kept where being main text is likelier than not.

Potentials are trained by maximum likelihood (observed less expected counts, the latter by the same
messages) on labelled pages: those of the corpus whose markup names its article, and pages
composed anew of their texts with other markup, so that names, shapes and places of blocks are learnt as
well as tags.  At most ``most_pages`` pages of at most ``most_chars`` characters are used for that.

Defined results: null html is an empty page, and its text and that of a page without main text is empty; a null
or repeated page_id does no harm, each row is a page; without labelled pages in the corpus
the model is trained on composed pages of fixed words only; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .storage import fresh, small_batches

EDGES = 3
CHUNK = 4 << 20  # characters of the pages that are settled together


@dataclass
class Model:
    """node: weight of each feature for main text; edge: of each kind the potential of (parent's state, child's state)."""

    node: np.ndarray
    edge: np.ndarray


def marginals(model: Model, x: np.ndarray, parent: np.ndarray, kind: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the chance to be main text, and of each edge the joint chances of (parent, child), by sum-product."""
    below = np.zeros((2, len(x)))
    below[1] = x @ model.node
    up, pair = np.zeros((2, len(x))), np.zeros((2, 2, len(x)))
    edge = model.edge.transpose(1, 2, 0)[:, :, kind]  # parent's state, child's state, node
    for at in reversed(levels[1:]):
        owner = parent[at]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for s in (0, 1):
            up[s, at] = np.logaddexp(edge[s, 0, at] + below[0, at], edge[s, 1, at] + below[1, at])
            below[s, owner[first]] += np.add.reduceat(up[s, at], first)
    whole = below.copy()
    for at in levels[1:]:
        joint = (whole[:, parent[at]] - up[:, at])[:, None] + edge[:, :, at] + below[None, :, at]
        whole[:, at] = np.logaddexp(joint[0], joint[1])
        pair[:, :, at] = np.exp(joint - np.logaddexp(whole[0, at], whole[1, at]))
    return 1 / (1 + np.exp(np.clip(whole[0] - whole[1], -500, 500))), pair


def fit(x: np.ndarray, parent: np.ndarray, kind: np.ndarray, depth: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.3, penalty: float = 1e-5) -> Model:
    """The potentials under which the labels of all nodes are likeliest, by gradient steps of adapted length."""
    # To begin with, a node has its parent's state, and a run more so than a block that says what it is.
    model = Model(np.zeros(x.shape[1]), np.array([6.0, 3.0, 1.0])[:, None, None] * np.array([[1.0, -1.0], [-1.0, 1.0]]))
    x, levels = x.astype(np.float64), dom.levels(depth)
    child = np.flatnonzero(parent >= 0)
    of_kind = [child[kind[child] == k] for k in range(EDGES)]
    seen_pairs = np.zeros((EDGES, 2, 2))
    np.add.at(seen_pairs, (kind[child], label[parent[child]], label[child]), 1)
    seen = x.T @ label
    first, second = np.zeros(x.shape[1] + 4 * EDGES), np.zeros(x.shape[1] + 4 * EDGES)
    for step in range(1, rounds + 1):
        p, pair = marginals(model, x, parent, kind, levels)
        expected = np.stack([pair[:, :, at].sum(2) for at in of_kind])
        slope = np.concatenate([seen - x.T @ p, (seen_pairs - expected).ravel()]) / len(x)
        slope -= penalty * np.concatenate([model.node, model.edge.ravel()])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = rate * min(1, 2 - 2 * step / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        model.node += move[: x.shape[1]]
        model.edge += move[x.shape[1] :].reshape(EDGES, 2, 2)
    return model


# Labelled pages.

_TAGS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section p", "advert": "div aside", "form": "form div", "comments": "section div ol", "share": "div ul"}
_FIXED = "the of a to in on for with is was it that this from over under after before river house table paper window garden letter market winter summer morning evening".split()


def _prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(_FIXED) for _ in range(words)).capitalize() + "."


def compose(rng: random.Random, prose: list[str], other: list[str]) -> str:
    """A labelled page (data-main 1 or 0) of given texts: an article in the markup of some site, and all else that sites put around and into it."""
    pick = lambda texts: rng.choice(texts) if texts and rng.random() < 0.8 else _prose(rng, rng.choice((1, 3, 8, 20, 50)))
    safe = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    inline = lambda t: re.sub(r"\S+", lambda m: f"<{w}>{m[0]}</{w}>" if rng.random() < 0.04 and (w := rng.choice(("a", "b", "em", "span"))) else m[0], safe(t))

    def named(kind: str, always: bool) -> str:
        if not always and rng.random() < 0.4:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(dom.NAMES[kind].split())}{rng.choice(("", "", " box", " inner", "-wide"))}"'

    def part(kind: str) -> str:
        tag = rng.choice(_TAGS[kind].split())
        item = "li" if tag in ("ul", "ol") else rng.choice(("p", "div", "span"))
        link = kind in ("menu", "share") or kind in ("sidebar", "footer") and rng.random() < 0.5
        texts = [pick(prose if kind == "comments" or rng.random() < 0.2 else other) for _ in range(rng.choice((1, 2, 4, 8)))]
        inner = "".join(f"<{item}>{'<a href=/>' + safe(t[:40]) + '</a>' if link else safe(t)}</{item}>" for t in texts)
        if rng.random() < 0.4:
            inner = f"<h{rng.choice('234')}>{safe(pick(other)[:40])}</h3>" + inner
        plain = tag in ("div", "p", "ul", "ol", "section")
        return f'<{tag}{named(kind, plain)} data-main="0">{inner}</{tag}>'

    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    body = [f"<h1>{inline(pick(prose)[:80])}</h1>"] if rng.random() < 0.8 else []
    for text in prose or [_prose(rng, rng.choice((2, 15, 60))) for _ in range(rng.randrange(1, 9))]:
        kind = rng.random()
        body.append(f"<p>{inline(text)}</p>" if kind < 0.8 else f"<ul><li>{inline(text)}</li></ul>" if kind < 0.85 else f"<blockquote><p>{inline(text)}</p></blockquote>" if kind < 0.9 else f"<h2>{inline(text[:60])}</h2>" if kind < 0.95 else f"<div>{inline(text)}</div>")
        if rng.random() < 0.08:
            body.append(part(rng.choice(("advert", "share", "form", "sidebar", "notice"))))
    if rng.random() < 0.3:
        body.append(part("comments"))
    article = f'<{tag}{named("main", tag in ("div", "section") and rng.random() < 0.8)} data-main="1">{"".join(body)}</{tag}>'
    before = [part(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
    after = [part(k) for k in ("share", "comments", "sidebar", "advert", "form", "footer", "notice") if rng.random() < 0.5]
    page = "".join([*before, article, *after])
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = f"<div{rng.choice(('', ' class=wrapper', ' id=page', ' class=container'))}>{page}</div>"
    return f'<html><body data-main="0">{page}</body></html>'


def labelled(page: str, seed: int, composed: int) -> list[dom.Tree]:
    """The trees of a page whose markup names its article, of the same with a few words of it only or without marks, and of pages composed of its texts."""
    tree = dom.parse(re.sub(r"<(/?)(article|main|nav|header|footer|aside|form)\b(?=[\s>])", lambda m: m[0] if m[1] else f'<{m[2]} data-main="{int(m[2].lower() in ("article", "main"))}"', page, flags=re.I))
    prose = [text for node, text, _ in tree.runs if tree.label[node] == 1]
    other = [text for node, text, _ in tree.runs if tree.label[node] != 1]
    rng = random.Random(seed)
    brief = []
    for _ in range(2):
        few = [(node, " ".join(text.split()[: rng.randrange(1, 4)]), 0) for node, text, _ in tree.runs if tree.label[node] == 1][: rng.randrange(1, 4)]
        brief.append(replace(tree, runs=[r for r in tree.runs if tree.label[r[0]] != 1] + few))
    unmarked = replace(tree, runs=[(node, re.sub(r"[.!?,;:]", "", text), linked) for node, text, linked in tree.runs])
    made = [compose(rng, rng.sample(prose, min(len(prose), rng.randrange(1, 12))), other) for _ in range(composed)]
    return [tree, unmarked, *brief, *map(dom.parse, made)] if prose else []


def _arrays(trees: list[dom.Tree]) -> tuple[np.ndarray, ...]:
    x, parent, kind = dom.features(trees)
    return x, parent, kind, np.array([d for t in trees for d in t.depth], dtype=np.int64), np.array([v == 1 for t in trees for v in t.label], dtype=np.int64)


def train(pages: DataFrame, most_pages: int = 100, most_chars: int = 100_000, composed: int = 3, seed: int = 12) -> Model:
    """A model from the pages of ``pages`` (html) that name their article, at most ``most_pages`` of at most ``most_chars`` characters, the first by a hash of the page."""
    named = pages.where((F.length("html") <= most_chars) & F.col("html").rlike(r"(?i)<(article|main)[\s>]")).select("html", F.xxhash64("html").alias("code"))
    chosen = named.select("code").distinct().orderBy("code").limit(most_pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # equal pages are read once a task
        for batch in batches:
            new = [k for k, code in enumerate(batch.column(1).to_pylist()) if not (code in done or done.add(code))]
            made = [pickle.dumps(_arrays(trees)) if (trees := labelled(batch.column(0)[k].as_py(), seed + k, composed)) else None for k in new]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(new, pa.int64())), pa.array(made, pa.binary())], names=["code", "arrays"])

    rows = named.join(F.broadcast(chosen), "code", "left_semi").select("html", "code").mapInArrow(read, "code long, arrays binary")
    told = rows.where("arrays is not null").groupBy("code").agg(F.min("arrays").alias("arrays")).orderBy("code").collect()
    parts = [pickle.loads(r["arrays"]) for r in told]
    rng = random.Random(seed)
    parts.append(_arrays([dom.parse(compose(rng, [], [])) for _ in range(50)]))
    first = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    parent = np.concatenate([np.where(p[1] >= 0, p[1] + at, -1) for p, at in zip(parts, first, strict=False)])
    x, kind, depth, label = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4))
    return fit(x, parent, kind, depth, label)


def main_texts(model: Model, pages: list[str]) -> list[str]:
    """The main text of each page."""
    trees = [dom.parse(p) for p in pages]
    x, parent, kind = dom.features(trees)
    chance, _ = marginals(model, x, parent, kind, dom.levels(np.array([d for t in trees for d in t.depth], dtype=np.int64)))
    first = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])]).tolist()
    return ["\n".join(text for node, text, _ in t.runs if chance[at + node] >= 0.5) for t, at in zip(trees, first, strict=False)]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text``: the blocks of main text of each page (page_id, url, html), one a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            texts, waiting, size = [], [], 0
            for html in batch.column(2):
                waiting.append(html.as_py() or "")
                size += len(waiting[-1])
                if size >= CHUNK:
                    texts += main_texts(model, waiting)
                    waiting, size = [], 0
            texts += main_texts(model, waiting) if waiting else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string")
