"""HTML pages as small trees of blocks: what the graphical model of :mod:`html_text` looks at.

Nodes are block elements, and the runs of text between their edges as leaves; inline markup is
part of its run.  Tags that a page leaves out are closed as browsers do, and as in browsers an
element deeper than 512 is put beside its parent.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

# The elements of HTML by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("template svg math select noscript object audio video canvas button datalist".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd table caption thead tbody tfoot tr td th nav header footer aside form fieldset legend blockquote pre figure figcaption address details summary dialog center hgroup search hr".split()
)
#: An open element of the first kind ends where one of the second begins, unless one of the third is between.
ENDED_BY = {
    "p": (BLOCKS - frozenset("html body caption thead tbody tfoot tr td th legend".split()), frozenset("table td th caption".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset(["table"])),
}
_ENDS = {b: [a for a, (begins, _) in ENDED_BY.items() if b in begins] for b in BLOCKS}
DEEPEST = 512

#: Words of class, id and role that tell what a block is for.  How much each kind says is learnt.
NAMES = {
    "main": "article articlebody post entry story content main body text prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topnav submenu tabs pagination pager",
    "header": "header masthead banner branding logo topbar",
    "footer": "footer colophon copyright legal bottom",
    "sidebar": "sidebar side aside widget widgets related recommended popular trending rail complementary",
    "notice": "notice notices cookie cookies consent gdpr alert popup modal overlay paywall disclaimer warning",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense",
    "form": "form search login signup signin register subscribe subscription newsletter contact poll",
    "comments": "comment comments commentlist reply replies respond discussion responses disqus reviews",
    "share": "share sharing social follow toolbar tools tags print",
}
KINDS = list(NAMES)
_KINDS_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(NAMES.values()):
    for _w in _words.split():
        _KINDS_OF.setdefault(_w, []).append(_k)

TAGS = "html body main article section div p h li list cell nav header footer aside form quote figure table other".split()
_GROUPS = {t: t for t in TAGS} | {f"h{i}": "h" for i in range(1, 7)}
_GROUPS |= {"ul": "list", "ol": "list", "menu": "nav", "dl": "list", "dt": "li", "dd": "li", "td": "cell", "th": "cell", "tr": "table", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "legend": "form", "search": "form", "dialog": "aside"}
_TAG_OF = {b: TAGS.index(_GROUPS.get(b, "other")) for b in BLOCKS}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^=>])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop|data-main|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Tree:
    """A page: of each node its parent (-1: none), depth, tag group (-1: a run), kinds by name (bits), whether it is hidden, and its label (-1: untold)."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    hidden: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    #: Of each run its node, text, and how many of its letters are in links.
    runs: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, parent: int, tag: int, kinds: int = 0, hidden: int = 0, label: int = -1) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.hidden.append(hidden)
        self.label.append(label if label >= 0 or parent < 0 else self.label[parent])
        return len(self.parent) - 1


def _told(attributes: str) -> tuple[int, int, int]:
    """Kinds (bits), hidden, and the label of a labelled page (attribute data-main) from an element's attributes."""
    kinds, hidden, label = 0, 0, -1
    for name, *values in _NAMED.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "data-main":
            label = int(value == "1")
        elif name in ("hidden", "aria-hidden"):
            hidden |= int(value.lower() != "false")
        else:
            for word in _WORD.findall(value):
                for k in _KINDS_OF.get(word.lower(), ()):
                    kinds |= 1 << k
    return kinds, hidden, label


def parse(page: str) -> Tree:
    """The blocks of a page."""
    tree = Tree()
    root = tree.add(-1, TAGS.index("html"))
    # Open elements: tag, node of a block (else -1), and the block around it.  What is skipped or a link is counted.
    stack: list[tuple[str, int, int]] = []
    block, skipping, links = root, 0, 0
    opened: dict[str, int] = {}
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            tree.runs.append((tree.add(block, -1), text, min(linked, len(text))))
        held.clear()
        linked = 0

    def close(upto: int) -> None:
        """End the open elements from number ``upto`` on."""
        nonlocal block, skipping, links
        for tag, node, around in reversed(stack[upto:]):
            opened[tag] -= 1
            skipping -= tag in SKIPPED
            links -= tag == "a"
            if node >= 0:
                flush()
                block = around
        del stack[upto:]

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not skipping:
            piece = html.unescape(piece) if "&" in piece else piece
            held.append(piece)
            if links:
                linked += len(piece)

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        ends, tag, attributes = token[1], token[2].lower(), token[3]
        if ends:
            if tag in BLOCKS and not opened.get(tag):
                flush()
            elif opened.get(tag):
                upto = len(stack) - 1
                while stack[upto][0] != tag and (tag in BLOCKS or stack[upto][1] < 0 or tag in SKIPPED):
                    upto -= 1
                if stack[upto][0] == tag:
                    close(upto)
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = found.start() if found else len(page)
            continue
        if tag == "br":
            text(" ")
        if tag in BLOCKS:
            for old in _ENDS[tag]:
                if opened.get(old):
                    upto, stops = len(stack) - 1, ENDED_BY[old][1]
                    while stack[upto][0] != old and stack[upto][0] not in stops:
                        upto -= 1
                    if stack[upto][0] == old:
                        close(upto)
            flush()
            if tag not in VOID and not (tag in ("html", "body") and opened.get(tag)):
                kinds, hidden, label = _told(attributes) if attributes else (0, 0, -1)
                over = block if tree.depth[block] < DEEPEST else tree.parent[block]
                stack.append((tag, tree.add(over, _TAG_OF[tag], kinds, hidden, label), block))
                block = stack[-1][1]
                opened[tag] = opened.get(tag, 0) + 1
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, -1, block))
            opened[tag] = opened.get(tag, 0) + 1
            skipping += tag in SKIPPED
            links += tag == "a"
    close(0)
    flush()
    return tree


LONG = 60  # letters of a run that is likely prose
LENGTHS, SHARES = (1, 20, 60, 150, 400, 1200), (0.02, 0.1, 0.3, 0.6)
N_FEATURES = 1 + len(TAGS) + len(KINDS) + 1 + 2 * (len(LENGTHS) + 1) + 2 * (len(SHARES) + 1) + len(SHARES) + 1 + 4


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all nodes of some pages side by side: features, the parent's place and the kind of the edge to it (0: to a run, 1: to a plain block, 2: to a block whose name or tag says something)."""
    first = np.concatenate([[0], np.cumsum([len(t.parent) for t in trees])])
    n = int(first[-1])
    page = np.repeat(np.arange(len(trees)), np.diff(first))
    parent = np.concatenate([np.array(t.parent, dtype=np.int64) for t in trees]) if trees else np.zeros(0, dtype=np.int64)
    parent = np.where(parent >= 0, parent + first[page], -1)
    depth = np.concatenate([np.array(t.depth, dtype=np.int64) for t in trees]) if trees else parent
    tag, kinds, hidden = (np.array([x for t in trees for x in getattr(t, c)], dtype=np.int64) for c in ("tag", "kinds", "hidden"))
    size, link, marks, long_ = (np.zeros(n) for _ in range(4))
    for t, at in zip(trees, first, strict=False):
        for node, text, linked in t.runs:
            size[at + node], link[at + node] = len(text), linked
            marks[at + node] = sum(text.count(c) for c in ".!?,;:")
            long_[at + node] = len(text) if len(text) >= LONG else 0
    own = size.copy()
    for at in reversed(levels(depth)[1:]):  # what a block holds
        for x in (size, link, marks, long_):
            np.add.at(x, parent[at], x[at])
    whole = np.maximum(size[first[:-1]][page], 1) if n else size
    # Whether a node holds no long run and stands before, or after, all that the page has.
    upto = np.cumsum(own * (own >= LONG))
    upto -= (upto - own * (own >= LONG))[first[:-1]][page] if n else 0
    none = long_ == 0
    out = np.zeros((n, N_FEATURES), dtype=np.uint8)
    out[:, 0] = 1
    run = tag < 0
    at = 1
    out[np.flatnonzero(~run), at + tag[~run]] = 1
    at += len(TAGS)
    for k in range(len(KINDS)):
        out[:, at + k] = kinds >> k & 1
    at += len(KINDS)
    out[:, at] = hidden
    at += 1
    rows = np.arange(n)
    out[rows, at + np.where(run, 0, len(LENGTHS) + 1) + np.searchsorted(LENGTHS, size, "right")] = 1
    at += 2 * (len(LENGTHS) + 1)
    out[rows, at + np.where(run, 0, len(SHARES) + 1) + np.searchsorted(SHARES, link / np.maximum(size, 1), "right")] = 1
    at += 2 * (len(SHARES) + 1)
    out[rows, at + np.searchsorted(SHARES, long_ / whole, "right")] = 1
    at += len(SHARES) + 1
    out[:, at] = run & (marks >= 2)
    out[:, at + 1] = run & (marks == 0)
    out[:, at + 2] = none & (upto == 0)
    out[:, at + 3] = none & (upto > 0) & (upto == long_[first[:-1]][page] if n else none)
    says = ~run & ((kinds > 0) | np.isin(tag, [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form", "article", "main")]))
    kind = np.where(run, 0, np.where(says, 2, 1))
    # What plain blocks and runs of one parent say counts as much as one of them, so that many short lines don't outvote it.
    plain = np.flatnonzero((kind < 2) & (parent >= 0))
    siblings = np.bincount(parent[plain], minlength=n)
    share = np.ones(n, dtype=np.float32)
    share[plain] = 1 / siblings[parent[plain]]
    for at in levels(depth)[1:]:
        at = at[kind[at] < 2]
        share[at] *= np.where(kind[parent[at]] < 2, share[parent[at]], 1)
    return out * share[:, None], parent, kind


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth, in page order, so that those of one parent stand together."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if len(depth) else []
