"""HTML extraction: boosted trees over DOM-node features, decoded so that ancestors and descendants agree.

A tolerant parser builds the tree of block elements (inline elements only add to their block). Each node gets features:
text and link density of its subtree, tag and attribute tokens of its own and of its ancestors, depth, position, and
the same densities of its siblings and parent. Trees trained on generated pages with known labels give each node the
probabilities of being boilerplate, content, or a wrapper that mixes both. Decoding picks the likeliest labelling of
the whole tree in which a wrapper may hold anything, content only content and boilerplate, boilerplate only boilerplate.

Text directly inside content nodes is kept: character references decoded, white space (br included) made one space,
blocks joined by a line feed in page order. Text beside blocks, in a wrapper or any other element, is a node of its own and
labelled like the others. Nothing is cut off.

Defined cases: null and empty pages give the empty text; the text of a page without block elements is its content; unclosed, misnested and truncated
tags are read as far as they go, in time that grows with the page's length alone; pages of any length are read whole; of
equally likely labels boilerplate comes before content and content before wrapper; repeated rows are extracted one by one;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.boosting import BoostedTrees
from graphloom.llm.common import batch, map_arrow, texts_of
from graphloom.llm.html_pages import BOILER, CONTENT, MIXED, pages

#: Generated pages to train on.
TRAIN_PAGES = 1000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_LABEL = re.compile(r'data-label="?(\d)')
_ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: Elements whose content is not text, elements without content, inline elements.
RAW = frozenset("script style noscript template iframe svg canvas audio video textarea select option button title head datalist annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var object map math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mspace mstyle mpadded mfenced semantics".split())
CELLS = frozenset(("td", "th"))
#: What an opening tag closes when it is open above it, up to the named borders.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Feature groups of tags and of attribute tokens.
TAGS = tuple(frozenset(g.split()) for g in ("article main", "nav menu", "header", "footer", "aside", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tr td th tbody thead", "form fieldset", "blockquote pre figure figcaption details summary", "body html", "#text"))
NAMES = tuple(frozenset(g.split()) for g in (
    "content article post entry story main text", "nav menu navbar breadcrumb breadcrumbs topbar pagination tags", "ad ads advert adverts advertisement adbox sponsored sponsor promo banner adslot", "sidebar side widget rail related aside trending recommended",
    "cookie cookies consent notice gdpr popup alert newsletter subscribe modal overlay privacy", "comments comment discussion respond replies reply disqus", "header masthead top branding", "footer bottom copyright legal", "share social sharing follow", "search login signup form"))


class Node:
    __slots__ = ("after", "attrs", "label", "parent", "parts", "tag")

    def __init__(self, tag: str, parent: int, attrs: str):
        self.tag, self.parent, self.attrs, self.label = tag, parent, attrs, -1
        self.parts: list[tuple[int, str, bool]] = []


def parse(source: str, labelled: bool = False) -> list[Node]:
    """Block elements and, inside elements that hold other blocks, runs of text of their own, as #text nodes; the root first,
    parents before children. Nodes have their direct text as (place, text, inside a link). Time grows with the length alone.
    """
    nodes = [Node("#root", -1, "")]
    stack, at, place, link = [0], 0, 0, False
    end = len(source)
    open_at: dict[str, list[int]] = {}
    parents: set[int] = set()
    run: dict[int, int] = {}
    unclosed: set[str] = set()
    mark = -1

    def add(text: str) -> None:
        """Text of the innermost open element, or of the run of text that stands between its blocks."""
        nonlocal mark
        if not text:
            return
        own = stack[-1]
        if own in parents:
            if own not in run:
                if not text.strip():
                    return
                nodes.append(Node("#text", own, ""))
                nodes[-1].label = mark
                run[own] = len(nodes) - 1
            own = run[own]
        elif mark >= 0 and nodes[own].after < 0 and text.strip():
            nodes[own].after = mark
        nodes[own].parts.append((place, text, link))

    def pop_to(depth: int) -> None:
        nonlocal place, link
        for i in stack[depth:]:
            open_at[nodes[i].tag].pop()
            run.pop(i, None)
        del stack[depth:]
        run.pop(stack[-1], None)
        place += 1
        link = False

    nodes[0].after = -1
    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                link = False
            elif tag == "data":
                mark = -1
            elif tag not in INLINE and open_at.get(tag):
                pop_to(open_at[tag][-1])
            continue
        tag = (m[2] or m[4] or "").lower()
        if not tag:
            continue
        attrs = m[3] or m[5] or ""
        if tag in RAW:
            if not attrs.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if close:
                    at = close.end()
                elif tag not in ("head", "select", "option", "button"):
                    at = end
                else:
                    unclosed.add(tag)
            if tag not in ("head", "option"):
                add(" ")
            continue
        if tag == "a":
            link = True
            continue
        if tag in INLINE:
            if labelled and tag == "data" and (found := _LABEL.search(attrs)):
                mark = int(found[1])
            continue
        if tag in VOID:
            if tag == "hr":
                place += 1
                run.pop(stack[-1], None)
            elif tag == "br":
                add(" ")
            continue
        if nodes[stack[-1]].tag == "p":
            pop_to(len(stack) - 1)
        if tag in CLOSES:
            closed, borders = CLOSES[tag]
            deepest = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)
            k = deepest(closed.split())
            if k > deepest(borders):
                pop_to(k)
        own = stack[-1]
        if own not in parents:
            parents.add(own)
            x = nodes[own]
            if any(t.strip() for _, t, _ in x.parts):
                first = Node("#text", own, "")
                first.parts, x.parts, first.label = x.parts, [], x.after
                nodes.append(first)
            else:
                x.parts = []
        run.pop(own, None)
        node = Node(tag, own, " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)))
        node.after = -1
        if labelled:
            found = _LABEL.search(attrs)
            node.label = int(found[1]) if found else -1
        nodes.append(node)
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(len(nodes) - 1)
        link = False
        if tag in CELLS:
            add(" ")
        else:
            place += 1
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """One row of features for each node."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    own = np.zeros((n, 6))
    start = np.zeros(n)
    total = 0
    for i, x in enumerate(nodes):
        start[i] = total
        for _, text, link in x.parts:
            t = text.strip()
            if t:
                own[i, 0] += len(t)
                own[i, 1] += t.count(" ") + 1
                own[i, 2] += len(t) if link else 0
                own[i, 3] += t.count(".") + t.count(",") + t.count("!") + t.count("?")
                own[i, 4] += link
        total += own[i, 0]
    own[:, 5] = 1
    kinds = np.zeros((n, len(TAGS)))
    names = np.zeros((n, len(NAMES)))
    above_k, above_n = np.zeros((n, len(TAGS))), np.zeros((n, len(NAMES)))
    depth, index, many = np.zeros(n), np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    before, behind = np.full(n, -1), np.full(n, -1)
    for i, x in enumerate(nodes):
        kinds[i] = [x.tag in g for g in TAGS]
        if x.attrs:
            tokens = set(_SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", x.attrs).lower()))
            names[i] = [not tokens.isdisjoint(g) for g in NAMES]
        p = x.parent
        if p >= 0:
            depth[i] = depth[p] + 1
            index[i] = many[p]
            many[p] += 1
            above_k[i] = np.maximum(above_k[p], kinds[p])
            above_n[i] = np.maximum(above_n[p], names[p])
            if p in last:
                before[i] = last[p]
                behind[last[p]] = i
            last[p] = i
    sub = own.copy()
    paragraphs, items = kinds[:, 7] * (own[:, 0] > 0), kinds[:, 10].copy()
    for i in range(n - 1, 0, -1):
        sub[parent[i]] += sub[i]
        paragraphs[parent[i]] += paragraphs[i]
        items[parent[i]] += items[i]
    chars, words, linked, marks, links, tags = sub.T
    c1, w1 = np.maximum(chars, 1), np.maximum(words, 1)
    density = np.stack([np.log1p(chars), np.log1p(words), chars / w1, linked / c1, marks / w1, chars / tags, chars / max(total, 1), links / tags, np.log1p(paragraphs), items / tags], 1)
    other = lambda at, cols: np.where((at >= 0)[:, None], density[np.maximum(at, 0)][:, cols], -1.0)
    siblings = np.where(parent >= 0, many[np.maximum(parent, 0)], 1)
    place = np.stack([depth, index, siblings, index / np.maximum(siblings, 1), start / max(total, 1), (start + chars) / max(total, 1), np.log1p(own[:, 0]), own[:, 0] / c1], 1)
    return np.concatenate([kinds, names, above_k, above_n, density, other(before, [0, 3, 4]), other(behind, [0, 3, 4]), other(parent, [0, 3, 6, 8]), place], 1)


def decode(nodes: list[Node], logs: np.ndarray) -> np.ndarray:
    """The likeliest consistent label of every node; text beside the blocks of a content element is content."""
    n = len(nodes)
    best = logs.copy()
    for i in range(n - 1, 0, -1):
        b, c, m = best[i]
        up = best[nodes[i].parent]
        text = nodes[i].tag == "#text"
        up[BOILER] += b
        up[CONTENT] += c if text else max(b, c)
        up[MIXED] += max(b, c) if text else max(b, c, m)
    label = np.zeros(n, np.int64)
    label[0] = MIXED if n > 1 else CONTENT  # text beside the root's blocks is in nodes of its own
    for i in range(1, n):
        above = label[nodes[i].parent]
        if nodes[i].tag == "#text":
            allowed = (above,) if above != MIXED else (BOILER, CONTENT)
        else:
            allowed = (BOILER,) if above == BOILER else (BOILER, CONTENT) if above == CONTENT else (BOILER, CONTENT, MIXED)
        label[i] = max(allowed, key=lambda s: best[i, s])
    return label


def block_text(nodes: list[Node], label: np.ndarray) -> str:
    """Texts of content nodes, a line for each block."""
    blocks: dict[int, list[str]] = {}
    for x, s in zip(nodes, label, strict=True):
        if s == CONTENT:
            for place, text, _ in x.parts:
                blocks.setdefault(place, []).append(text)
    lines = (" ".join(html.unescape("".join(blocks[k])).split()) for k in sorted(blocks))
    return "\n".join(x for x in lines if x)


@lru_cache(maxsize=2)
def train(count: int = TRAIN_PAGES, seed: int = 11) -> BoostedTrees:
    """Trees fitted on generated pages; the same arguments give the same trees."""
    rows, labels = [], []
    for source in pages(count, seed):
        nodes = parse(source, labelled=True)
        x, y = features(nodes), np.array([v.label for v in nodes])
        y[0] = MIXED
        for i in range(1, len(nodes)):
            if y[i] < 0:
                y[i] = y[nodes[i].parent]
        rows.append(x)
        labels.append(y)
    return BoostedTrees(3, rounds=60, depth=4).fit(np.concatenate(rows), np.concatenate(labels))


def extract(sources: list[str], model: BoostedTrees) -> list[str]:
    """Main texts of whole pages."""
    parsed = [parse(s) for s in sources]
    if not parsed:
        return []
    logs = model.log_probabilities(np.concatenate([features(p) for p in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append(block_text(nodes, decode(nodes, logs[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract_pages(table: DataFrame, model: BoostedTrees) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        m = shared.value
        for b in batches:
            texts = extract(texts_of(b, "html"), m)
            yield batch(out, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    rows = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
