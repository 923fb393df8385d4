"""Main text of web pages: boosted trees over features of DOM nodes, decoded along the tree."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pages that the trees are grown from, at most: those with the smallest hash of their html.
MAX_PAGES = 150

# Kinds of elements, and words in class, id and role that tell of their use.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
HIDDEN = RAW | set("head svg math select option button canvas object audio video map datalist".split())
HEAD_CONTENT = set("title meta link style script base basefont bgsound noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
               "section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"},
          "th": {"tr", "table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
SIDE_WORDS = set("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
                 "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup "
                 "promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
                 "subscription tags teaser toolbar widget widgets".split())
MAIN_WORDS = set("article body content entry main post prose story text".split())
TAG_GROUPS = [{"article", "main"}, {"section", "div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"nav", "menu"}, {"header", "footer"},
              {"aside", "form", "dialog"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tr", "td", "th"},
              {"blockquote", "pre", "figure", "figcaption"}, {"#text"}]

_TAG = re.compile(r"<(?:!--(?:.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    words: frozenset = frozenset()
    parent: int = -1
    items: list = field(default_factory=list)  # texts, and numbers of child nodes
    block: bool = True


def parse(page: str) -> list[Node]:
    """Elements of a page in document order, the root first; tolerant of missing and stray tags, without recursion."""
    nodes, stack, at = [Node("#root")], [0], 0

    def close(down_to: int):
        del stack[down_to:]

    def end_head():  # its end tag may be left out: what cannot stand in a head ends it
        if nodes[stack[-1]].tag == "head":
            close(len(stack) - 1)

    def write(text: str):
        if not text.isspace():
            end_head()
        nodes[stack[-1]].items.append(text)

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            write(page[at:])
            break
        if m.start() > at:
            write(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    close(i)
                    break
            continue
        if tag not in HEAD_CONTENT:
            end_head()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t == "p":
                    close(i)
                    break
                if t not in INLINE:
                    break
        elif tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                t = nodes[stack[i]].tag
                if t in LIMITS[tag]:
                    break
                if t in SIBLINGS[tag]:
                    close(i)
                    break
        words = frozenset(w for a in _ATTR.finditer(m[3]) for w in _WORD.findall((a[2] or a[3] or a[4] or "").lower())) if m[3] else frozenset()
        nodes.append(Node(tag, words, stack[-1], [], tag not in INLINE))
        here = len(nodes) - 1
        nodes[stack[-1]].items.append(here)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.end() - 1) + 1 or n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(here)
    for i in range(len(nodes) - 1, 0, -1):  # an inline element around blocks acts as a block
        if nodes[i].block and nodes[i].tag not in HIDDEN:
            nodes[nodes[i].parent].block = True
    return nodes


@dataclass(slots=True)
class Unit:
    """A node of the tree that is judged: a block element, or a run of inline content beside blocks (tag ``#text``)."""

    tag: str
    words: frozenset
    parent: int
    depth: int
    text: str = ""
    linked: int = 0
    chars: int = 0
    links: int = 0
    below: int = 0
    children: list = field(default_factory=list)


def units_of(nodes: list[Node]) -> list[Unit]:
    """Judged nodes in document order, the root first; hidden elements (scripts, styles, titles, buttons) are not among them."""
    units = [Unit("#root", frozenset(), -1, 0)]
    todo: list[tuple] = [("open", 0, 0)]  # (what, node, unit)
    run: list[str] = []
    run_linked = 0

    def flush(unit: int):
        nonlocal run, run_linked
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            alone = not nodes_with_blocks[unit]
            if alone:
                units[unit].text, units[unit].chars, units[unit].linked = text, len(text), min(run_linked, len(text))
            else:
                units.append(Unit("#text", frozenset(), unit, units[unit].depth + 1, text, min(run_linked, len(text)), len(text)))
                units[unit].children.append(len(units) - 1)
        run, run_linked = [], 0

    def has_blocks(node: int) -> bool:
        look = [node]
        while look:
            for x in nodes[look.pop()].items:
                if not isinstance(x, str):
                    if nodes[x].block and nodes[x].tag not in HIDDEN:
                        return True
                    if nodes[x].tag not in HIDDEN:
                        look.append(x)
        return False

    nodes_with_blocks = {0: has_blocks(0)}
    while todo:
        what, node, unit = todo.pop()
        if what == "text":
            run.append(node)
        elif what == "link":
            run_linked += node
        elif what == "close":
            flush(unit)
        elif what == "open":
            parts: list[tuple] = []
            for x in nodes[node].items:
                if isinstance(x, str):
                    parts.append(("text", x, unit))
                    continue
                child = nodes[x]
                if child.tag == "br":
                    parts.append(("text", "\n", unit))
                elif child.tag in HIDDEN or child.tag in VOID:
                    continue
                elif not child.block:
                    if child.tag == "a":
                        units[unit].links += 1
                        parts.append(("link", sum(len(t) for t in child.items if isinstance(t, str)), unit))
                    parts.append(("open", x, unit))
                    continue
                else:
                    parts.append(("block", x, unit))
            if node == 0 or nodes[node].block:
                parts.append(("close", None, unit))
            todo.extend(reversed(parts))
        else:  # a block inside: what ran before it ends
            flush(unit)
            units.append(Unit(nodes[node].tag, nodes[node].words, unit, units[unit].depth + 1))
            here = len(units) - 1
            units[unit].children.append(here)
            nodes_with_blocks[here] = has_blocks(node)
            todo.append(("open", node, here))
    return units


FEATURES = (["chars", "all_chars", "link_share", "links", "nodes_below", "chars_per_node", "depth", "place", "siblings", "rank", "like_siblings",
             "share_of_parent", "share_of_page", "stops", "capital", "side_words", "main_words", "side_above", "main_above", "p_below"]
            + [f"tag{i}" for i in range(len(TAG_GROUPS))])


def features(units: list[Unit]) -> np.ndarray:
    """One row of FEATURES per unit: its subtree's text, links and density, its tag and attributes, depth, place and siblings."""
    n = len(units)
    total, linked, links, below, ps, place = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    before = 0
    for i, u in enumerate(units):
        place[i] = before
        before += u.chars
    for i in range(n - 1, -1, -1):
        u = units[i]
        total[i] += u.chars
        linked[i] += u.linked
        links[i] += u.links
        if u.parent >= 0:
            p = u.parent
            total[p] += total[i]
            linked[p] += linked[i]
            links[p] += links[i]
            below[p] += below[i] + 1
            ps[p] += ps[i] + (u.tag == "p")
    side, main = [0] * n, [0] * n
    out = np.zeros((n, len(FEATURES)))
    page = max(before, 1)
    rank = [0] * n
    like = [0] * n
    for u in units:
        tags = Counter(units[c].tag for c in u.children)
        for r, c in enumerate(u.children):
            rank[c], like[c] = r, tags[units[c].tag]
    for i, u in enumerate(units):
        p = u.parent
        own_side = len(u.words & SIDE_WORDS) + (u.tag in SIDE_TAGS)
        own_main = len(u.words & MAIN_WORDS) + (u.tag in MAIN_TAGS)
        side[i] = (side[p] if p >= 0 else 0) + own_side
        main[i] = (main[p] if p >= 0 else 0) + own_main
        siblings = len(units[p].children) if p >= 0 else 1
        out[i, :20] = (math.log1p(u.chars), math.log1p(total[i]), linked[i] / max(total[i], 1), math.log1p(links[i]), math.log1p(below[i]),
                       math.log1p(total[i] / (below[i] + 1)), u.depth, place[i] / page, math.log1p(siblings), rank[i] / siblings, like[i] / siblings,
                       total[i] / max(total[p], 1) if p >= 0 else 1, total[i] / page, (u.text.count(".") + u.text.count(",")) / max(u.chars, 1),
                       u.text[:1].isupper(), own_side, own_main, side[i] - own_side, main[i] - own_main, math.log1p(ps[i]))
        for g, tags in enumerate(TAG_GROUPS):
            out[i, 20 + g] = u.tag in tags
    return out


@dataclass
class Trees:
    """Boosted regression trees of a fixed depth for the log-odds that a node belongs to the main text."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, depth = np.full(len(x), self.base), int(np.log2(self.value.shape[1])) if len(self.value) else 0
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2 ** depth - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, l2: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains over quantile bins."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    inner, leaves = 2 ** depth - 1, 2 ** depth
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    odds, built = np.full(len(y), model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        g, h = y - p, p * (1 - p)
        at, f, c = np.zeros(len(y), dtype=int), np.zeros(inner, int), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = (1e-6, None)
            if len(mine) >= 10:
                gs, hs = g[mine].sum(), h[mine].sum()
                for j, cut in enumerate(cuts):
                    gl = np.cumsum(np.bincount(code[mine, j], g[mine], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[mine, j], h[mine], len(cut) + 1))[:-1]
                    gain = gl ** 2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs ** 2 / (hs + l2)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (j, float(cut[gain.argmax()])))
            if best[1]:
                f[node], c[node] = best[1]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > c[node])
        leaf = at - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        odds += v[leaf]
        built.append((f, c, v))
    return Trees(model.base, *(np.array(z) for z in zip(*built)))


def decode(units: list[Unit], odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which every chosen node's parent is chosen too."""
    worth = odds.astype(float).copy()
    for i in range(len(units) - 1, 0, -1):
        worth[units[i].parent] += max(worth[i], 0.0)
    keep = [False] * len(units)
    for i, u in enumerate(units):
        keep[i] = worth[i] > 0 and (i == 0 or keep[u.parent])
    return keep


def taught(units: list[Unit]) -> np.ndarray | None:
    """Labels by a page's own markup: inside an article or main element and not inside anything that names another use;
    None for a page without such an element. Ancestors of main text count as main text."""
    inside, out = [False] * len(units), np.zeros(len(units))
    barred = [False] * len(units)
    for i, u in enumerate(units):
        p = u.parent
        barred[i] = (barred[p] if p >= 0 else False) or u.tag in SIDE_TAGS or bool(u.words & SIDE_WORDS and u.tag not in MAIN_TAGS)
        inside[i] = (inside[p] if p >= 0 else False) or u.tag in MAIN_TAGS
        out[i] = inside[i] and not barred[i]
    if not out.any():
        return None
    for i in range(len(units) - 1, 0, -1):
        if out[i]:
            out[units[i].parent] = 1
    return out


#: Blocks that training pages get besides their own, and other wrappers of the article; a lesson's main text stays what it was.
EXTRA = ['<header class="site-header"><div>{w}</div><p>{s}</p></header>', '<div class="sidebar"><h3>{w}</h3><ul><li><a href="#">{w}</a></li><li><a href="#">{s}</a></li></ul></div>',
         '<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>', '<section id="comments"><h2>{w}</h2><div class="comment"><p>{s} {s}</p></div><div class="comment"><p>{s}</p></div></section>',
         '<form action="/q"><label>{w}</label><input name="q"><p>{s}</p></form>', '<aside><h4>{w}</h4><p>{s}</p></aside>', '<div class="related"><a href="#">{s}</a><a href="#">{w}</a></div>',
         '<div class="ad banner">{s}</div>', '<div class="share-buttons"><a href="#">{w}</a> <a href="#">{w}</a></div>', '<ul class="menu"><li><a href="#">{w}</a></li><li><a href="#">{w}</a></li></ul>',
         '<div class="newsletter"><p>{s}</p><form><input></form></div>', '<ol class="comment-list"><li class="comment"><p>{s}</p><a href="#">{w}</a></li><li><p>{s}</p></li></ol>',
         '<div><a href="#">{w}</a> | <a href="#">{w}</a> | <a href="#">{w}</a></div>', '<div class="top"><a href="#">{w}</a> <a href="#">{w}</a></div>']
WRAPPERS = [("article", ""), ("main", ""), ("div", ' class="post-content"'), ("div", ' id="content"'), ("section", ' class="story"'), ("div", "")]


def lessons(pages: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages that their own markup teaches, plain and with other wrappers and added blocks."""
    rng, xs, ys = np.random.default_rng(seed), [], []
    for page in pages:
        units = units_of(parse(page))
        y = taught(units)
        if y is None:
            continue
        xs.append(features(units))
        ys.append(y)
        words = [w for u in units for w in u.text.split()][:2000] or ["x"]
        for _ in range(2):
            tag, attrs = WRAPPERS[rng.integers(len(WRAPPERS))]
            made, marks = re.sub(r"<(article|main)\b[^>]*>", f'<{tag}{attrs} role="xtaughtx">', page), []
            made = re.sub(r"</(article|main)\s*>", f"</{tag}>", made)
            for k in rng.choice(len(EXTRA), 4, replace=False):
                pick = lambda n: html.escape(" ".join(words[j] for j in rng.integers(0, len(words), n)))
                extra = EXTRA[k].format(w=pick(2), s=pick(int(rng.integers(6, 40)))).replace(">", ' role="xextrax">', 1)
                ends = [m.start() for m in re.finditer(rf"</{tag}>|<h1\b|</p>|<{tag}\b[^>]*xtaughtx", made)]
                cut = ends[int(rng.integers(len(ends)))] if ends else len(made)
                cut = made.find(">", cut) + 1 if made.startswith("</", cut) else cut
                made = made[:cut] + extra + made[cut:]
            units = units_of(parse(made))
            inside, extra_in, y = [False] * len(units), [False] * len(units), np.zeros(len(units))
            for i, u in enumerate(units):
                p = u.parent
                extra_in[i] = (p >= 0 and extra_in[p]) or "xextrax" in u.words
                inside[i] = (p >= 0 and inside[p]) or "xtaughtx" in u.words
                y[i] = inside[i] and not extra_in[i]
            for i in range(len(units) - 1, 0, -1):
                if y[i]:
                    y[units[i].parent] = 1
            xs.append(features(units))
            ys.append(y)
    if not xs:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Trees:
    """Trees from the markup of at most ``max_pages`` of the pages that hold an article or main element."""
    able = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") < 200_000)).select(F.xxhash64("html").alias("h"), "html")
    return grow(*lessons([r["html"] for r in able.orderBy("h", "html").limit(max_pages).select("html").collect()]))


def texts(pages: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page."""
    judged = [units_of(parse(p)) if p else None for p in pages]
    some = [u for u in judged if u]
    odds = trees.odds(np.concatenate([features(u) for u in some])) if some else None
    if some and not len(trees.value):  # nothing was learned: the markup's own words decide
        odds = np.concatenate([np.array([1.0 if not (u.tag in SIDE_TAGS or u.words & SIDE_WORDS) else -1e6 for u in us]) for us in some])
    out, at = [], 0
    for units in judged:
        if not units:
            out.append("")
            continue
        keep = decode(units, odds[at:at + len(units)])
        at += len(units)
        out.append("\n\n".join(u.text for u, k in zip(units, keep) if k and u.text))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, ``text`` (main text, empty if none), ``n_chars`` (its code points) of every row of ``pages``.

    Pages are read whole. Null and empty html gives an empty text; text outside any element is judged like an element;
    rows with null page_id or url and repeated rows are returned as they come; extra columns are ignored; an empty
    table gives no rows. Blocks come in page order, with character references decoded and white space made one space.
    """
    small_batches(pages.sparkSession)
    trees = fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    cols = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInArrow(run, "page_id long, url string, text string, n_chars long")
