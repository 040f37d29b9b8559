"""Main text of web pages: a scanner makes DOM nodes, gradient-boosted trees score them, a tree search decides.

The trees are trained on a bounded number of pages of the table itself. Their nodes are labelled by construction: each
training page is laid out anew from the texts and boilerplate of real pages, in many shapes of markup, so it is known
which node belongs to the article. Decoding keeps a node only inside kept ancestors and picks the choice with the best
total score.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import strings

# Fixed values of HTML: void elements, elements whose text is not shown, block elements, and implied end tags.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"script", "style", "title", "template", "noscript", "iframe", "svg", "object", "head", "textarea", "select",
          "noembed", "noframes", "audio", "video", "canvas", "datalist"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
         "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
         "th", "thead", "tr", "ul"}
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"}), "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
            "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Za-z]+")
_BLANK = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    hidden: bool
    parts: list = field(default_factory=list)  # texts and child numbers, in order
    children: int = 0
    gold: int = -1


_TELLING = re.compile("class|id|role|itemprop|label|name|hidden|style|gold", re.I)


def attribute_tokens(text: str) -> tuple[frozenset, bool, str]:
    """(lower-case words of class, id, role, itemprop and name; whether hidden; label of a training node)."""
    if not text or not _TELLING.search(text):
        return frozenset(), False, ""
    return _attribute_tokens(text)


@lru_cache(maxsize=100_000)
def _attribute_tokens(text: str) -> tuple[frozenset, bool, str]:
    words, hidden, gold = set(), False, ""
    for m in _ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "name"):
            for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", html.unescape(value))):
                words.add(w.lower())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
        elif name == "data-gold":
            gold = value
    return frozenset(words), hidden, gold


def dom(page: str) -> list[Node]:
    """Nodes in document order; number 0 is the root. Unclosed, crossed and stray tags are mended as browsers do in
    the common cases; anything else is text."""
    nodes = [Node("#root", -1, 0, frozenset(), False)]
    stack, at = [0], 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        a, b = m.span()
        if a > at:
            nodes[stack[-1]].parts.append(page[at:a])
        at = b
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                nodes[stack[-1]].parts.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and all(nodes[i].tag != "p" for i in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    del stack[i:]
                    break
                # An inline end tag doesn't close blocks.
                if tag not in BLOCK and nodes[stack[i]].tag in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == "p":
                    del stack[i:]
                    break
                if nodes[stack[i]].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            ended, inside = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag in inside:
                    break
                if nodes[stack[i]].tag in ended:
                    del stack[i:]
                    if tag not in ("tr", "thead", "tbody"):
                        break
        words, hidden, gold = attribute_tokens(m[3])
        parent = stack[-1]
        node = Node(tag, parent, nodes[parent].depth + 1, words, hidden)
        node.gold = int(gold) if gold else nodes[parent].gold
        nodes[parent].parts.append(len(nodes))
        nodes[parent].children += 1
        nodes.append(node)
        if tag in RAW:
            last = _RAW_END[tag].search(page, at)
            end = last.start() if last else len(page)
            nodes[-1].parts.append(page[at:end])
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID:  # browsers ignore the slash of other elements
            stack.append(len(nodes) - 1)
    if at < len(page):
        nodes[stack[-1]].parts.append(page[at:])
    return nodes


# Attribute words that tell boilerplate and content apart; each is a feature of the trees.
BAD = {
    "nav": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs"},
    "top": {"header", "masthead", "topbar", "banner", "logo", "branding", "hero"},
    "bottom": {"footer", "foot", "copyright", "colophon", "bottom", "imprint", "legal"},
    "side": {"sidebar", "side", "aside", "widget", "widgets", "rail", "complementary", "related", "recommended", "popular", "trending", "more", "teaser", "archive", "tags"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "dialog", "toast", "warning", "privacy", "disclaimer", "message"},
    "advert": {"ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "promoted", "promotion", "adsense", "dfp", "outbrain", "taboola"},
    "form": {"form", "search", "login", "signin", "signup", "subscribe", "subscription", "newsletter", "register", "contact"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "responses", "reviews", "commentlist"},
    "share": {"share", "sharing", "social", "follow", "facebook", "twitter", "print", "tools", "meta", "byline"},
}
GOOD = {"article", "content", "main", "post", "entry", "body", "story", "text", "blog", "page", "articlebody", "prose", "document"}
TAG_GROUPS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "input", "label", "fieldset", "option", "select"},
              {"article"}, {"main"}, {"p", "blockquote", "pre"}, HEADINGS, {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"div", "section"},
              {"table", "tr", "td", "th", "tbody", "thead"}, {"a"}, {"body", "html", "#root"}, {"dialog"}, {"figure", "figcaption"}]
N_FEATURES = 12 + 2 * (len(BAD) + 1) + 2 * len(TAG_GROUPS)


@lru_cache(maxsize=100_000)
def own_features(tag: str, tokens: frozenset) -> np.ndarray:
    """Attribute words by group, good ones, then tag groups: 0 or 1."""
    return np.array([not tokens.isdisjoint(w) for w in BAD.values()] + [not tokens.isdisjoint(GOOD)] + [tag in g for g in TAG_GROUPS], np.float32)


def features(pages: list[list[Node]]) -> np.ndarray:
    """A row per node of all pages: text and link density of its subtree, tag and attribute words of its own and of its
    ancestors, depth, and how it stands among its siblings."""
    sizes = [len(p) for p in pages]
    nodes = [n for p in pages for n in p]
    n = len(nodes)
    first = np.repeat(np.cumsum([0] + sizes[:-1]), sizes)
    parent = np.maximum(0, np.array([x.parent for x in nodes])) + first
    depth = np.array([x.depth for x in nodes])
    seen = np.array([x.tag not in UNSEEN and not x.hidden for x in nodes])
    anchor = np.array([x.tag == "a" for x in nodes])
    children = np.array([x.children for x in nodes])
    direct = [[p for p in x.parts if isinstance(p, str)] if s else () for x, s in zip(nodes, seen)]
    text = np.array([float(sum(map(len, d))) for d in direct])
    stops = np.array([float(sum(p.count(". ") + p.count(", ") for p in d)) for d in direct])
    link, tags = np.zeros(n), np.ones(n)
    own = np.array([own_features(x.tag, x.tokens) for x in nodes])
    over = np.zeros_like(own)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n else []
    for level in levels[:0:-1]:  # sums over subtrees, from the leaves
        link[level] = np.where(anchor[level], text[level], link[level])
        some = level[seen[level]]
        for total in (text, link, tags, stops):
            np.add.at(total, parent[some], total[some])
    for level in levels[1:]:
        over[level] = np.maximum(over[parent[level]], own[parent[level]])
    # Place among siblings, by document order within each parent.
    order = np.argsort(parent, kind="stable")
    nth = np.empty(n)
    nth[order] = np.arange(n) - np.searchsorted(parent[order], parent[order], side="left")
    whole = np.maximum(1, text)
    x = np.zeros((n, N_FEATURES), np.float32)
    for j, column in enumerate((
            np.log1p(text), link / whole, np.log1p(tags), text / tags, stops / whole * 100, depth,
            nth / np.maximum(1, children[parent]), np.log1p(children[parent]), text / whole[parent],
            children, (link / whole)[parent], [t.tag in BLOCK for t in nodes])):
        x[:, j] = column
    x[:, 12:12 + own.shape[1]] = own
    x[:, 12 + own.shape[1]:] = over
    return x


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of a fixed depth, as arrays: feature and cut of inner nodes, values of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being article."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            while at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 12) -> Trees:
    """Gradient boosting on log loss with histogram splits; every tree is complete to ``depth``, a level at a time."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [c if len(c) else np.array([np.inf]) for c in cuts]
    # One flat histogram: the cells of a feature are neighbours.
    size = np.array([len(c) + 1 for c in cuts])
    first = np.cumsum(size) - size
    cells = np.column_stack([np.searchsorted(c, x[:, j], side="left") + f for j, (c, f) in enumerate(zip(cuts, first))])
    edge = np.concatenate([np.append(c, np.inf) for c in cuts])
    of = np.repeat(np.arange(len(cuts)), size)
    total, inner = int(size.sum()), 2 ** depth - 1
    start = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    score = np.full(len(x), start)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            head, wide = 2 ** level - 1, 2 ** level
            key = (cells + ((at - head) * total)[:, None]).ravel()
            left = []
            for v in (g, h):
                sums = np.bincount(key, np.repeat(v, cells.shape[1]), wide * total).reshape(wide, total)
                run = np.cumsum(sums, axis=1)
                before = np.where(first > 0, run[:, first - 1], 0.0)
                left.append(run - np.repeat(before, size, axis=1))
            gl, hl = left
            gt, ht = gl[:, size[0] - 1:size[0]], hl[:, size[0] - 1:size[0]]
            gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1)
            best = gain.argmax(axis=1)
            feature[head:head + wide], cut[head:head + wide] = of[best], edge[best]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[leaf]
        trees.append((feature, cut, value))
    return Trees(*map(np.array, zip(*trees)), start)


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """Nodes to keep, so that no kept node has a dropped ancestor and the sum of the kept blocks' scores, weighed by the
    text that stands directly in them, is largest. Inline nodes go with their block."""
    n = len(nodes)
    best, text = np.zeros(n), np.zeros(n)
    for i in range(n - 1, 0, -1):
        node = nodes[i]
        if node.tag in UNSEEN or node.hidden:
            best[i] = -np.inf
            continue
        text[i] += sum(len(p) for p in node.parts if isinstance(p, str))
        if node.tag not in BLOCK:
            # Its text is the parent's, and its verdict too, but for what blocks it holds.
            if best[i] > 0:
                best[node.parent] += best[i]
            text[node.parent] += text[i]
            continue
        own = score[i] * (1 + np.log1p(text[i])) if text[i] else 0.3 * score[i]
        best[i] += own
        if best[i] > 0:
            best[node.parent] += best[i]
    keep = [False] * n
    keep[0] = True
    for i in range(1, n):
        node = nodes[i]
        keep[i] = keep[node.parent] and bool(best[i] > 0 if node.tag in BLOCK else best[i] > -np.inf)
    return keep


def blocks(nodes: list[Node], keep: list[bool]) -> list[str]:
    """Texts of kept blocks in page order: references decoded, white space single, trimmed, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _BLANK.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list = [(0, 0)]
    while todo:
        i, k = todo.pop()
        node = nodes[i]
        if k == 0 and node.tag in BLOCK:
            end()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                line.append(part)
            elif keep[part]:
                if nodes[part].tag == "br":
                    line.append(" ")
                todo.append((i, k))
                todo.append((part, 0))
                break
            elif nodes[part].tag in BLOCK:
                end()
        else:
            if node.tag in BLOCK:
                end()
    end()
    return out


def main_text(page: str, trees: Trees) -> str:
    nodes = dom(page)
    if len(nodes) == 1:
        return ""
    return "\n".join(blocks(nodes, decode(nodes, trees.score(features([nodes])))))


# --- training pages

def _sentences(page: str) -> list[str]:
    """Escaped text blocks of a page: raw material for layouts."""
    nodes = dom(page)
    return [html.escape(t, quote=False) for t in blocks(nodes, [n.tag not in UNSEEN for n in nodes])]


def layout(draw: random.Random, texts: list[str]) -> str:
    """A page in one of many shapes, laid out from the given texts; data-gold tells article (1) from the rest (0)."""
    words = " ".join(texts).split() or ["text"]

    def some(n: int) -> str:
        at = draw.randrange(max(1, len(words) - n))
        return " ".join(words[at:at + n]) or "text"

    def attr(*names: str) -> str:
        if draw.random() < 0.25:
            return ""
        name = draw.choice(names)
        name = draw.choice((name, f"{name}-{draw.choice(('wrap', 'box', 'inner', 'list', 'area', 'block'))}", f"site-{name}"))
        return f' {draw.choice(("class", "class", "id"))}="{name}"'

    def links(n: int, inline: bool = False) -> str:
        one = [f'<a href="/{i}">{some(draw.randint(1, 3))}</a>' for i in range(n)]
        if inline:
            return draw.choice((" ", " | ", " &middot; ")).join(one)
        return "<ul>" + "".join(f"<li>{a}</li>" for a in one) + "</ul>"

    def off(tag: str, kind: tuple[str, ...], inside: str, named: bool = False) -> str:
        a = attr(*kind)
        if named and not a:
            a = f' class="{draw.choice(kind)}"'
        return f'<{tag}{a} data-gold="0">{inside}</{tag}>'

    def nav() -> str:
        body = links(draw.randint(3, 9), draw.random() < 0.3)
        return draw.choice((lambda: off("nav", ("menu", "nav"), body), lambda: off("div", ("nav", "menu", "navbar", "breadcrumb"), body, True)))()

    def head() -> str:
        inside = draw.choice((f"<h1>{some(3)}</h1>", f"<p>{some(5)}</p>", f'<a href="/">{some(2)}</a>', f"<div>{some(4)}</div>")) + (nav() if draw.random() < 0.5 else "")
        return draw.choice((lambda: off("header", ("header", "masthead", "top"), inside), lambda: off("div", ("header", "masthead", "banner", "topbar"), inside, True)))()

    def foot() -> str:
        inside = draw.choice(("", "&copy; 2024 ")) + some(draw.randint(3, 25)) + (links(draw.randint(2, 6), True) if draw.random() < 0.4 else "")
        if draw.random() < 0.5:
            inside = f"<p>{inside}</p>"
        return draw.choice((lambda: off("footer", ("footer",), inside), lambda: off("div", ("footer", "copyright", "bottom"), inside, True)))()

    def side() -> str:
        inside = draw.choice((f"<h3>{some(2)}</h3>", f"<h4>{some(2)}</h4>", "")) + draw.choice((links(draw.randint(2, 7)), f"<p>{some(draw.randint(5, 40))}</p>", f"<p>{some(draw.randint(5, 30))}</p>{links(3)}"))
        return draw.choice((lambda: off("aside", ("sidebar", "related", "widget"), inside), lambda: off("div", ("sidebar", "related", "widget", "recommended"), inside, True), lambda: off("section", ("related", "sidebar", "popular"), inside, True)))()

    def notice() -> str:
        inside = draw.choice(("<p>{}</p>", "{}", "<span>{}</span>")).format(some(draw.randint(4, 30))) + draw.choice(("", "<button>OK</button>", '<a href="#">OK</a>'))
        return off(draw.choice(("div", "section", "div", "dialog")), ("cookie", "notice", "consent", "alert", "popup", "gdpr"), inside, True)

    def advert() -> str:
        inside = draw.choice(("{}", "<p>{}</p>", '<a href="/x">{}</a>', "<span>{}</span>")).format(some(draw.randint(3, 40)))
        return off(draw.choice(("div", "div", "aside", "section", "p")), ("ad", "ads", "advert", "sponsored", "promo", "advertisement"), inside, True)

    def form() -> str:
        inside = f'<label>{some(2)}</label><input name="q"><button>{some(1)}</button>'
        inside = draw.choice(("", f"<p>{some(draw.randint(3, 20))}</p>")) + inside
        return draw.choice((lambda: off("form", ("search", "newsletter", "login", "subscribe"), inside), lambda: off("div", ("newsletter", "subscribe", "login", "search"), f"<form>{inside}</form>", True)))()

    def comments() -> str:
        one = lambda: draw.choice((
            '<div class="comment"><b>{}</b><p>{}</p></div>', '<li class="comment"><p>{1}</p></li>', "<p>{1}</p>", "<article><h4>{}</h4><p>{}</p></article>"
        )).format(some(1), some(draw.randint(3, 60)))
        inside = draw.choice((f"<h3>{some(1)}</h3>", f"<h2>{some(2)}</h2>", "")) + "".join(one() for _ in range(draw.randint(1, 5))) + (form() if draw.random() < 0.3 else "")
        return off(draw.choice(("div", "section", "ol", "aside")), ("comments", "comment-list", "replies", "responses", "disqus", "discussion"), inside, True)

    def share() -> str:
        return off("div", ("share", "social", "follow", "tools"), links(draw.randint(2, 5), draw.random() < 0.6), True)

    def paragraph() -> str:
        t = draw.choice(texts) if texts and draw.random() < 0.6 else some(draw.choice((draw.randint(1, 12), draw.randint(1, 60), 300)))
        if draw.random() < 0.25:
            w = t.split()
            at = draw.randrange(max(1, len(w)))
            w.insert(at, draw.choice(('<a href="/y">{}</a>', "<b>{}</b>", "<em>{}</em>", "<br>{}")).format(some(1)))
            t = " ".join(w)
        return t

    def body() -> str:
        out = []
        for _ in range(draw.choice((1, 2, 3, 4, 6, 9, 30))):
            kind = draw.random()
            if kind < 0.72:
                out.append(draw.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(paragraph()))
            elif kind < 0.80:
                out.append(f"<h{(k := draw.randint(2, 4))}>{some(draw.randint(1, 6))}</h{k}>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{some(draw.randint(1, 20))}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{draw.choice(('<p>{}</p>', '{}')).format(some(draw.randint(3, 40)))}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{some(2)}</td><td>{some(3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<pre>{some(8)}</pre>")
            if draw.random() < 0.08:
                out.append(draw.choice((advert, side, share, notice, form))())
        title = f"<h1>{some(draw.randint(1, 9))}</h1>" if draw.random() < 0.75 else ""
        if title and draw.random() < 0.2:
            title = f"<header>{title}</header>"
        inside = title + "".join(out)
        if draw.random() < 0.25:
            inside = f'<div{attr("content", "entry", "body", "text")}>{inside}</div>'
        shape = draw.random()
        if shape < 0.5:
            inside = f'<article{attr("post", "article", "entry")} data-gold="1">{inside}{comments() if draw.random() < 0.1 else ""}</article>'
        elif shape < 0.65:
            inside = f'<main{attr("main", "content")} data-gold="1">{inside}</main>'
        elif shape < 0.95:
            names = ("article", "content", "post", "main", "entry", "story", "text", "post-body")
            inside = f'<{(t := draw.choice(("div", "section")))} class="{draw.choice(names)}" data-gold="1">{inside}</{t}>'
        else:
            inside = f'<div data-gold="1">{inside}</div>'
        return f"<main>{inside}</main>" if draw.random() < 0.15 and not inside.startswith("<main") else inside

    tops = [f() for f in draw.sample((nav, head, notice, advert, form, share, side), draw.randint(0, 5))]
    ends = [f() for f in draw.sample((side, comments, advert, notice, form, share, nav), draw.randint(0, 5))]
    if draw.random() < 0.7:
        ends.insert(draw.choice((0, len(ends))), foot())
    page = "".join(tops) + body() + "".join(ends)
    if draw.random() < 0.3:
        page = f'<div{attr("page", "wrapper", "container")}>{page}</div>'
    return f"<html><head><title>{some(4)}</title><script>x()</script></head><body>{page}</body></html>"


def training_nodes(pages: list[str], layouts: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, weight) of the block nodes of laid-out pages; nodes that hold both kinds are article."""
    draw = random.Random(seed)
    texts = list(map(_sentences, pages)) or [["text"]]
    laid = [dom(layout(draw, texts[i % len(texts)])) for i in range(layouts)]
    gold = []
    for nodes in laid:
        own = [n.gold for n in nodes]
        for j in range(len(nodes) - 1, 0, -1):  # wrappers of the article are part of the way to it
            if own[j] == 1 and own[nodes[j].parent] == -1:
                own[nodes[j].parent] = 1
        gold += [g if n.tag in BLOCK and n.tag not in UNSEEN else -1 for g, n in zip(own, nodes)]
    y = np.array(gold, float)
    return features(laid)[y >= 0], y[y >= 0], np.ones(int((y >= 0).sum()))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = 100, layouts: int = 1000, longest: int = 200_000) -> Trees:
    """Trees from ``layouts`` training pages made of the texts of ``rows`` pages, those with the smallest hash of the id
    among pages of at most ``longest`` characters: a bounded sample for the fit only. Two hashes a page are ordered; then
    the pages that have them are read, equal ones once."""
    hashes = F.struct(F.xxhash64(id_col).alias("id"), F.xxhash64(html_col).alias("html"))
    some = pages.where(F.length(html_col) <= longest).select(hashes.alias("hash"), F.col(html_col).alias("html"))
    first = [tuple(r["hash"]) for r in some.select("hash").distinct().orderBy("hash").limit(rows).collect()]
    picked = F.col("hash.id").isin([i for i, _ in first]) & F.col("hash.html").isin([h for _, h in first])
    read = some.where(picked).groupBy("hash").agg(F.first("html").alias("html")).collect() if first else []
    texts = {tuple(r["hash"]): r["html"] for r in read}
    return boost(*training_nodes([texts[h] for h in first], layouts))


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) per row: the article's blocks, one per line. A null or empty page gives an empty text; pages without
    article blocks too. Repeated rows stay. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [dom(p) for p in strings(batch.column(1))]
            sizes = np.cumsum([0] + [len(p) for p in pages])
            score = trees.score(features(pages)) if pages else np.zeros(0)
            text = ["\n".join(blocks(p, decode(p, score[a:b]))) for p, a, b in zip(pages, sizes, sizes[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["id", "text"])

    kind = dict(pages.dtypes)[id_col]
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, text string")
