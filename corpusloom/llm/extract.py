"""HTML main-text extraction with a tree-structured graphical model.

The DOM of a page is a tree of binary nodes, content or not. A node's own potential is a
logistic score of its features, a parent and child share a potential by the kind of edge.
Sum-product messages go from the leaves up and from the root down; a node's marginal is the
product of what meets there. Weights are trained on labelled pages by gradient ascent on
the exact likelihood, whose gradient is the difference of labels and marginals. Texts under
content nodes are joined by blocks.

The labelled pages are a fixed number (``N_LABELLED``) of synthetic ones, drawn from a
grammar of usual page furniture; none come from the data.

Defined results: a null or empty page has an empty text. Unclosed elements end as in HTML:
a new block ends an open paragraph, the end of the page ends all. A page without any
content node has an empty text. White space includes the no-break space. Repeated rows are
extracted one by one; other columns are carried along, but for one of the output's name,
which is replaced. A quote that is never closed, or a sign that begins no tag, is text. Work
grows with a page's length alone.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scan import bounded_batches

N_LABELLED = 300
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div main aside nav header footer body form blockquote".split())
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
MAX_DEPTH = 512  # deeper elements hang on the last one; no text is lost by it
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Parts of class and id names, by what they usually name.
NAME_GROUPS = {
    "body": ("article", "content", "main", "post", "entry", "story", "body", "text"),
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "tabs", "toc", "pagination", "pager"),
    "edge": ("footer", "header", "masthead", "banner", "copyright", "legal"),
    "side": ("side", "sidebar", "aside", "widget", "related", "recommend", "popular", "share", "social", "tags", "author-bio"),
    "ad": ("ad", "ads", "advert", "adbox", "banner-ad", "sponsor", "promo", "promoted"),
    "notice": ("cookie", "consent", "notice", "popup", "modal", "alert", "newsletter", "subscribe", "gdpr", "signup"),
    "talk": ("comment", "comments", "reply", "disqus", "discussion", "respond", "replies"),
}
TAG_GROUPS = {
    "article": ("article", "main"), "nav": ("nav", "menu"), "header": ("header",), "footer": ("footer",), "aside": ("aside", "dialog"),
    "form": ("form", "button", "select", "option", "input", "textarea", "label", "fieldset"), "unseen": ("script", "style", "noscript", "template", "svg", "iframe", "head", "title"),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"), "para": ("p", "blockquote", "pre", "dd", "dt", "figcaption"), "list": ("ul", "ol", "dl"), "item": ("li", "tr", "td", "th", "table", "tbody"),
    "link": ("a",), "box": ("div", "section", "body", "html", "center", "details"), "inline": ("b", "i", "em", "strong", "span", "small", "code", "u", "sup", "sub", "mark", "q", "cite", "time", "abbr"), "text": ("#text",),
}
_TAG_OF = {tag: k for k, tags in enumerate(TAG_GROUPS.values()) for tag in tags}
_NAME_OF = {name: k for k, names in enumerate(NAME_GROUPS.values()) for name in names}
N_TAGS, N_NAMES = len(TAG_GROUPS) + 1, len(NAME_GROUPS)
N_NODE = N_TAGS + N_NAMES + 10
#: Kinds of edges: by the child's tag group, apart for children that are named or hidden and for headers of articles.
N_EDGE = N_TAGS + 2


class Tree:
    """Nodes in page order: parents come before their children."""

    __slots__ = ("tag", "attrs", "parent", "text", "label")

    def __init__(self) -> None:
        self.tag, self.attrs, self.parent, self.text, self.label = ["#root"], [""], [-1], [""], [0]

    def add(self, tag: str, attrs: str, parent: int, text: str = "") -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.text.append(text)
        self.label.append(0)
        return len(self.tag) - 1


def _tag_end(page: str, at: int, last_quote: dict[str, int]) -> int:
    """The place of the > that ends a tag, or the page's end; a quote that is never closed is none."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at >= len(page) or page[at] == ">":
            return at
        quote = page[at]
        if at >= last_quote[quote]:
            at = page.find(">", at)
            return len(page) if at < 0 else at
        at = page.index(quote, at + 1) + 1


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, attributes or text, end) of what a page consists of, each character looked at once.

    Kinds are "text", "open" and "close"; comments and declarations are passed over. Elements
    with raw text are passed over to their end.
    """
    last_quote = {quote: page.rfind(quote) for quote in "\"'"}
    at, begin = 0, 0
    while (found := page.find("<", at)) >= 0:
        tag = _TAG.match(page, found)
        if not tag and page[found + 1 : found + 2] not in ("!", "?"):
            at = found + 1  # a mere sign, part of the text
            continue
        if found > begin:
            yield "text", "", page[begin:found], found
        if not tag:
            mark = "-->" if page.startswith("<!--", found) else ">"
            end = page.find(mark, found + 2)
            at = begin = len(page) if end < 0 else end + len(mark)
            continue
        end = _tag_end(page, tag.end(), last_quote)
        name, attrs = tag[1].lower(), page[tag.end() : end]
        at = begin = min(end + 1, len(page))
        if page[found + 1] == "/":
            yield "close", name, "", at
            continue
        yield "open", name, attrs, at
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = begin = close.end() if close else len(page)
    if begin < len(page):
        yield "text", "", page[begin:], len(page)


def parse(page: str | None) -> Tree:
    """The element tree of a page, texts as nodes of their own, raw elements without theirs."""
    tree, open_, names = Tree(), [0], Counter()

    def end(k: int) -> None:
        names.subtract(tree.tag[i] for i in open_[k:])
        del open_[k:]

    for kind, tag, rest, _ in tokens(page or ""):
        if kind == "text":
            tree.add("#text", "", open_[-1], rest)
        elif kind == "close":
            for k in range(len(open_) - 1, 0, -1) if names[tag] else ():
                if tree.tag[open_[k]] == tag:
                    end(k)
                    break
                if tag in ("b", "i", "em", "strong", "span", "a", "p", "li") and tree.tag[open_[k]] in SCOPE:
                    break
        else:
            ends = CLOSES.get(tag, {"p"} if tag in BLOCK else set())
            for k in range(len(open_) - 1, 0, -1) if any(names[x] for x in ends) else ():
                name = tree.tag[open_[k]]
                if name in ends:
                    end(k)
                    break
                if name in SCOPE:
                    break
            node = tree.add(tag, rest, open_[-1])
            if tag not in RAW and tag not in VOID and not rest.endswith("/") and len(open_) < MAX_DEPTH:
                open_.append(node)
                names[tag] += 1
    return tree


@lru_cache(maxsize=8_192)
def named_groups(attrs: str) -> frozenset[int]:
    """What class, id and role say: whole parts of names, or parts that begin or end with a longer name."""
    out = set()
    for names in _NAMES.findall(attrs):
        for part in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", names):
            part = part.lower()
            for one in (part, part.rstrip("s")):
                if one in _NAME_OF:
                    out.add(_NAME_OF[one])
                    break
            else:
                fits = [n for n in _NAME_OF if len(n) > 3 and (part.startswith(n) or part.endswith(n))]
                if fits:
                    out.add(_NAME_OF[max(fits, key=len)])
    return frozenset(out)


def features(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Node features (n x N_NODE) and the kind of each node's edge to its parent."""
    n = len(tree.tag)
    x = np.zeros((n, N_NODE))
    kind = np.zeros(n, dtype=np.int64)
    length, linked = np.zeros(n), np.zeros(n)
    in_link, in_article, in_furniture = (np.zeros(n, dtype=bool) for _ in range(3))
    titled = np.zeros(n, dtype=bool)
    article, furniture = _TAG_OF["article"], {_TAG_OF[t] for t in ("nav", "footer", "aside", "form")}
    for i in range(n):
        tag, parent = tree.tag[i], tree.parent[i]
        group = _TAG_OF.get(tag, N_TAGS - 1)
        x[i, group] = 1
        kind[i] = group
        if i:
            in_link[i], in_article[i], in_furniture[i] = in_link[parent], in_article[parent], in_furniture[parent]
        if tag == "h1":
            titled[i] = True
        if tree.attrs[i]:
            named = named_groups(tree.attrs[i])
            for k in named:
                x[i, N_TAGS + k] = 1
            if _HIDDEN.search(tree.attrs[i]):
                x[i, N_TAGS + N_NAMES] = 1
            if (named and named != {0}) or x[i, N_TAGS + N_NAMES]:
                kind[i] = N_TAGS
                in_furniture[i] |= 0 not in named or len(named) > 1
        if tag == "header" and in_article[i]:
            kind[i] = N_TAGS + 1
        x[i, -9:-7] = in_article[i], in_furniture[i]
        in_link[i] |= tag == "a"
        in_article[i] |= group == article
        in_furniture[i] |= group in furniture
        if tag == "#text":
            length[i] = len(tree.text[i].strip())
            linked[i] = length[i] if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        length[tree.parent[i]] += length[i]
        linked[tree.parent[i]] += linked[i]
        titled[tree.parent[i]] |= titled[i]
    x[:, -7] = titled
    x[:, -6] = (kind == N_TAGS + 1) & titled
    x[:, -5] = np.minimum(np.log1p(length) / 8, 1)
    x[:, -4] = linked / np.maximum(length, 1)
    x[:, -3] = length < 25
    x[:, -2] = length == 0
    x[:, -1] = 1
    return x, kind


def _passed(v: list[float], r: float) -> float:
    """Log-odds message across an edge: v = [w00, w01, w10, w11] by [to, from], r: the sender's log-odds."""
    e = math.exp(min(max(r, -60.0), 60.0))
    return math.log((v[2] + v[3] * e) / (v[0] + v[1] * e))


def marginals(parent: list[int], node: np.ndarray, edge: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of content of each node, and what meets at each edge from below and from above.

    ``node``: log-odds of content by features; ``edge``: 2 x 2 log-potentials [parent, child] by
    kind. One pass up the tree and one down, in page order, where parents come first.
    """
    n = len(parent)
    to_parent = np.exp(edge).reshape(len(edge), 4).tolist()
    to_child = np.exp(edge.transpose(0, 2, 1)).reshape(len(edge), 4).tolist()
    kinds = kind.tolist()
    inside = node.tolist()
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        up[i] = _passed(to_parent[kinds[i]], inside[i])
        inside[parent[i]] += up[i]
    belief, rest = inside[:], [0.0] * n
    for i in range(1, n):
        rest[i] = belief[parent[i]] - up[i]
        belief[i] = inside[i] + _passed(to_child[kinds[i]], rest[i])
    return np.array(belief), np.array(inside), np.array(rest)


def _edge_beliefs(edge: np.ndarray, inside: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """P of the four states [parent, child] of each edge."""
    joint = edge.copy()
    joint[:, 1, :] += rest[:, None]
    joint[:, :, 1] += inside[:, None]
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    return joint / joint.sum(axis=(1, 2), keepdims=True)


def labelled_page(rng: random.Random) -> Tree:
    """A synthetic page whose text nodes are labelled; labels rise to the elements around them."""
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    tree = Tree()
    root = tree.add("html", "", 0)
    head = tree.add("head", "", root)
    tree.add("title", "", head)
    tree.add("style", "", head)
    body = tree.add("body", "", root)

    def text(parent: int, s: str, content: bool) -> None:
        i = tree.add("#text", "", parent, s)
        while content and i > 0 and not tree.label[i]:
            tree.label[i] = 1
            i = tree.parent[i]

    def menu(parent: int, tag: str, attrs: str = "") -> None:
        ul = tree.add("ul", "", tree.add(tag, attrs, parent))
        for _ in range(rng.randint(2, 9)):
            text(tree.add("a", ' href="/x"', tree.add("li", "", ul)), words(1, 3), False)

    def junk(parent: int, tag: str, attrs: str) -> None:
        box = tree.add(tag, attrs, parent)
        for _ in range(rng.randint(1, 3)):
            inner = tree.add(rng.choice(("p", "div", "span", "h3")), "", box)
            text(inner if rng.random() < 0.6 else tree.add("a", ' href="/y"', inner), words(1, 30), False)

    def form(parent: int) -> None:
        f = tree.add("form", rng.choice(("", ' class="search"', ' class="newsletter"')), parent)
        text(tree.add("label", "", f), words(1, 4), False)
        tree.add("input", "", f)
        text(tree.add("button", "", f), words(1, 2), False)

    def remarks(parent: int) -> None:
        """Reader comments, as lists or boxes."""
        if rng.random() < 0.5:
            text(tree.add(rng.choice(("h2", "h3")), "", parent), words(1, 3), False)
        listed = rng.random() < 0.5
        box = tree.add(rng.choice(("ul", "ol")), rng.choice((' class="commentlist"', ' class="comment-list"', ' id="commentsList"', "")), parent) if listed else parent
        for _ in range(rng.randint(1, 5)):
            one = tree.add("li" if listed else rng.choice(("div", "article")), rng.choice((' class="comment"', "", ' class="reply"')), box)
            text(tree.add("p", "", one) if rng.random() < 0.7 else one, words(2, 40), False)

    def prose(parent: int) -> None:
        if rng.random() < 0.25:
            head = tree.add("header", rng.choice(("", ' class="entry-header"', ' class="post-header"')), parent)
            text(tree.add("h1", "", head), words(2, 12), True)
        else:
            text(tree.add("h1", "", parent), words(2, 12), True)
        if rng.random() < 0.2:
            parent = tree.add(rng.choice(("div", "section")), rng.choice(("", ' class="entry-content"', ' class="articleBody"', ' itemprop="articleBody"')), parent)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.7:
                p = tree.add("p", "", parent)
                text(p if rng.random() < 0.8 else tree.add(rng.choice(("b", "em", "span")), "", p), words(1, 80), True)
                if rng.random() < 0.2:
                    text(tree.add("a", ' href="/z"', p), words(1, 4), True)
                    text(p, words(1, 20), True)
            elif kind < 0.8:
                text(tree.add(rng.choice(("h2", "h3")), "", parent), words(1, 6), True)
            elif kind < 0.88:
                ul = tree.add(rng.choice(("ul", "ol")), "", parent)
                for _ in range(rng.randint(1, 5)):
                    text(tree.add("li", "", ul), words(1, 20), True)
            elif kind < 0.92:
                text(tree.add(rng.choice(("blockquote", "pre", "blockquote")), "", parent), words(3, 40), True)
            elif kind < 0.93:
                text(tree.add("figcaption", "", tree.add("figure", "", parent)), words(2, 12), True)
            elif kind < 0.94:
                table = tree.add("table", "", parent)
                for _ in range(rng.randint(1, 3)):
                    row = tree.add("tr", "", table)
                    for _ in range(rng.randint(1, 3)):
                        text(tree.add(rng.choice(("td", "th")), "", row), words(1, 6), True)
            elif kind < 0.96:
                tree.add(rng.choice(("script", "style")), "", parent)
            else:
                junk(parent, rng.choice(("div", "aside")), rng.choice((' class="ad"', ' class="share"', ' class="related"', ' class="promo"', ' class="adbox"', ' style="display:none"')))
        if rng.random() < 0.15:
            junk(parent, "footer", rng.choice(("", ' class="entry-footer"')))

    def before() -> None:
        if rng.random() < 0.5:
            text(tree.add("h2", "", tree.add("header", rng.choice(("", ' class="masthead"')), body)), words(1, 5), False)
        if rng.random() < 0.8:
            menu(body, *rng.choice((("nav", ""), ("div", ' class="menu"'), ("div", ' id="nav"'), ("div", ' class="navbar"'), ("div", ' id="mainMenu"'))))
        if rng.random() < 0.3:
            junk(body, rng.choice(("div", "div", "section", "aside")), rng.choice((' class="cookie-notice"', ' id="consent"', ' class="alert"', ' class="cookiebar"', ' id="cookieBanner"', ' class="gdpr-popup"')))
        if rng.random() < 0.6:
            junk(body, "div", rng.choice((' class="ad"', ' class="advert"', ' class="ads"', ' id="sponsor"')))

    before()
    where = rng.choice((("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="post"')))
    outer = body if rng.random() < 0.7 else tree.add("div", rng.choice(("", ' class="wrapper"')), body)
    if rng.random() < 0.15:
        outer = tree.add("main", "", outer)
    prose(tree.add(*where, outer))
    if rng.random() < 0.4:
        junk(body, rng.choice(("section", "div")), rng.choice((' class="comments"', ' id="comments"', ' class="comment"')))
    if rng.random() < 0.3:
        remarks(tree.add(rng.choice(("section", "div")), rng.choice((' class="comments"', ' id="comments"', ' id="respond"', ' class="discussion"')), body))
    elif rng.random() < 0.1:
        remarks(body)
    if rng.random() < 0.5:
        side = rng.choice((("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="sidebar"'), ("div", ' class="related"'), ("aside", ' class="widgets"')))
        if rng.random() < 0.5:
            junk(body, *side)
        else:  # what would be content elsewhere
            box = tree.add(*side, body)
            for _ in range(rng.randint(1, 2)):
                junk(box, rng.choice(("div", "section", "article")), rng.choice((' class="content"', ' class="text"', ' class="post"', "")))
    if rng.random() < 0.3:
        form(body)
    if rng.random() < 0.8:
        junk(body, *rng.choice((("footer", ""), ("footer", ""), ("div", ' class="footer"'))))
    return tree


@lru_cache(maxsize=2)
def train(n_pages: int = N_LABELLED, rounds: int = 48, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights of node features, and the 2 x 2 log-potentials of each kind of edge."""
    rng = random.Random(seed)
    pages = [labelled_page(rng) for _ in range(n_pages)]
    data = [(t.parent, *features(t), np.array(t.label)) for t in pages]
    w, v = np.zeros(N_NODE), np.zeros((N_EDGE, 2, 2))
    speed_w, speed_v = np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for k in range(rounds):
        grad_w, grad_v = -0.02 * w, -0.02 * v
        for parent, x, kind, y in data[k % 4 :: 4]:
            belief, inside, rest = marginals(parent, x @ w, v, kind)
            grad_w += x[1:].T @ (y - 1 / (1 + np.exp(-np.clip(belief, -40, 40))))[1:]
            pair = -_edge_beliefs(v[kind], inside, rest)
            pair[np.arange(1, len(y)), y[np.array(parent[1:])], y[1:]] += 1
            np.add.at(grad_v, kind[1:], pair[1:])
        speed_w += grad_w**2
        speed_v += grad_v**2
        w += 0.5 * grad_w / np.sqrt(speed_w)
        v += 0.5 * grad_v / np.sqrt(speed_v)
    return w, v


def main_text(page: str | None, weights: tuple[np.ndarray, np.ndarray]) -> str:
    """Blocks of content text in page order, two line feeds between them."""
    tree = parse(page)
    x, kind = features(tree)
    belief, _, _ = marginals(tree.parent, x @ weights[0], weights[1], kind)
    content = (belief > 0).tolist()
    block = [0] * len(tree.tag)
    blocks: list[list[str]] = []
    last = None
    for i in range(1, len(tree.tag)):
        tag, parent = tree.tag[i], tree.parent[i]
        block[i] = i if tag in BLOCK else block[parent]
        if tag == "br" and blocks and block[i] == last:
            blocks[-1].append(" ")
        if tag == "#text" and content[i]:
            if block[i] != last:
                blocks.append([])
                last = block[i]
            blocks[-1].append(html.unescape(tree.text[i]))
        elif tag in BLOCK and tag != "#text":
            last = None if last is not None and last != block[i] else last
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extract_pages(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each; the model is trained once and sent along."""
    bounded_batches(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(train())  # a few hundred numbers

    @F.pandas_udf("string")
    def texts(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda x: main_text(x, weights.value), na_action=None).astype(object)

    return pages.withColumn(out_col, texts(F.col(html_col)))
