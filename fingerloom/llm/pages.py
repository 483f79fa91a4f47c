"""Main text of HTML pages by a tree-structured graphical model.

Block elements of the page are binary variables, content or not. What an element is (tag, words of its class and id, amount
of text, links) gives its own potential, and a potential for each parent and child connects them. Sum-product messages
go up the tree and down again; an element's text counts as content if its marginal is above one half.

The model learns from labelled pages, (html, main text) pairs. :func:`labelled_pages` makes them of pages that mark their article
up as such, by rendering their parts anew with many kinds of markup, so that no single tag decides. At most
``max_pages`` pages are used to fit; extraction covers every whole page and shuffles nothing.

Blocks are joined by an empty line. Formulas are text; scripts, buttons and other hidden elements leave their line whole.

Defined results: NULL and empty pages have the empty text; cut-off pages and unclosed elements are read as far as they go, in time linear in the page; repeated rows are
judged each for itself; without labelled pages the potentials that :data:`START` states are used; an empty table gives no rows;
extra columns are ignored or carried through unchanged.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fingerloom.llm.common import bounded_sample

MAX_PAGES = 300
#: Between the blocks of a main text. Labelled texts of the training have a line for each block.
SEPARATOR = "\n\n"
VARIANTS = 4

#: Fixed lists of HTML: elements inside a line, without an end tag, and whose text is never shown as text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img"
                    " math mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle semantics object embed input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template iframe svg canvas select option button textarea head title datalist audio video annotation annotation-xml".split())
_IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
#: A start tag of the second kind ends an open element of the first.
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li td th tr body".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_LIMITS = frozenset("table ul ol dl body html".split())
_TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "nav", "header", "footer", "aside", "form", "table", "cell", "quote", "pre", "figure", "body", "other")
_TAG_OF = {"h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "menu": "nav", "tr": "cell",
           "td": "cell", "th": "cell", "tbody": "table", "thead": "table", "blockquote": "quote", "figcaption": "figure", "fieldset": "form", "html": "body"}
#: What words of class, id and role say.
WORDS = {
    "content": "article content main post entry body story text blog page copy prose abstract chapter document articlebody maincontent postbody".split(),
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs topnav links skip".split(),
    "head": "header head masthead banner topbar logo branding hero top".split(),
    "foot": "footer foot copyright colophon bottom legal contentinfo imprint".split(),
    "side": "sidebar side aside rail widget widgets complementary column related recommended recommendations trending popular more also teaser".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner300 adsense outbrain taboola commercial".split(),
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay dialog newsletter subscribe subscription paywall message warning privacy".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader feedback reviews review responses guestbook".split(),
    "form": "form login signin signup register search searchform contact input".split(),
    "share": "share sharing social tags tag meta byline author date like follow tools print".split(),
}
_KIND_OF = {w: kind for kind, words in WORDS.items() for w in words}
_KINDS = tuple(WORDS)
_NUMBERS = ("links", "short", "long", "marks", "none", "inside_bad", "inside_good")
FEATURES = (*[f"tag:{t}" for t in _TAGS], *[f"word:{k}" for k in _KINDS], *_NUMBERS, "one")
#: Potentials without labelled pages: weights of features that differ from 0.
START = {"tag:article": 3.0, "tag:main": 3.0, "word:content": 2.5, "tag:p": 1.0, "tag:h": 0.5, "links": -3.0, "long": 1.0, "inside_good": 2.0, "inside_bad": -3.0,
         **{f"tag:{t}": -4.0 for t in ("nav", "footer", "aside", "form")}, **{f"word:{k}": -4.0 for k in _KINDS if k != "content"}}


class Node:
    """A block element: its parent's number, tag, kinds of words, text blocks as (order, text), and counts of its subtree."""

    __slots__ = ("parent", "tag", "kinds", "blocks", "chars", "linked", "marks")

    def __init__(self, parent: int, tag: str, kinds: frozenset):
        self.parent, self.tag, self.kinds = parent, tag, kinds
        self.blocks: list[tuple[int, str]] = []
        self.chars = self.linked = self.marks = 0


class Page(HTMLParser):
    """The block elements of a page in document order; parents come before children.

    Hidden elements stand in a line like any other word: what they hold is left out, and the line goes on behind them. The places of
    the open elements are kept by kind, so that no tag searches the stack: unclosed elements cost no more than others.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "body", frozenset())]
        self.stack: list[tuple[str, int]] = []  # open elements: tag, node number or -1 if in a line
        self.places: dict[str, list[int]] = {}  # of open elements by tag, and of these kinds:
        self.solid: list[int] = []  # neither in a line nor a paragraph
        self.limits: list[int] = []
        self.boxes: list[int] = []  # with a node
        self.hidden = self.links = self.order = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self._end_block()
        for node in reversed(self.nodes[1:]):
            above = self.nodes[node.parent]
            above.chars, above.linked, above.marks = above.chars + node.chars, above.linked + node.linked, above.marks + node.marks

    def _here(self) -> int:
        return self.stack[self.boxes[-1]][1] if self.boxes else 0

    def _end_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            node = self.nodes[self._here()]
            node.blocks.append((self.order, text))
            node.chars += len(text)
            node.linked += min(self.linked, len(text))
            node.marks += sum(text.count(c) for c in ".,;:!?")
            self.order += 1
        self.pieces, self.linked = [], 0

    def _push(self, tag: str, node: int) -> None:
        place = len(self.stack)
        self.stack.append((tag, node))
        self.places.setdefault(tag, []).append(place)
        if tag not in _INLINE and tag != "p":
            self.solid.append(place)
        if tag in _LIMITS:
            self.limits.append(place)
        if node >= 0:
            self.boxes.append(place)
        self.hidden += tag in _HIDDEN
        self.links += tag == "a"

    def _pop_to(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        while len(self.stack) > place:
            tag, node = self.stack[-1]
            if node >= 0:
                self._end_block()
            self.stack.pop()
            self.places[tag].pop()
            for kind in (self.solid, self.limits, self.boxes):
                if kind and kind[-1] == len(self.stack):
                    kind.pop()
            self.hidden -= tag in _HIDDEN
            self.links -= tag == "a"

    def _close_for(self, tag: str) -> None:
        """Close what a start tag ends: open elements of the kinds it ends, as far down as its limit."""
        if self.places.get("head") and tag not in _IN_HEAD:
            self._pop_to(self.places["head"][-1])
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
        barrier = self.limits if tag in _ENDS else self.solid
        limit = barrier[-1] if barrier else -1
        found = [places[k] for t in ends if (places := self.places.get(t)) and (k := bisect_right(places, limit)) < len(places)]
        if found:
            self._pop_to(min(found))

    def handle_starttag(self, tag: str, attrs) -> None:
        self._close_for(tag)
        if tag in _INLINE or tag in _HIDDEN or self.hidden:
            if tag == "br":
                self.pieces.append(" ")
            if tag not in _VOID:
                self._push(tag, -1)
            return
        self._end_block()
        if tag in _VOID:
            return
        words = set()
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop", "aria-label") and value:
                words |= set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        self.nodes.append(Node(self._here(), _TAG_OF.get(tag, tag if tag in _TAGS else "other"), frozenset(_KIND_OF[w] for w in words if w in _KIND_OF)))
        hidden = any((name == "hidden") or (name == "style" and value and re.search(r"display\s*:\s*none", value)) for name, value in attrs)
        self._push("template" if hidden else tag, len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do; the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        places = self.places.get(tag)
        place = places[-1] if places else -1
        box = self.boxes[-1] if self.boxes else -1
        if tag in _INLINE or tag in _HIDDEN and place != box:
            if place > box:  # a stray end of an element in a line doesn't reach beyond its block
                self._pop_to(place)
            return
        # A hidden block is known as a template and ends with any block around its end tag.
        covered = self.places.get("template")
        if covered and covered[-1] == box:
            place = max(place, box)
        if place >= 0:
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())


def features(page: Page, forgiven: frozenset[int] = frozenset()) -> np.ndarray:
    """A row for each element; the ``forgiven`` count as content whatever the words of their class."""
    out = np.zeros((len(page.nodes), len(FEATURES)))
    bad = np.zeros((len(page.nodes), 2))
    first = len(_TAGS) + len(_KINDS)
    for i, node in enumerate(page.nodes):
        out[i, _TAGS.index(node.tag)] = 1
        kinds = node.kinds if i not in forgiven else frozenset({"content"})
        for kind in kinds:
            out[i, len(_TAGS) + _KINDS.index(kind)] = 1
        share = node.linked / node.chars if node.chars else 0.0
        above = bad[node.parent] if node.parent >= 0 else np.zeros(2)
        # An element, or the nearest element around it, that says what it is.
        wrong = bool(kinds - {"content"}) and kinds != {"content", "head"} or node.tag in ("nav", "footer", "aside", "form")
        right = kinds == {"content"} or node.tag in ("article", "main")
        bad[i] = (1, 0) if wrong else (0, 1) if right else above
        out[i, first:first + 7] = (share, node.chars < 40, node.chars > 200, min(1.0, 20 * node.marks / max(node.chars, 1)), node.chars == 0, *bad[i])
    out[:, -1] = 1
    return out


def _outweighed(page: Page, empty: bool) -> frozenset[int]:
    """Elements whose text says more than the words of their class.

    The only article or main element of a page that holds at least half of its unlinked text; and, if nothing else was found, an element
    around at least half of it with two whole sentences, unless one around it or within it speaks against it as well.
    """
    free = [node.chars - node.linked for node in page.nodes]
    bad = [bool(node.kinds - {"content"}) or node.tag in ("nav", "footer", "aside", "form") for node in page.nodes]
    found = set()
    for tag in ("article", "main"):
        own = [i for i, node in enumerate(page.nodes) if node.tag == tag]
        found |= {i for i in own if len(own) == 1 and bad[i] and 2 * free[i] >= free[0] > 0}
    if empty and not found:
        heavy = [i for i, node in enumerate(page.nodes) if i and bad[i] and node.tag not in ("nav", "footer", "aside", "form") and 2 * free[i] >= free[0] > 0 and node.marks >= 2]
        if len(heavy) == 1 and not any(bad[i] for i in _below(page, heavy[0])):
            found.update(heavy)
    return frozenset(found)


def _below(page: Page, top: int) -> list[int]:
    inside = {top}
    for i, node in enumerate(page.nodes):
        if node.parent in inside:
            inside.add(i)
    return sorted(inside - {top})


class Model(NamedTuple):
    """Weights of an element's features, and the log potential of (parent, child) values: 0 is not content, 1 is."""

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, page: Page, forgiven: frozenset[int] = frozenset()) -> np.ndarray:
        """P(content) of every element: messages upward from the leaves, then downward from the root."""
        n = len(page.nodes)
        own = np.zeros((n, 2))
        own[:, 1] = features(page, forgiven) @ self.weights
        up, total = np.zeros((n, 2)), own.copy()
        for i in range(n - 1, 0, -1):
            up[i] = np.logaddexp(self.pair[:, 0] + total[i, 0], self.pair[:, 1] + total[i, 1])
            total[page.nodes[i].parent] += up[i]
        belief = total.copy()
        for i in range(1, n):
            rest = belief[page.nodes[i].parent] - up[i]
            belief[i] += np.logaddexp(self.pair[0] + rest[0], self.pair[1] + rest[1])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        forgiven = _outweighed(page, empty=False)
        blocks = self._blocks(page, forgiven)
        if not blocks and (more := _outweighed(page, empty=True)) - forgiven:
            blocks = self._blocks(page, more)
        return SEPARATOR.join(text for _, text in blocks)

    def _blocks(self, page: Page, forgiven: frozenset[int]) -> list[tuple[int, str]]:
        content = self.marginals(page, forgiven)
        return sorted(b for node, p in zip(page.nodes, content) if p > 0.5 for b in node.blocks)


def start_model() -> Model:
    return Model(np.array([START.get(f, 0.0) for f in FEATURES]), np.array([[0.7, -2.0], [-0.5, 0.7]]))


def node_labels(page: Page, text: str) -> np.ndarray:
    """1 for elements whose text is for the greater part in the main text, 0 for others, -1 for those without text."""
    left: dict[str, int] = {}
    for line in text.split("\n"):
        left[line] = left.get(line, 0) + 1
    good, size = np.zeros(len(page.nodes)), np.zeros(len(page.nodes))
    for order, block, i in sorted((o, b, i) for i, node in enumerate(page.nodes) for o, b in node.blocks):
        size[i] += len(block)
        if left.get(block, 0):
            left[block] -= 1
            good[i] += len(block)
    for i in range(len(page.nodes) - 1, 0, -1):
        good[page.nodes[i].parent] += good[i]
        size[page.nodes[i].parent] += size[i]
    return np.where(size == 0, -1, 2 * good > size).astype(int)


def fit(labelled: list[tuple[str, str]], *, ridge: float = 0.002, steps: int = 800) -> Model:
    """Piecewise: a logistic model of the elements alone, and how often a child's value goes with its parent's."""
    rows, labels, pairs = [], [], np.full((2, 2), 2.0)
    for html, text in labelled:
        page = Page(html)
        own = node_labels(page, text)
        rows.append(features(page)[own >= 0])
        labels.append(own[own >= 0])
        for i, node in enumerate(page.nodes):
            if i and own[i] >= 0 and own[node.parent] >= 0:
                pairs[own[node.parent], own[i]] += 1
    if not rows:
        return start_model()
    x, y = np.concatenate(rows), np.concatenate(labels)
    w, first, second = start_model().weights.copy(), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        grad = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y) / len(y) + ridge * w / 10
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    # Against chance, so that the elements' own potentials aren't counted twice.
    share = pairs / pairs.sum()
    return Model(w, np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True))))


def labelled_pages(html: str, seed: int, variants: int = VARIANTS) -> list[tuple[str, str]]:
    """(html, main text) pairs of a page with a single article element: itself, and its parts in other markup."""
    page = Page(html)
    articles = [i for i, node in enumerate(page.nodes) if node.tag == "article" and node.chars]
    if len(articles) != 1:
        return []
    inside, menu, other = [], [], []
    for i, node in enumerate(page.nodes):
        at = i
        while at >= 0 and at != articles[0]:
            at = page.nodes[at].parent
        for order, text in node.blocks:
            (inside if at >= 0 else menu if node.linked else other).append((order, text, node.tag))
    inside, menu, other = ([(t, tag) for _, t, tag in sorted(part)] for part in (inside, menu, other))
    if not inside:
        return []
    rng = random.Random(seed)
    return [(html, "\n".join(t for t, _ in inside)), *[_rendered(rng, inside, [t for t, _ in menu], [t for t, _ in other]) for _ in range(variants)]]


def _rendered(rng: random.Random, inside: list[tuple[str, str]], menu: list[str], other: list[str]) -> tuple[str, str]:
    """The parts of a page in markup drawn at random, with the main text."""
    def wrap(tag: str, kind: str, body: str, plain: float = 0.2) -> str:
        if rng.random() < plain and tag != "div":
            return f"<{tag}>{body}</{tag}>"
        return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(WORDS[kind])}{rng.choice(["", "-box", " x1", "_inner", "-wrap"])}">{body}</{tag}>'

    sentences = [s.strip() for t, _ in inside for s in re.split(r"(?<=[.!?]) ", t) if s.strip()] + other + ["."]
    some = lambda n: escape(" ".join(rng.choice(sentences) for _ in range(rng.randint(1, n))))
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{escape(t)}</a></li>' for t in (menu or ["Home", "News"])) + "</ul>"
    paragraphs = "".join(f"<p>{escape(t)}</p>" if tag != "h" else f"<h1>{escape(t)}</h1>" for t, tag in inside)
    within = [wrap("div", "ad", some(1)), wrap(rng.choice(["div", "p"]), "share", some(1), 0), wrap("aside", "side", f"<p>{some(2)}</p>"), ""]
    cut = paragraphs.rfind("<p>") if rng.random() < 0.5 else len(paragraphs)
    cut = max(cut, 0)
    paragraphs = paragraphs[:cut] + rng.choice(within) + paragraphs[cut:]
    article = wrap(rng.choice(["article", "main", "div", "section", "div"]), "content", paragraphs)
    if rng.random() < 0.4:
        article = wrap(rng.choice(["main", "div"]), "content", article)
    comments = "".join(wrap(rng.choice(["div", "li", "p"]), "comment", f"<p>{some(3)}</p>", 0) for _ in range(rng.randint(1, 4)))
    before = [wrap("header", "head", f"<p>{some(1)}</p>"), wrap(rng.choice(["nav", "div"]), "nav", links()), wrap("div", "notice", f"<p>{some(2)}</p>"),
              wrap("div", "ad", some(1)), wrap("form", "form", f"<label>{some(1)}</label><input>"), wrap("aside", "side", links() + f"<p>{some(3)}</p>")]
    after = [wrap(rng.choice(["section", "div", "ol"]), "comment", comments, 0), wrap(rng.choice(["aside", "div"]), "side", f"<h3>{some(1)}</h3>" + links() + f"<p>{some(2)}</p>"),
             wrap("div", "ad", some(2)), wrap("div", "notice", f"<p>{some(3)}</p>"), wrap("form", "form", f"<p>{some(1)}</p>")]
    body = "".join(x for x in before if rng.random() < 0.6) + article + "".join(x for x in after if rng.random() < 0.6)
    body += wrap(rng.choice(["footer", "div"]), "foot", f"&copy; <p>{some(2)}</p>" if rng.random() < 0.5 else some(2))
    if rng.random() < 0.5:
        body = f"<div>{body}</div>"
    return f"<html><head><title>t</title></head><body>{body}</body></html>", "\n".join(t for t, _ in inside)


def training_pages(pages: DataFrame, *, html: str = "html", max_pages: int = MAX_PAGES, variants: int = VARIANTS) -> list[tuple[str, str]]:
    """Labelled pages of at most ``max_pages`` pages that mark up their article, chosen by a hash of their content."""
    rows = pages.select(F.col(f"`{html}`").cast("string").alias("html")).where(F.col("html").contains("<article"))
    chosen = bounded_sample(rows.withColumn("h", F.xxhash64("html")), max_pages, F.col("h"))
    return [pair for r in chosen.collect() for pair in labelled_pages(r.html, r.h, variants)]


def extract(pages: DataFrame, model: Model, *, keep: list[str], html: str = "html") -> DataFrame:
    """``row`` (struct of the kept columns) and ``text``, the main text of every whole page."""
    df = pages.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([shared.value.text(h) for h in part.column("html").to_pylist()], pa.string())], names=["row", "text"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, text string")
