"""HTML extraction: a graphical model on the page's tree, sum-product up and down, content marginals."""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import packed, row_and, shipped, table, unpacked
from tessera.llm.html_pages import SAID, pages

RAW = "script style textarea title template noscript iframe svg object select datalist canvas audio video noembed noframes head xmp"
#: Elements whose content is never page text; the tokens of most of them aren't markup either.
DROPPED = frozenset(RAW.split()) | {"button", "option", "label", "legend", "input", "annotation", "annotation-xml"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var x-content x-noise".split())
#: Formulas are text, on a line of its own or not; their annotations (other notations of the same) aren't shown.
INLINE |= frozenset("math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd".split())
#: Which open elements a start tag ends: the nearest of the first set, not beyond one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"  # closed by itself, as only foreign elements can be: empty
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template|svg)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>",
    re.S | re.I,
)
#: What is still open at the end of a match that reaches the page's last '>'; and what may begin after that and is never closed.
OPEN_END = re.compile(r"\A(?:<!--(?!.*-->\Z)|<!\[CDATA\[(?!.*\]\]>\Z)|<(script|style|textarea|title|noscript|iframe|xmp|noembed|noframes|template|svg)(?=[\s/>])(?!.*(?:/|</\1\s*)>\Z))", re.S | re.I)
LAST = re.compile(r"<!--.*|<!\[CDATA\[(?P<text>.*)", re.S)
ATTR = re.compile(r"(?<![\w:.-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Names that pages give to their parts, by what they say about them.
HINTS = {
    "main": "article content entry story body text post main hentry prose",
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar pagination pager toc",
    "frame": "header footer masthead banner logo copyright bottom colophon",
    "side": "sidebar side aside widget rail",
    "more": "related recommended popular more tags share social meta byline toolbar",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion adsense",
    "notice": "cookie cookies consent gdpr notice alert newsletter popup modal subscribe signup login",
    "reader": "comment comments reply replies disqus responses respond discussion feedback",
}
_HINT = {w: k for k, ws in HINTS.items() for w in ws.split()}
_STRONG = ("reader", "ad", "notice", "menu", "side", "more", "frame", "main")


def hint(attrs: str) -> str:
    """The strongest kind of part that class, id or role name, or ''."""
    found = set()
    for m in ATTR.finditer(attrs):
        for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()):
            if w in _HINT:
                found.add(_HINT[w])
    return next((k for k in _STRONG if k in found), "")


@dataclass
class Tree:
    """Nodes in page order: parent's place, tag, hint, texts, letters of links, text blocks (place of the node, text), and content marks."""

    parent: list[int]
    tag: list[str]
    hint: list[str]
    text: list[list[str]]
    linked: list[int]
    blocks: list[tuple[int, str]]
    marked: list[int]  # 1 within content, 2 within noise put into it, else 0


class Open:
    """The open elements: names, and of each name and of the blocks where they are, so that nothing is searched for."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], ["#root"]
        self.at: dict[str, list[int]] = {"#root": [0]}
        self.blocks = [0]

    def push(self, node: int, name: str) -> None:
        if name not in INLINE:
            self.blocks.append(len(self.names))
        self.at.setdefault(name, []).append(len(self.names))
        self.nodes.append(node)
        self.names.append(name)

    def last(self, *names: str) -> int:
        """Where the innermost of these is, or -1."""
        found = -1
        for n in names:
            places = self.at.get(n)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, to: int) -> bool:
        """Closes all from place `to` on; whether a block was among them."""
        for name in self.names[to:]:
            self.at[name].pop()
        held = self.blocks[-1] >= to
        while self.blocks[-1] >= to:
            self.blocks.pop()
        del self.nodes[to:], self.names[to:]
        return held


def parse(page: str) -> Tree:
    """The page's elements and blocks of text, with tags that nothing closes or opens taken as browsers take them."""
    t = Tree([-1], ["#root"], [""], [[]], [0], [], [0])
    now = Open()
    pieces: list[str] = []
    owner = 0
    dropped = 0  # place among the open elements, plus one, of the outermost dropped one

    def flush() -> None:
        nonlocal pieces
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                t.blocks.append((owner, text))
                t.text[owner].append(text)
            pieces = []

    def push(tag: str, attrs: str = "") -> None:
        t.parent.append(now.nodes[-1])
        now.push(len(t.parent) - 1, tag)
        t.tag.append(tag)
        t.hint.append(hint(attrs) if attrs else "")
        t.text.append([])
        t.linked.append(0)
        t.marked.append(2 if now.last("x-noise") > 0 else int(now.last("x-content") > 0))

    def ensure_body() -> None:
        """Pages may leave out html and body; browsers put them in."""
        if len(now.names) == 1 or now.names == ["#root", "html"]:
            for tag in ("html", "body")[len(now.names) - 1:]:
                push(tag)

    def words(raw: str) -> None:
        nonlocal owner
        if dropped or not raw:
            return
        if raw.strip():
            ensure_body()
        block = now.blocks[-1]
        if not pieces:
            owner = now.nodes[block]
        pieces.append(raw)
        if now.last("a") >= block:
            t.linked[owner] += len(raw)

    def pop(to: int) -> None:
        nonlocal dropped
        if now.blocks[-1] >= to:
            flush()
        now.cut(to)
        if dropped > to:
            dropped = 0

    at, final = 0, page.rfind(">") + 1
    for m in TOKEN.finditer(page, 0, final):  # no tag ends further on, so none is looked for there
        words(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if m["raw"] or tag is None:
            closed = at < final or OPEN_END.search(m[0]) is None
            if m[0].startswith("<![CDATA["):
                words(entities.escape((m[0] if closed else page[m.start():])[9:].removesuffix("]]>")))
            if not closed:
                at = len(page)
            continue
        tag = tag.lower()
        if m["end"]:
            place = now.last(tag)
            if place > 0 and not (tag in INLINE and now.last("td", "th", "table") > place):
                pop(place)
            elif place < 1 and tag in ("p", "br"):
                flush()
            continue
        if tag in ("br", "hr"):
            flush()
        if tag in VOID:
            continue
        if now.last("head") > 0:  # what may stand in a head was read above; anything else ends it
            pop(now.last("head"))
        inline = tag in INLINE
        if not inline:
            flush()
            p = now.last("p")
            if p > 0 and now.last("td", "th", "table", "button") < p:
                pop(p)
            if tag in ENDS:
                mine, stop = ENDS[tag]
                if now.last(*mine) > max(0, now.last(*stop)):
                    pop(now.last(*mine))
        if tag in ("body", "html") and now.last(tag) > 0:
            continue
        if m["attrs"].endswith("/") and tag in INLINE and tag not in ("a", "span"):
            continue
        if tag not in ("html", "head", "body", "x-content", "x-noise"):
            ensure_body()
        if inline:
            now.push(now.nodes[-1], tag)
        else:
            push(tag, m["attrs"] or "")
        if tag in DROPPED and not dropped:
            dropped = len(now.names)
    rest = LAST.search(page, max(at, final))
    words(page[at:rest.start() if rest else len(page)])
    if rest and rest["text"]:
        words(entities.escape(rest["text"]))
    flush()
    return t


#: Tags that the model knows by name; others are 'other'.
TAGS = {x: i for i, x in enumerate("other #root html body main article section div p h1 h2 h3 ul ol li dl dt dd table tbody thead tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary center menu".split())}
KINDS = {x: i for i, x in enumerate(["", *HINTS])}


SAYS = re.compile("|".join(re.escape(x) for x in SAID), re.I)
#: Signs that are i or s whatever the case to SAYS, but aren't by lower().
ODD_CASE = re.compile("[İıſ]")


def says(text: str) -> bool:
    """Whether SAYS finds something. Each phrase is sought by itself in lower case, many times faster than all at each place."""
    if not text.isascii() and ODD_CASE.search(text):
        return SAYS.search(text) is not None
    low = text.lower()
    return any(x in low for x in SAID)


def describe(t: Tree) -> np.ndarray:
    """For each node the classes of its features: tag, hint, length of its own text, share of links, last sign, and whether it says what adverts and notices say (1: in a short text, 2: in a long one)."""
    n = len(t.parent)
    out = np.zeros((n, 6), np.int64)
    for i in range(n):
        own = t.text[i]
        size = sum(map(len, own))
        out[i, 0] = TAGS.get(t.tag[i], 0)
        out[i, 1] = KINDS[t.hint[i]]
        out[i, 2] = 0 if not size else 1 + min(5, (size.bit_length()) // 2)
        share = 0 if not size else min(1.0, t.linked[i] / size)
        out[i, 3] = 0 if not size else 1 + (share > 0.2) + (share > 0.6)
        out[i, 4] = 0 if not size else 1 + (own[-1][-1] in ".!?…:;") + 2 * (own[0][:1] in "©")
        if any(map(says, own)):
            out[i, 5] = 1 if size <= 160 else 2
    return out


DAMPED, CHILD = 0.2, 0.3
SIZES = (len(TAGS), len(KINDS), 7, 4, 5, 3)


@dataclass
class Potentials:
    """Log potentials: of each feature class by label; of (parent's label, label) by the child's tag and hint; of a child's tag by its parent's tag and label; of the root."""

    unary: list[np.ndarray]
    pair: np.ndarray
    child: np.ndarray
    root: np.ndarray


#: Labelled pages to learn from, and the parts in which they are made, each from a seed of its own.
PAGES, PARTS = 3_000, 12


def counted(part: int, n: int = PAGES, seed: int = 17) -> list[np.ndarray]:
    """Counts of one part of the labelled pages: unary ones, pairs, children by parent, roots."""
    unary = [np.zeros((2, s)) for s in SIZES]
    pair, child, root = np.zeros((len(TAGS), len(KINDS), 2, 2)), np.zeros((len(TAGS), 2, len(TAGS))), np.zeros(2)
    for page in pages(n // PARTS, seed * 1000 + part):
        t = parse(page)
        x, y = describe(t), _labels(t)
        for i in range(len(y)):
            if t.parent[i] < 0:
                root[y[i]] += 1
                continue
            for f in range(2, len(SIZES)):
                unary[f][y[i], x[i, f]] += 1
            above = t.parent[i]
            pair[x[i, 0], x[i, 1], y[above], y[i]] += 1
            child[x[above, 0], y[above], x[i, 0]] += 1
    return [*unary, pair, child, root]


def learned(parts: list[list[np.ndarray]]) -> Potentials:
    """Potentials of the counts of all parts, with one added to each."""
    *unary, pair, child, root = (sum(x) for x in zip(*parts))
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    unary = [norm(u + 1) for u in unary]
    unary[0][:], unary[1][:] = 1, 1  # the tag and the hint speak through the pair potentials
    # pairs not seen lean on the tag alone, and that on all
    tag_only = pair.sum(axis=1)
    smooth = norm(tag_only + 4 * norm(tag_only.sum(axis=0) + 1))
    pair = norm(pair + 4 * smooth[:, None])
    # the texts of a part are alike, and so are its children, so each is taken for a part of the evidence that it would be alone; what adverts say is whole evidence
    damp = [DAMPED] * (len(SIZES) - 1) + [1.0]
    return Potentials([d * np.log(u) for d, u in zip(damp, unary)], np.log(pair), CHILD * np.log(norm(child + 4 * norm(child.sum(axis=0) + 1))), np.log(norm(root + 1)))


@functools.lru_cache(maxsize=2)
def trained(n: int = PAGES, seed: int = 17) -> Potentials:
    """The potentials, counted here."""
    return learned([counted(part, n, seed) for part in range(PARTS)])


_learned: dict[str, Potentials] = {}


def trained_by(spark: SparkSession) -> Potentials:
    """The same potentials, counted in tasks, once a session; of each part a few thousand numbers come to the driver."""
    app = spark.sparkContext.applicationId
    if app not in _learned:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.concatenate([x.ravel() for x in counted(part)]).tobytes()], pa.binary())], names=["part", "counts"])

        shapes = [x.shape for x in counted(0, 0)]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        rows = shipped(spark.range(PARTS).repartition(PARTS)).mapInArrow(run, "part long, counts binary").orderBy("part").collect()
        _learned[app] = learned([[x.reshape(s) for x, s in zip(np.split(np.frombuffer(r.counts), cuts), shapes)] for r in rows])
    return _learned[app]


def _labels(t: Tree) -> np.ndarray:
    """1 for nodes that the generator marked as content, and for what holds the parts of an article bare."""
    y = np.array([int(m == 1) for m in t.marked], np.int64)
    for i in range(1, len(y)):
        if y[i] and not t.marked[t.parent[i]] and t.tag[i] not in ("article", "main", "div"):
            y[t.parent[i]] = 1
    return y


def marginals(parent: np.ndarray, depth: np.ndarray, x: np.ndarray, model: Potentials) -> np.ndarray:
    """P(content) of each node of a forest, exactly: messages to the parents, deepest first, then back down."""
    unary = sum(model.unary[f][:, x[:, f]].T for f in range(x.shape[1]))
    unary = np.where((parent < 0)[:, None], unary + model.root, unary)
    inner = np.flatnonzero(parent >= 0)
    np.add.at(unary, parent[inner], model.child[x[parent[inner], 0], :, x[inner, 0]])
    pair = model.pair[x[:, 0], x[:, 1]]
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    inward, message = unary.copy(), np.zeros_like(unary)
    for nodes in reversed(levels[1:]):
        message[nodes] = np.logaddexp.reduce(pair[nodes] + inward[nodes][:, None, :], axis=2)
        np.add.at(inward, parent[nodes], message[nodes])
    belief = inward.copy()
    for nodes in levels[1:]:
        above = belief[parent[nodes]] - message[nodes]
        belief[nodes] = inward[nodes] + np.logaddexp.reduce(pair[nodes] + above[:, :, None], axis=1)
    belief -= belief.max(axis=1, keepdims=True)
    e = np.exp(belief)
    return e[:, 1] / e.sum(axis=1)


def extract(htmls: list[str | None], model: Potentials, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    trees = [parse(h or "") for h in htmls]
    parent, depth, start = [], [], [0]
    for t in trees:
        base = start[-1]
        for i, p in enumerate(t.parent):
            parent.append(p + base if p >= 0 else -1)
            depth.append(0 if p < 0 else depth[base + p] + 1)
        start.append(base + len(t.parent))
    p = marginals(np.array(parent, np.int64), np.array(depth, np.int64), np.concatenate([describe(t) for t in trees]), model) if trees else np.zeros(0)
    out = []
    for t, base in zip(trees, start):
        best = max((p[base + node] for node, _ in t.blocks), default=0.0)
        # a page without marks of any kind: the best parts, if they are at all likely
        limit = threshold if best > threshold else max(0.04, best / 2)
        out.append(" ".join(text for node, text in t.blocks if p[base + node] > limit))
    return out


def html_text(pages_: DataFrame, threshold: float = 0.5, html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """The pages with text and n_chars (code points).

    Blocks whose node is content with more than `threshold` are decoded, their white space made one space, trimmed, and
    joined by one space in page order; if no block reaches it, those with over half the best marginal, and over 0.04. Null, empty and textless pages: ''. Broken markup is read as browsers read it, near
    enough; any depth and length is read whole. Columns of the two names are replaced; others pass. Empty input: empty.
    """
    base = packed(pages_, html_col, beside=html_col)
    shared = pages_.sparkSession.sparkContext.broadcast(trained_by(pages_.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found = extract(b.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), b.column(1)][: 2 + keep_html], names=["_tz_row", "x", "h"][: 2 + keep_html])

    out = shipped(base).mapInArrow(run, row_and(base, "x string" + ", h string" * keep_html))
    raw = {html_col: F.col("h")} if keep_html else {}
    return unpacked(out, pages_, None if keep_html else html_col, **raw, text=F.col("x"), n_chars=F.char_length("x").cast("long"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"), keep_html=False).select("page_id", "url", "text", "n_chars")
