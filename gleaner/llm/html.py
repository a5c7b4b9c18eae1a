"""Operator 2: main text of web pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label, content or not. Emissions are the tag, the words of class and id, the
length, the end and the link share of the text; parent-child potentials give the odds that a child of a kind keeps its
parent's label. Messages pass once up and once down the tree, which gives the exact marginal of every node.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, table

TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)|[!?][^>]*(?:>|\Z))", re.S)
#: A name is taken whole, so a long run of letters without a value is read once.
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: Fixed values of HTML: elements without an end, with raw text, that break lines, and that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg object canvas math title".split())
#: Elements that an open paragraph does not reach into.
BORDER = frozenset("td th button article section div li".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDING = frozenset(t for pairs in (ENDS, HOLDS) for group in pairs.values() for t in group)


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    label: int = -1
    own: int = 0
    links: int = 0
    total: int = 0
    end: str = ""


@dataclass
class Page:
    """Nodes in page order (the parent first), and the page as a sequence of texts (node, text) and breaks (-1, '')."""

    nodes: list[Node] = field(default_factory=list)
    flow: list[tuple[int, str]] = field(default_factory=list)


def parse(text: str, labelled: bool = True) -> Page:
    """A tolerant reading of HTML: end tags may miss, a `<` that opens no tag is text, comments and raw elements go.

    The mark of content of a training page, `data-label` of 0 or 1, is read if `labelled`; other values are none.
    """
    page = Page([Node("#root", -1)])
    nodes, flow, stack, at = page.nodes, page.flow, [0], 0
    # For every open element: the depth of the paragraph, and of the elements of ENDS, that a child would end (0: none).
    # Both are looked up and never searched for, so that tags that never end cost no more than others.
    paragraph, ended, count = [0], [dict.fromkeys(ENDS, 0)], Counter()

    def close(depth: int) -> None:
        for k in stack[depth:]:
            count[nodes[k].tag] -= 1
        del stack[depth:], paragraph[depth:], ended[depth:]

    def add(piece: str) -> None:
        if "&" in piece:
            piece = entities.unescape(piece)
        if piece:
            flow.append((stack[-1], piece))

    while at < len(text):
        m = TAG.search(text, at)
        if m is None:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                flow.append((stack[-1], " "))
            if count[tag] > 0:  # what is passed over is closed, so each element is met once
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close(depth)
            if tag in BLOCK:
                flow.append((-1, ""))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
                at = end.end() if end else len(text)
            if tag in BLOCK:
                flow.append((-1, ""))
            continue
        if tag in BLOCK:
            flow.append((-1, ""))
            if paragraph[-1]:
                close(paragraph[-1])
        if depth := ended[-1].get(tag, 0):
            close(depth)
        if tag in VOID:
            flow.append((stack[-1], " ") if tag not in BLOCK else (-1, ""))
            continue
        node = Node(tag, stack[-1])
        if m[3]:
            attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m[3])}
            named = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".lower()
            node.words = tuple(sorted(set(re.findall(r"[a-z]+", named))))
            if labelled and (mark := attributes.get("data-label")) in ("0", "1"):
                node.label = int(mark)
        nodes.append(node)
        if not m[3].endswith("/"):
            depth = len(stack)
            stack.append(len(nodes) - 1)
            count[tag] += 1
            paragraph.append(depth if tag == "p" else 0 if tag in BORDER else paragraph[-1])
            now = ended[-1]
            if tag in ENDING:
                now = {t: depth if tag in ENDS[t] else 0 if tag in HOLDS.get(t, ()) else d for t, d in now.items()}
            ended.append(now)
    for k, piece in flow:
        if k >= 0 and (length := len(piece.strip())):
            nodes[k].own += length
            nodes[k].end = piece.rstrip()[-1:]
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        n.total += n.own
        if n.tag == "a":
            n.links = n.total
        if k:
            nodes[n.parent].total += n.total
            nodes[n.parent].links += n.links
    return page


def kind(tag: str) -> str:
    """Which potential ties a node to its parent: inline, paragraph-like, or a region of its own."""
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dd", "dt", "figcaption"):
        return "text"
    return "region" if tag in BLOCK else "inline"


def observed(n: Node) -> list[str]:
    share = n.links / n.total if n.total else 0.0
    out = [f"tag {n.tag}", f"length {min(8, n.own.bit_length())}", f"links {0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}"]
    if n.own:
        out.append(f"end {n.end in '.!?:;\"'}")
    return out + [f"word {w}" for w in n.words]


class TreeModel:
    """Counts of labelled nodes, smoothed, as potentials."""

    def __init__(self, pages: list[Page], smooth: float = 0.5) -> None:
        seen: dict[str, list[float]] = defaultdict(lambda: [smooth, smooth])
        moves: dict[tuple[str, int], list[float]] = defaultdict(lambda: [smooth, smooth])
        label_of = lambda n: max(n.label, 0)
        totals = [1.0, 1.0]
        for page in pages:
            for n in page.nodes[1:]:
                y = label_of(n)
                totals[y] += 1
                for name in observed(n):
                    seen[name][y] += 1
                moves[kind(n.tag), label_of(page.nodes[n.parent])][y] += 1
        self.odds = {k: math.log(v[1] / totals[1]) - math.log(v[0] / totals[0]) for k, v in seen.items()}
        self.moves = {k: (v[0] / sum(v), v[1] / sum(v)) for k, v in moves.items()}

    def move(self, n: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        return self.moves.get((kind(n.tag), 0), (0.9, 0.1)), self.moves.get((kind(n.tag), 1), (0.1, 0.9))

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node, by one pass up and one down. Messages are scaled to sum 1."""
        nodes = page.nodes
        count = len(nodes)
        up0, up1, to0, to1 = [1.0] * count, [1.0] * count, [1.0] * count, [1.0] * count
        up1[0] = 1e-6  # the root is no content
        steps = [self.move(n) for n in nodes]
        for k in range(count - 1, 0, -1):
            n = nodes[k]
            ratio = math.exp(max(-12.0, min(12.0, sum(self.odds.get(name, 0.0) for name in observed(n)))))
            a, b = up0[k], up1[k] * ratio
            up0[k], up1[k] = a / (a + b), b / (a + b)
            s0, s1 = steps[k]
            to0[k] = s0[0] * up0[k] + s0[1] * up1[k]
            to1[k] = s1[0] * up0[k] + s1[1] * up1[k]
            p = n.parent
            a, b = up0[p] * to0[k], up1[p] * to1[k]
            up0[p], up1[p] = a / (a + b), b / (a + b)
        belief = [0.0] * count
        down0, down1 = [1.0] * count, [1.0] * count
        for k in range(count):
            a, b = down0[k] * up0[k], down1[k] * up1[k]
            belief[k] = b / (a + b)
            if k + 1 < count:
                n, p = nodes[k + 1], nodes[k + 1].parent
                a, b = down0[p] * up0[p] / to0[k + 1], down1[p] * up1[p] / to1[k + 1]
                s0, s1 = steps[k + 1]
                x, y = a * s0[0] + b * s1[0], a * s0[1] + b * s1[1]
                down0[k + 1], down1[k + 1] = x / (x + y), y / (x + y)
        return belief


def labelled_page(rng: random.Random) -> str:
    """One labelled page: `data-label` 1 marks content. Layouts, names and lengths are drawn; texts are invented."""
    word = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    words = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: words(rng.randint(1, 25)).capitalize() + "."
    prose = lambda: " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 9))))

    def el(tag: str, body: str, y: int = 0, name: str = "") -> str:
        attribute = rng.choice(("class", "id")) if name else ""
        return f"<{tag} data-label=\"{y}\"" + (f' {attribute}="{name}"' if name else "") + f">{body}</{tag}>"

    def link(y: int = 0) -> str:
        return f'<a data-label="{y}" href="/{word()}">{words(rng.randint(1, 4))}</a>'

    def menu(name: str = "") -> str:
        items = "".join(el("li", link()) for _ in range(rng.randint(3, 9)))
        return el(rng.choice(("nav", "nav", "div")), el("ul", items), 0, name or rng.choice(("", "menu", "nav", "navbar", "main-menu", "breadcrumbs")))

    def paragraph() -> str:
        text = prose()
        if rng.random() < 0.3:
            text = el(rng.choice(("b", "i", "em", "strong", "span")), text, 1)
        if rng.random() < 0.2:
            text += " " + link(1) + " " + sentence()
        return el("p", text, 1)

    def article() -> str:
        parts = [el(rng.choice(("h1", "h1", "h2")), words(rng.randint(1, 9)), 1)] if rng.random() < 0.9 else []
        for _ in range(rng.choice((1, 2, 5, 12))):
            draw = rng.random()
            if draw < 0.8:
                parts.append(paragraph())
            elif draw < 0.87:
                parts.append(el(rng.choice(("h2", "h3")), words(rng.randint(1, 6)), 1))
            elif draw < 0.92:
                parts.append(el(rng.choice(("ul", "ol")), "".join(el("li", sentence(), 1) for _ in range(rng.randint(2, 5))), 1))
            elif draw < 0.95:
                parts.append(el("blockquote", el("p", prose(), 1), 1))
            elif draw < 0.97:
                parts.append(el("table", el("tr", el("td", words(2), 1) + el("td", words(2), 1), 1), 1))
            else:
                parts.append(advert())
        name = rng.choice(("content", "post", "entry-content", "article-body", "story", "main-text", "post-body"))
        shape = rng.random()
        if shape < 0.6:
            return el("article", "".join(parts), 1, rng.choice(("", "", name)))
        if shape < 0.8:
            return el("main", el("div", "".join(parts), 1, name), 1)
        return el("div", "".join(parts), 1, name)

    def advert() -> str:
        text = rng.choice((prose(), link(), el("p", sentence()), el("span", words(4)) + link()))
        return el(rng.choice(("div", "div", "aside", "section")), text, 0, rng.choice(("ad", "ads", "advert", "banner", "promo", "sponsored", "advertisement", "ad-box")))

    def notice() -> str:
        return el("div", el("p", prose()) + el("button", words(1)), 0, rng.choice(("cookie-notice", "notice", "consent", "alert", "newsletter", "popup", "subscribe", "cookie-banner")))

    def sidebar() -> str:
        items = "".join(el("li", link() + rng.choice(("", " " + words(6)))) for _ in range(rng.randint(2, 6)))
        return el(rng.choice(("aside", "aside", "div")), el("h3", words(2)) + rng.choice((el("ul", items), el("p", prose()))), 0, rng.choice(("sidebar", "widget", "related", "side", "rail")))

    def comments() -> str:
        one = lambda: el(rng.choice(("div", "li", "article")), el("p", prose()) + rng.choice(("", el("span", words(2), 0, "author"))), 0, rng.choice(("comment", "reply", "comment-body")))
        return el(rng.choice(("section", "div")), rng.choice(("", el("h3", words(2)))) + "".join(one() for _ in range(rng.randint(1, 5))), 0, rng.choice(("comments", "responses", "discussion", "comment-list", "comments-area")))

    def form() -> str:
        return el("form", el("label", words(2)) + "<input type=text>" + el("button", words(1)) + rng.choice(("", el("p", sentence()))), 0, rng.choice(("", "search", "signup", "login")))

    top = el("header", rng.choice((words(2), el("p", sentence()), el("h1", words(2)))) + rng.choice(("", menu())), 0, rng.choice(("", "header", "masthead", "site-header")))
    bottom = el(rng.choice(("footer", "footer", "div")), rng.choice((f"&copy; {words(2)} {sentence()}", el("p", sentence()), link() + link())), 0, rng.choice(("footer", "copyright", "site-footer")))
    blocks = [f() for f, p in ((lambda: top, 0.5), (menu, 0.8), (advert, 0.5), (notice, 0.3), (form, 0.2), (sidebar, 0.2)) if rng.random() < p]
    blocks.append(article())
    blocks += [f() for f, p in ((sidebar, 0.4), (comments, 0.4), (form, 0.2), (advert, 0.3), (notice, 0.2), (lambda: bottom, 0.9)) if rng.random() < p]
    body = "".join(blocks)
    return f"<!DOCTYPE html><html><head><title>{words(5)}</title></head><body>{body}</body></html>"


def trained(pages: int = 600, seed: int = 7) -> TreeModel:
    """The model, trained from `pages` labelled pages (a bound that does not depend on the input)."""
    rng = random.Random(seed)
    return TreeModel([parse(labelled_page(rng)) for _ in range(pages)])


def main_text(text: str | None, model: TreeModel, cut: float = 0.5) -> str:
    if not text:
        return ""
    page = parse(text, labelled=False)
    keep = [b >= cut for b in model.marginals(page)]
    blocks, now = [], []
    for k, piece in [*page.flow, (-1, "")]:
        if k >= 0:
            if keep[k]:
                now.append(piece)
        elif now:
            if line := " ".join("".join(now).split()):
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """Add `text`, the main text of every page, and `n_chars`, its code points.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one line end; the whole html is read. Null or empty html and pages without content give an empty text. Tags that
    never end, unknown tags and broken references are taken as browsers take them, roughly, and never fail. Repeated
    rows get equal results; columns of the names `text` and `n_chars`, in any case, are replaced. There is no shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    names = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    source = free_names(pages, "_html")[0]
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.col(html_col).cast("string").alias(source))
    place = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                cut = batch.slice(at, 128)
                texts = [main_text(h.as_py(), shared.value) for h in cut.column(place)]
                columns = [*cut.columns[:place], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:place])
    return rows.mapInArrow(run, f"{schema}{', ' if names else ''}text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")
