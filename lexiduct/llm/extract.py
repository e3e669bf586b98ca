"""HTML main-text extraction: flat text blocks classified by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  A block's
features are its words and link density, those of the blocks before and behind it,
and what it stands in (article, navigation, a form, a container named like an advert
or a comment list ...).  A small decision tree, grown from the labelled pages below,
keeps or drops each block; the kept blocks, in page order, are the text.
"""

from __future__ import annotations

import html as html_lib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
) - {"br"}
DROPPED = frozenset("script style noscript template svg math iframe object canvas textarea select audio video title head".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol search section table td th tr ul button li p h1 h2 h3 h4 h5 h6 figcaption label a span".split())
#: Elements whose end tag is often left out, closed by the next block of the same kind.
LOOSE = frozenset("p li td th tr dd dt option".split())
BOILER_TAGS = frozenset("nav header footer aside form menu button dialog fieldset search label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name boilerplate, and those that name reader comments or the article.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsoring promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot copyright sidebar side aside widget related recommended recommendations more share sharing social follow subscribe subscription newsletter signup login cookie cookies consent gdpr notice notices notification alert popup modal overlay form search pagination pager tags tag toolbar legal disclaimer contentinfo complementary skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond reader responses".split())
MAIN_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

VARIANTS = 12  # pages from a line of the labelled table
LEAST_BLOCKS = 12  # on either side of a split of the tree

FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "in_article", "boiler", "comment", "heading", "list_item", "sentence", "main_name")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_article: bool
    boiler: bool
    comment: bool
    heading: bool
    list_item: bool
    main_name: bool


def _named(tag: str) -> tuple[bool, bool, bool, bool]:
    """Whether a tag's class, id or role names boilerplate, comments, the article; whether it hides."""
    words: set[str] = set()
    hidden = False
    for key, value in _ATTR.findall(tag):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            for part in _SPLIT.split(value):
                words.add(part.lower())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return bool(words & BOILER_WORDS), bool(words & COMMENT_WORDS), bool(words & MAIN_WORDS), hidden


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a whole page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, boiler, comment, article, main name
    text: list[str] = []
    linked: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            s = _SPACE.sub(" ", html_lib.unescape("".join(text))).strip()
            if s:
                tags = [x[0] for x in stack]
                out.append(
                    Block(
                        s,
                        s.count(" ") + 1,
                        min(s.count(" ") + 1, len(html_lib.unescape(" ".join(linked)).split())),
                        any(x[3] for x in stack),
                        any(x[1] for x in stack),
                        any(x[2] for x in stack),
                        any(t in HEADINGS for t in tags),
                        "li" in tags,
                        any(x[4] for x in stack),
                    )
                )
            text, linked = [], []

    pos, skip = 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < pos:
            continue
        if skip is None and m.start() > pos:
            piece = page[pos : m.start()]
            text.append(piece)
            if links:
                linked.append(piece)
        pos = m.end()
        tag = m.group()
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag).group(1).lower()
        if tag[1] == "/":
            if name in BLOCK_TAGS:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in DROPPED and not tag.endswith("/>"):
            if name in BLOCK_TAGS:
                flush()
            # The element's end, whatever lies between; one that never ends takes the rest.
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            if name == "head" and end is None:
                end = re.compile(r"<body\b", re.I).search(page, pos)
                pos = end.start() if end else len(page)
            else:
                pos = end.end() if end else len(page)
            if name == "head":
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
        if name in VOID or tag.endswith("/>"):
            continue
        if name == "a":
            links += 1
        if name in LOOSE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "table", "div", "section", "article", "dl", "select"):
                    break
        if name in CONTAINERS:
            boiler, comment, main_name, hidden = _named(tag) if len(tag) > len(name) + 2 else (False,) * 4
            # A header of the article itself holds its headline.
            own = name in BOILER_TAGS and not (name == "header" and any(x[0] == "article" for x in stack))
            if name == "body" or name in HEADINGS:
                boiler = False
            stack.append((name, own or hidden or boiler, comment, name in ("article", "main"), main_name))
    if pos < len(page):
        text.append(page[pos:])
        if links:
            linked.append(page[pos:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    dens = np.array([b.linked / b.words for b in blocks], float)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]] if k < 0 else [v[1:], [0.0]]) if n else v
    flags = [[float(b.in_article), float(b.boiler), float(b.comment), float(b.heading), float(b.list_item), float(b.text[-1] in ".!?:\"”»"), float(b.main_name)] for b in blocks]
    return np.column_stack([words, dens, shift(words, -1), shift(dens, -1), shift(words, 1), shift(dens, 1), np.array(flags, float).reshape(n, 7)])


# ---- the decision tree ------------------------------------------------------------------


@dataclass
class Node:
    keep: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = LEAST_BLOCKS) -> Node:
    """A CART tree by Gini impurity; of equal splits the first feature wins."""
    node = Node(float(y.mean()))
    if depth == 0 or node.keep in (0.0, 1.0) or len(y) < 2 * least:
        return node
    best = (1e-12, -1, 0.0)
    base = len(y) * 2 * node.keep * (1 - node.keep)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)
        k = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (k >= least) & (len(y) - k >= least)
        if not ok.any():
            continue
        pl, pr = left[:-1] / k, (left[-1] - left[:-1]) / (len(y) - k)
        gain = base - 2 * (k * pl * (1 - pl) + (len(y) - k) * pr * (1 - pr))
        gain[~ok] = -1
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-9:
            best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    if best[1] < 0:
        return node
    node.feature, node.cut = best[1], best[2]
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def decide(tree: Node, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.low is None:
            out[rows] = node.keep >= 0.5
        elif len(rows):
            low = x[rows, node.feature] <= node.cut
            todo += [(node.low, rows[low]), (node.high, rows[~low])]
    return out


# The labelled table, one page a line.  A part is `tag.class: blocks`, parts may nest by
# `tag.class > tag.class: blocks`, and parts are parted by `|`.  A block is + (main text)
# or - (all else), its element (p where none is named, li, h2, h3, td, div ...) and its
# number of words; /n says that the last n of them are a link.  No name tells anything
# about most of these pages: blocks are told by their words and links, and by those around.
LABELLED_PAGES = """
div: -div1/1 -div1/1 -div2/2 -div1/1 | div: +h26 +31 +44 +18 +52 | div: -div3/3 -div4/4 -div2
div: -div2/2 -div1/1 -div3/3 | div: +h24 +24 +4 +37 +3 +41 | div: -div5/5 -div6/6
div: -4/1 -3/2 | div: +h25 +60 +26 +9 +33 | div: -6/3 -7/3 -5/2
div: -div3 -div1/1 -div1/1 | div: +22 +2 +47 +29/4 +38 | div: -div8/8 -div7/7 -div9/9 -div3
div: -li1/1 -li2/2 -li1/1 -li1/1 | div: +h27 +35 +li5 +li8 +li6 +40 | div: -li6/6 -li4/4 -li7/7
div: -div2/1 -div2/2 | div: +h23 +19 +58/6 +27/9 +5 +36 | div: -div4 -div2/2 -div2/2
div: -div1/1 -div1/1 | div: +16 +14 +21 | div: -div3/2 -div2/1
div: -div2 -div1/1 -div3/2 | div: +45 +6 +51 | div: -div5 -div4/4 -div3
section: -li1/1 -li1/1 -li2/2 | section: +h24 +28 +33 +7 +64 | section: -3 -li8/8 -li9/9 -li11/11 -li7/7
div: -div6/6 | div: +h28 +70 +12 +41 +15 | div: -div2 -div10/10 -div12/12 -div9/9
div: -div1/1 -div1/1 -div1/1 -div1/1 | div: +h25 +20 +3 +2 +34 | div: -div6/2 -div4/2
div: -p2/2 -p3/3 | div: +55 +48 +61 +30 | div: -p2/2 -p1/1 -p4
div: -div3 -div2 -div4/1 | div: +h26 +42 +37 +39 | div: -div2 -div3 -div1/1
div: -div4 -div6/5 -div7/6 -div5/4 | div: +h24 +26 +5 +46 +18 | div: -div3 -div7/5 -div8/6
p: -1/1 -1/1 -2/2 | p: +40 +3 +56 +28 | p: -2/2 -3/3
td: -td1/1 -td2/2 -td1/1 | td: +p38 +p6 +p45 +p27 | td: -td4 -td2/2 -td3/3
nav: -li1/1 -li1/1 -li2/2 -li1/1 | div.ad: -9 | article: +h27 +34 +2 +41 +6 | footer: -11
nav: -li1/1 -li1/1 | div.ad: -12 | article: +h25 +2 | footer: -14
nav: -li2/2 -li1/1 -li1/1 | article: +h24 +3 +5 +2 | footer: -6
nav: -li1/1 -li3/3 | article: +h29 +8 | aside: -22 -7/7 | footer: -9
article: +h22 +1
article: +h26 +12/12 +30 +9/9 +2 +li4/4 +li3/3 +26 | footer: -10/3
article: +3 +4/4 +18 +7/7 +1
main: +h25 +23 +2 +38/5 +li3 +li5 | aside: -5 -9/9 | footer: -13/2
main: +h24 +4 | div.newsletter: -14 | footer: -8
header: -4 | main: +h26 +27 +3 +div5 +44 | div.sidebar: -18 -6/6 -25 | footer: -16
header: -3 -li1/1 | article > header: +h25 +6 | article: +29 +4 +36 | article > footer: -7 | footer: -9
header: -5 -9 | article > div.share: -1/1 -2/2 | article: +h27 +31 +2 | article > div.promo: -13 -21 | article: +40 +5 | footer: -20
article: +h25 +26 +7 | section.comments: -h32 -30 -2 -24 -3 | footer: -9
article: +h24 +44 +2 +38 | div#comments: -18 -1 -52 -7 | footer: -5
main: +h24 +35 +20 | main > div.comment-list: -27 -4 -40 -12
article: +h25 +33 | article > section.replies: -22 -3 -31 | footer: -7
div.cookie-notice: -24 -1 | article: +h26 +19 +2 +33 | footer: -8
div.alert: -13 | main: +h24 +3 +17 | footer: -9
div.banner: -34 | article: +h23 +41 +5 | footer: -30
div.modal: -28 -2 | div: +h25 +37 +29 +46 | div.footer: -19
div.content: +h25 +36 +2 +5 +29 | div.sidebar: -31 -4 -5/5 | div.footer: -22 -15
div.post: +h26 +3 +41 | div.related: -3 -8/8 -11/11 | div.comments: -44 -2 -16
div.entry: +h24 +25/3 +6 | div.widget: -16 -23 | form: -9 -2
form: -8 -3 | article: +h24 +17 +28 +4 | form: -21 -2
div.menu: -2/2 -1/1 -3 -5 | div: +50 +36 +43 | div.advert: -15 -26
aside: -33 -40 | article: +h25 +48 +9 +2 | aside: -28 -3
nav: -7 -12 -3 | article: +h24 +22 +14 | nav: -9 -2/2
main: +h26 +td1 +td2 +td1 +td3 +40 | footer: -12/1
article: +h25 +1 +1 +2 +3 +2 +24 | footer: -7/7 -2/2
article: +h24 +30 +10
article: +h22 +3 +14
article: +40 +18 +6
article: +h24 +27 +3 +21/6 +2 +34/11 +1 | footer: -11
main: +h23 +2 +14/5 +3 +19/19 +26 | footer: -5/5 -3/3 -6/6
main: +26 +li2/2 +li1/1 +li3/3 +31 +2 | div: -2/2 -1/1
article: +h24 +12 +li1/1 +li2/2 +9 | div: -3 -1/1
nav: -li1/1 -li1/1 -li1/1 -li1/1 -li1/1 -li1/1 | div.ad: -8 | article: +h28 +45 +52 +2 +61 +4 +33 | footer: -16
nav: -li1/1 -li1/1 -li1/1 -li1/1 -li1/1 -li1/1 | div.ad: -10 | article: +h22 +7 | footer: -12
nav: -li1/1 -li2/2 | div.ad: -7 | article: +h26 +19 +1
div: -div1/1 -div2/2 -div1/1 | div: +h24 +44 +2 +1 +39 +8/3 +50 | div: -div2/2 -div1/1
div: -2/2 -1/1 -1 | div: +33 +4 +29 +7/2 +35 | div: -4 -2 -1/1
main: +h25 +12 +5 | div: -9 -5/5 -4
div: -6 -3/3 -2/2 | article: +h24 +16 +3 +28 +11 | div: -14 -6/6 -3
main: +11 +2 +h23 +20 +6 +h22 +4 +18
div: -div1/1 -div2/2 -div1 | div: +38 +3 +41 +29 | div: -div3/3 -div2
div: -td2/2 -td1/1 -td2 | div: +44 +2 +27 | p: -2/2 -3
div: -div1/1 -div1 | div: +31 +35 +4 +48 | div: -div4/4 -div1
p: -2/2 -1 | p: +29 +1 +52 +2 +37 | p: -3/3 -2
div: +div33 +div27 +div45
div: +3 +40 +2 +36
div: -div1/1 -div2/2 | div: +2 +43 +3 +39 | div: -div2/2
div: +38 +2 | div.disclaimer: -36
"""


def _sentence(n: int, k: int) -> str:
    """n words that differ from block to block."""
    return " ".join(chr(97 + (k * 7 + i * 3) % 26) * (1 + (k + i) % 6) for i in range(n)) + "."


def labelled_pages(variants: int = VARIANTS) -> list[tuple[str, list[bool]]]:
    """The labelled pages as HTML, and for each of their blocks whether it is main text.
    Each line gives several pages, whose blocks are from half to twice as long as it says."""
    out, k = [], 0
    for line, turn in itertools.product(LABELLED_PAGES.strip().splitlines(), range(variants)):
        page, marks = [], []
        for part in line.split("|"):
            path, blocks = part.split(": ")
            ends = []
            for step in path.split(">"):
                tag, _, name = step.strip().replace("#", ".").partition(".")
                ends.append(f"</{tag}>")
                page.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
            for block in blocks.split():
                mark, tag, n, _, link = _BLOCK.match(block).groups()
                k += 1
                # Of the golden ratio's multiples, the fractions are spread evenly.
                size = max(1, round(int(n) * 2 ** (2 * (k * 0.6180339887 % 1) - 1))) if turn else int(n)
                link = round(size * int(link or 0) / int(n))
                words = _sentence(size, k).split()
                inner = " ".join(words[: size - link]) + (f" <a href=x>{' '.join(words[size - link :])}</a>" if link else "")
                page.append(f"<{tag or 'p'}>{inner}</{tag or 'p'}>")
                marks.append(mark == "+")
            page += reversed(ends)
        out.append(("".join(page), marks))
    return out


_BLOCK = re.compile(r"([+-])(h[1-6]|[a-z]*)(\d+)(/(\d+))?$")


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    xs, ys = [], []
    for page, marks in labelled_pages():
        found = blocks_of(page)
        if len(found) != len(marks):
            raise ValueError(f"a labelled page has {len(found)} blocks and {len(marks)} marks: {page}")
        xs.append(features(found))
        ys.append(np.array(marks, float))
    return np.concatenate(xs), np.concatenate(ys)


def train_tree() -> Node:
    return grow(*labelled_table())


def main_text(page: str, tree: Node) -> str:
    found = blocks_of(page)
    keep = decide(tree, features(found)) if found else []
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """For pages (page_id, url, html; other columns are ignored): page_id, url, text, n_chars
    (code points), one row for each row.  A null or empty html, and a page without a kept
    block, gives the empty text.  Whole pages are read and nothing is capped."""
    tree = tree or train_tree()

    def run(batches):
        for b in batches:
            text = [main_text(h, tree) if h else "" for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
