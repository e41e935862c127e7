"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each on a path of tags from the root. Over all blocks
of one path the characters and punctuation marks per block are summed, both ratios are
smoothed along the order in which the paths occur, and fused by their product. Paths
above a share of the standard deviation are content, and so are their blocks. The
article is the innermost element that holds most of the content: what it keeps is its
content blocks, all that lies between them, and its headings, paragraphs, list items
and cells. What markup declares to be something else (menus, headers, footers, sidebars,
notices, adverts, forms, comments) and paths made of links are left out; an element that
markup declares to be the article is kept whole otherwise.

Elements are numbered nodes that know their parent, blocks know their node, and sums go
up node by node, so the time for a page grows with its length however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the standard deviation of the fused ratio above which a path is content.
CUT = 0.5
#: Weights of a path and of its neighbours to either side when ratios are smoothed.
KERNEL = np.array([0.1, 0.8, 0.1])
#: An element holds most of the content from this share of its characters.
LEAD = 0.7
#: Share of link text from which a path is a list of links.
LINKS = 0.6

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_STYLE_NONE = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
                   "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption summary".split())
NOT_CONTENT = frozenset("head title nav footer aside form fieldset button select option menu dialog search label".split())
CLOSES_P = BLOCKS - frozenset("body html head title option optgroup legend summary caption td th tr tbody thead tfoot".split())
#: An element that ends when one of these begins inside the same parent.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
            "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
SCOPES = frozenset("ul ol dl menu table td th select article section main div body html".split())
#: Words in a class, an id or a role that declare something other than the article.
DECLARED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs header masthead topbar footer bottombar contentinfo sidebar aside complementary widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus replies respond share "
    "sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination "
    "pager skip toolbar form".split())
ARTICLES = frozenset("article main".split())


ENDS = {tag: frozenset(t for t, enders in ENDED_BY.items() if tag in enders) for enders in ENDED_BY.values() for tag in enders}
CELLS = frozenset("td th".split())


@dataclass
class Block:
    """A run of text between block tags, in element ``node`` on path ``path``."""

    node: int
    path: int
    declared: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Block elements in the order they begin (0 is the page), their paths, and the blocks."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)

    def open(self, parent: int, tag: str) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(self.numbers.setdefault((self.paths[parent], tag), len(self.numbers) + 1))
        return len(self.tags) - 1


def _declared(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether markup says that an element is not the article."""
    if tag in NOT_CONTENT or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and "true" in value:
            return True
        if name.lower() in ("class", "id", "role") and DECLARED.intersection(re.split(r"[^a-z0-9]+", value.lower())):
            return tag not in ARTICLES
    return bool(_STYLE_NONE.search(attributes))


class _Stack:
    """The open elements, and where the last of each kind is, so that none is searched for."""

    def __init__(self):
        self.open: list[tuple[str, int, bool]] = []  # tag, node, whether it is declared to be something else
        self.at: dict[str, list[int]] = {}
        self.left_out = 0

    def last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self.at.get(t))), default=-1)

    @property
    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def push(self, tag: str, node: int, declared: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, declared))
        self.left_out += declared

    def close(self, n: int) -> None:
        """Takes elements off until ``n`` are left."""
        while len(self.open) > n:
            tag, _, declared = self.open.pop()
            self.at[tag].pop()
            self.left_out -= declared


def read_page(html_text: str) -> Page:
    """The elements and blocks of a page, in order."""
    page, stack, block, at = Page(), _Stack(), None, 0

    def text(part: str) -> None:
        nonlocal block
        if not part or block is None and part.isspace():
            return
        out = stack.left_out > 0
        if block is not None and out and not block.declared:
            return  # an inline element inside a block
        if block is None or block.declared != out:
            block = Block(stack.node, page.paths[stack.node], out)
            page.blocks.append(block)
        block.parts.append(part)
        if stack.at.get("a"):
            block.linked += len(part.strip())

    for m in _TOKEN.finditer(html_text):
        text(html_text[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if not m[0].startswith("<!--"):
                text(" ")
            continue
        if tag in BLOCKS:
            block = None
        elif tag == "br" and block:
            text(" ")
        if m[2]:
            found = stack.last((tag,))
            if found >= 0 and (tag in BLOCKS or stack.last(BLOCKS) < found):
                stack.close(found)
            continue
        if tag in CLOSES_P and (p := stack.last(("p",))) > stack.last(SCOPES):
            stack.close(p)
        if tag in ENDS:
            scopes = SCOPES - CELLS if tag in ("td", "th", "tr") else SCOPES
            if (ended := stack.last(ENDS[tag])) >= max(0, stack.last(scopes)):
                stack.close(ended)
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        node = page.open(stack.node, tag) if tag in BLOCKS else stack.node
        stack.push(tag, node, _declared(tag, m[4], any(stack.at.get(t) for t in ARTICLES)))
    text(html_text[at:])
    for b in page.blocks:
        joined = "".join(b.parts)
        b.text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
    page.blocks = [b for b in page.blocks if b.text]
    return page


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """The smoothed and fused ratio of every path, in the order in which paths occur."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        row = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        row[0] += 1
        row[1] += len(b.text)
        row[2] += len(_PUNCTUATION.findall(b.text))
    table = np.array(list(sums.values()))
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), KERNEL, mode="valid")
    fused = smooth(table[:, 1] / table[:, 0]) * smooth(table[:, 2] / table[:, 0] + 0.1)
    return dict(zip(sums, fused.tolist(), strict=True))


def content_paths(ratios: dict[int, float]) -> set[int]:
    """Paths above the threshold; where all are alike, all."""
    cut = CUT * float(np.std(list(ratios.values())))
    return {p for p, r in ratios.items() if r >= cut}


def link_paths(page: Page) -> set[int]:
    """Paths whose text is mostly links, headings apart."""
    linked, length = defaultdict(int), defaultdict(int)
    for b in page.blocks:
        linked[b.path] += min(b.linked, len(b.text))
        length[b.path] += len(b.text)
    inside = [False] * len(page.tags)  # a heading
    headed = {}
    for k in range(1, len(page.tags)):
        inside[k] = inside[page.parents[k]] or page.tags[k] in HEADINGS
        headed[page.paths[k]] = inside[k]
    return {p for p in length if linked[p] > LINKS * length[p] and not headed.get(p)}


def _container(page: Page, weights: dict[int, float]) -> int:
    """The innermost element that holds most of the page's weight."""
    sums = [0.0] * len(page.tags)
    for node, weight in weights.items():
        sums[node] += weight
    heaviest = [0] * len(page.tags)
    for k in range(len(page.tags) - 1, 0, -1):  # children begin after their parents
        parent = page.parents[k]
        sums[parent] += sums[k]
        if page.tags[k] not in LEAVES and (not heaviest[parent] or sums[k] >= sums[heaviest[parent]]):
            heaviest[parent] = k
    node = 0
    while heaviest[node] and sums[0] > 0 and sums[heaviest[node]] >= LEAD * sums[0]:
        node = heaviest[node]
    return node


def main_text(html_text: str | None) -> str:
    """The article of a page: its blocks, white space within them made one space, joined by line feeds."""
    page = read_page(html_text or "")
    if not page.blocks:
        return ""
    content, links = content_paths(path_ratios(page.blocks)), link_paths(page)
    plain = [b for b in page.blocks if not b.declared]
    kept = [b for b in plain if b.path not in links] or plain
    chosen = {id(b) for b in kept if b.path in content} or {id(b) for b in kept}  # what is left where all content is declared
    weights: dict[int, float] = defaultdict(float)
    for b in kept:
        if id(b) in chosen:
            weights[b.node] += len(b.text)
    top = _container(page, weights)
    inside, leaf, article = ([False] * len(page.tags) for _ in range(3))
    for k, tag in enumerate(page.tags):
        parent = page.parents[k]
        inside[k] = k == top or k > 0 and inside[parent]
        leaf[k] = k > 0 and (leaf[parent] or tag in LEAVES)
        article[k] = tag in ARTICLES or k > 0 and article[parent]
    held = [b for b in kept if inside[b.node]]
    places = [i for i, b in enumerate(held) if id(b) in chosen]
    if not article[top]:  # no element says it is the article: around the content stay only text elements
        held = [b for i, b in enumerate(held) if places[0] <= i <= places[-1] or leaf[b.node] or article[b.node]]
    return "\n".join(b.text for b in held)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    A null page is an empty one, whose text is empty. Pages are read whole; repeated
    rows stay; ids and urls are passed on as they are.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, schema)
