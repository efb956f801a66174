"""Main text of web pages by tag-path ratios.

1. A page is cut into text blocks. Inline elements do not end a block; other tags and ``<br>`` do. Each block has its
   root-to-leaf tag path. Elements that never hold the article (``OUTSIDE`` tags, and elements whose class, id or role
   says so) are passed over with all they contain.
2. Over all blocks of a path, text length and punctuation are added up and divided by the number of blocks: two ratios
   that are high for prose and low for menus and labels.
3. Along the page both ratios are smoothed with a Gaussian kernel and fused; blocks above the mean are content nodes.
4. The article is the innermost element that holds all content nodes but blocks of links; every block inside it is
   returned (a heading, a short paragraph among long ones or a list of links too). If only the body holds them all,
   blocks of links below the threshold are left out.

Character references are decoded and white space in a block becomes one space. Defined results: a null or empty page, or
one without text, gives an empty text; unclosed comments, scripts and elements run to the end of the page; repeated rows
are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logwarden.llm.columns import only

KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
PUNCTUATION = re.compile(r"[^\w\s]")
EXTRACTED = "page_id long, url string, text string"

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title noscript iframe template svg math object xmp noembed noframes"
OUTSIDE = frozenset("nav header footer aside form head button select dialog menu".split())
#: Words of a class, id or role that mark what is not the article.
LABELS = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
                   "menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment "
                   "comments disqus reply replies respond cookie cookies consent notice gdpr popup modal newsletter "
                   "subscribe signup login search share sharing social pagination pager copyright legal contentinfo "
                   "complementary toolbar skip".split())
#: Words that may stand beside those in a class name; with any other word (has-sidebar, no-comments) it marks nothing.
FILLERS = frozenset("site main page top bottom left right primary secondary list box area section container wrapper block "
                    "links items post bar global inner content".split())
#: Elements that end an open element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>])[^<>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:\"[^\"]{0,20000}\"|'[^']{0,20000}'|[^'\"<>])*+)>"
    r"|</?[a-zA-Z][^<>]*+>", re.DOTALL | re.IGNORECASE)
LABELLED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


def is_label(name: str) -> bool:
    """Whether a whole class name, id or role says that its element is not the article."""
    words = set(WORD.findall(name.lower()))
    return not words.isdisjoint(LABELS) and words <= LABELS | FILLERS


@dataclass
class Block:
    path: str
    inside: tuple[int, ...]  # the numbers of the open elements, outermost first
    text: str
    linked: int = 0  # characters inside links

    def is_links(self) -> bool:
        return 2 * self.linked > len(self.text)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, int, bool]] = field(default_factory=list)  # tag, number, passed over
    held: list[str] = field(default_factory=list)
    linked: int = 0

    def end_block(self) -> None:
        text = " ".join(html.unescape("".join(self.held)).split())
        if text:
            open_ = [e for e in self.stack if e[0] not in INLINE]
            self.blocks.append(Block("/".join(e[0] for e in open_), tuple(e[1] for e in open_), text, self.linked))
        self.held, self.linked = [], 0

    def passed_over(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def add(self, text: str) -> None:
        if text and not self.passed_over():
            self.held.append(text)
            if any(e[0] == "a" for e in self.stack):
                self.linked += len(text)

    def close(self, at: int) -> None:
        if any(e[0] not in INLINE for e in self.stack[at:]):
            self.end_block()
        del self.stack[at:]

    def start(self, tag: str, attrs: str, number: int) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.end_block()
            return
        if tag not in INLINE:
            self.end_block()
            ends = CLOSES.get(tag, set()) | {"p"}
            for at in range(len(self.stack) - 1, -1, -1):
                open_ = self.stack[at][0]
                if open_ in ends:
                    self.close(at)
                    break
                if open_ not in INLINE:
                    break
        labelled = any(is_label(name) for m in LABELLED.finditer(attrs) for name in (m[1] or m[2] or m[3] or "").split())
        outside = self.passed_over() or tag in OUTSIDE or (tag not in ("html", "body", "article", "main") and labelled)
        if not attrs.endswith("/"):
            self.stack.append((tag, number, outside))

    def end(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self.close(at)
                return


def blocks_of(page: str) -> list[Block]:
    state, at = Page(), 0
    for number, token in enumerate(TOKEN.finditer(page)):
        state.add(page[at:token.start()])
        at = token.end()
        if token["tag"]:
            tag = token["tag"].lower()
            if token["end"]:
                state.end(tag)
            else:
                state.start(tag, token["attrs"], number)
    state.add(page[at:])
    state.end_block()
    return state.blocks


def fused_ratios(blocks: list[Block]) -> np.ndarray:
    """For each block the smoothed text ratio of its path times the smoothed punctuation ratio, plus one."""
    totals: dict[str, np.ndarray] = {}
    for b in blocks:
        own = np.array([len(b.text), len(PUNCTUATION.findall(b.text)), 1.0])
        totals[b.path] = totals.get(b.path, 0) + own
    ratios = np.array([totals[b.path][:2] / totals[b.path][2] for b in blocks])
    norm = np.convolve(np.ones(len(blocks)), KERNEL, "full")[2:-2]
    text, marks = (np.convolve(r, KERNEL, "full")[2:-2] / norm for r in ratios.T)
    return text * (1 + marks)


def article(blocks: list[Block]) -> list[Block]:
    """The blocks of the innermost element that holds all content nodes."""
    if not blocks:
        return []
    score = fused_ratios(blocks)
    content = score >= score.mean() * (1 - 1e-9)
    nodes = [b for b, c in zip(blocks, content.tolist(), strict=True) if c]
    nodes = [b for b in nodes if not b.is_links()] or nodes
    around = [e for e in set.intersection(*(set(b.inside) for b in nodes)) if is_container(e, blocks)]
    inner = max(around, default=None)  # elements are numbered in page order, and these are nested
    if inner is None or all(tag in ("html", "body") for tag in path_to(inner, nodes[0])):
        return [b for b, c in zip(blocks, content.tolist(), strict=True)
                if (inner is None or inner in b.inside) and (c or not b.is_links())]
    return [b for b in blocks if inner in b.inside]


def path_to(element: int, block: Block) -> list[str]:
    """The tags of the elements from the root to ``element``, one of those around a block."""
    return block.path.split("/")[:block.inside.index(element) + 1]


def is_container(element: int, blocks: list[Block]) -> bool:
    """Whether an element is more than one paragraph: some block lies in an element inside it."""
    return any(element in b.inside[:-1] for b in blocks)


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in article(blocks_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 200):
                part = batch.slice(first, 200)
                texts = [main_text(page) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(work, EXTRACTED)
