"""Main text of a web page from a flat list of text blocks.

A page is cut into blocks at block-level tags. Each block has its word count and link
density (share of words inside links), those of the block before and after it, and
two marks from the elements around it: whether one of them is an article or main part,
and whether one of them is page furniture (by tag, class, id or role). A decision tree
trained on ``LABELLED`` says which blocks are main text.

Defined results: null or empty html gives an empty text; an unclosed comment, script
or style ends with the page; a tag that is never closed ends with the element around
it; an end tag without a start is ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ontomill.llm.common import slices

#: Labelled blocks: words, link density, the same of the block before and after, in an
#: article, in page furniture, main text.
LABELLED = (
    (1, 0, 12, 0, 40, 0, 1, 0, 1),
    (2, 0, 0, 0, 55, 0, 1, 0, 1),
    (6, 0, 3, 1.0, 80, 0.1, 1, 0, 1),
    (9, 1.0, 60, 0, 45, 0, 1, 0, 1),
    (4, 1.0, 35, 0.05, 50, 0, 1, 0, 1),
    (25, 0.3, 30, 0.1, 28, 0, 1, 0, 1),
    (60, 0.1, 9, 0, 70, 0.2, 1, 0, 1),
    (150, 0, 80, 0, 0, 0, 1, 0, 1),
    (12, 0.5, 40, 0, 3, 1.0, 1, 0, 1),
    (3, 0, 3, 1.0, 90, 0, 1, 0, 1),
    (30, 0, 2, 1.0, 2, 1.0, 1, 0, 1),
    (5, 0, 20, 0, 4, 0, 1, 0, 1),
    (1, 0, 1, 0, 1, 0, 1, 0, 1),
    (8, 0, 200, 0, 12, 0, 1, 0, 1),
    (14, 0.2, 5, 0, 6, 0, 1, 0, 1),
    (3, 0, 0, 0, 2, 0, 1, 0, 1),
    (40, 0, 10, 0, 8, 0.2, 1, 0, 1),
    (2, 0, 30, 0, 10, 0, 1, 0, 1),
    (7, 0, 6, 1.0, 7, 0, 1, 0, 1),
    (90, 0.05, 4, 0, 5, 1.0, 1, 0, 1),
    (5, 1.0, 40, 0, 4, 1.0, 1, 0, 0),
    (4, 1.0, 5, 1.0, 4, 1.0, 1, 0, 0),
    (6, 1.0, 4, 1.0, 60, 0, 1, 0, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0),
    (10, 0, 60, 0, 0, 0, 1, 0, 1),
    (2, 0, 2, 0, 1, 0, 1, 0, 1),
    (70, 0, 1, 0, 3, 0, 1, 0, 1),
    (4, 0, 90, 0, 5, 0, 1, 0, 1),
    (1, 0, 150, 0, 10, 0, 1, 0, 1),
    (300, 0, 6, 0, 4, 0, 1, 0, 1),
    (80, 0, 5, 0, 2, 0.5, 1, 0, 1),
    (20, 0, 0, 0, 0, 0, 1, 0, 1),
    (5, 0, 3, 1.0, 4, 0, 1, 0, 1),
    (6, 0.5, 8, 0, 5, 0, 1, 0, 1),
    (16, 0.4, 2, 0, 9, 1.0, 1, 0, 1),
    (100, 0.3, 3, 1.0, 2, 1.0, 1, 0, 1),
    (40, 0, 30, 0, 30, 0, 1, 1, 0),
    (8, 0, 60, 0, 70, 0, 1, 1, 0),
    (120, 0, 20, 0, 10, 0, 1, 1, 0),
    (3, 0.5, 2, 0.5, 50, 0, 1, 1, 0),
    (15, 0.1, 90, 0, 20, 0, 1, 1, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0),
    (1, 1.0, 0, 0, 1, 1.0, 0, 1, 0),
    (15, 0, 3, 1.0, 9, 0, 0, 1, 0),
    (60, 0, 40, 0, 40, 0, 0, 1, 0),
    (200, 0, 40, 0, 0, 0, 0, 1, 0),
    (10, 0, 150, 0, 0, 0, 0, 1, 0),
    (25, 0, 1, 1.0, 12, 0, 0, 1, 0),
    (4, 0, 6, 0, 30, 0, 0, 1, 0),
    (80, 0.2, 50, 0, 60, 0, 0, 1, 0),
    (30, 0, 80, 0, 70, 0.1, 0, 1, 0),
    (45, 0, 50, 0, 60, 0, 0, 0, 1),
    (30, 0.1, 25, 0, 35, 0.1, 0, 0, 1),
    (90, 0.2, 8, 0, 70, 0, 0, 0, 1),
    (18, 0, 40, 0, 30, 0, 0, 0, 1),
    (8, 0, 2, 1.0, 60, 0, 0, 0, 1),
    (6, 0, 45, 0, 52, 0, 0, 0, 1),
    (5, 0, 50, 0, 33, 0.1, 0, 0, 1),
    (70, 0, 0, 0, 3, 1.0, 0, 0, 1),
    (26, 0.1, 2, 1.0, 4, 0, 0, 0, 1),
    (40, 0, 5, 0, 3, 0, 0, 0, 1),
    (35, 0, 2, 1.0, 2, 0, 0, 0, 1),
    (28, 0.05, 3, 0, 8, 0, 0, 0, 1),
    (55, 0, 0, 0, 1, 0, 0, 0, 1),
    (33, 0.1, 3, 1.0, 5, 1.0, 0, 0, 1),
    (120, 0, 6, 0, 2, 1.0, 0, 0, 1),
    (31, 0.02, 60, 0, 0, 0, 0, 0, 1),
    (46, 0.15, 4, 0, 12, 1.0, 0, 0, 1),
    (2, 0, 40, 0, 31, 0, 0, 0, 1),
    (12, 0, 33, 0, 45, 0.1, 0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    (6, 0.9, 4, 1.0, 5, 0.8, 0, 0, 0),
    (20, 0.8, 15, 0.9, 10, 1.0, 0, 0, 0),
    (40, 0.7, 6, 1.0, 8, 1.0, 0, 0, 0),
    (7, 0, 4, 1.0, 3, 1.0, 0, 0, 0),
    (5, 0, 60, 0, 0, 0, 0, 0, 0),
    (9, 0.2, 50, 0, 3, 1.0, 0, 0, 0),
    (4, 0, 6, 0, 5, 0, 0, 0, 0),
    (2, 0, 3, 0, 6, 0.3, 0, 0, 0),
    (90, 0.8, 40, 0.5, 60, 0.6, 0, 0, 0),
    (3, 0, 20, 0.9, 80, 0, 0, 0, 0),
    (12, 0.6, 30, 0.7, 40, 0.8, 0, 0, 0),
    (6, 0, 8, 0.1, 7, 0, 0, 0, 0),
    (10, 0.9, 100, 0, 12, 0, 0, 0, 0),
    (150, 0.9, 10, 1.0, 12, 1.0, 0, 0, 0),
    (3, 0, 5, 0, 4, 0, 0, 0, 0),
    (8, 0.3, 2, 1.0, 6, 0.5, 0, 0, 0),
    (1, 0, 0, 0, 3, 0, 0, 0, 0),
    (9, 0, 2, 0, 0, 0, 0, 0, 0),
)

# Elements and names of the HTML standard and of common page templates.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|noembed|xmp"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div "
    "dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label "
    "legend li link main menu meta nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
FURNITURE_TAGS = frozenset(
    "aside button dialog footer form head header menu nav search select title".split()
)
MAIN_TAGS = frozenset(("article", "main"))
FURNITURE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner billboard breadcrumb breadcrumbs "
    "comment comments commentlist comentarios kommentare commentaires cookie cookies consent "
    "copyright disclaimer disqus footer form gdpr header login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pagination pager paywall "
    "popup promo promotion reader-comments related replies respond search share sharing sidebar "
    "signup skip-link social sponsor sponsored subscribe subscription tags toc toolbar tooltip "
    "topbar widget alert contentinfo complementary dialog".split()
)
MAIN_NAMES = frozenset(("articlebody", "main"))

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)"
    r"|<[!?][^<>]*>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^<>]*>.*?(?:</(?P=raw)(?=[\s/>])[^<>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'"<>])*+)>"""
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^<>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(
    r"""(?:^|\s)(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
    re.I,
)
_HIDDEN = re.compile(
    r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _marks(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element makes what it holds page furniture, or main text."""
    furniture = tag in FURNITURE_TAGS and not (tag == "header" and in_main)
    main = tag in MAIN_TAGS
    if attrs and tag not in ("html", "body"):
        for kind, *values in _NAMES.findall(attrs):
            value = "".join(values)
            if kind.lower() == "aria-label":
                continue
            for name in value.split():
                parts = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
                if kind.lower() == "itemprop" or kind.lower() == "role":
                    main = main or bool(parts & MAIN_NAMES)
                if parts & FURNITURE_NAMES and not main:
                    furniture = True
        furniture = furniture or bool(_HIDDEN.search(attrs))
    return furniture, main


def blocks_of(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks ``(text, words, words in links, in main, in furniture)`` in page order."""
    blocks: list[tuple[str, int, int, bool, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, in main, in furniture
    depth: Counter[str] = Counter()  # open elements by tag
    parts: list[str] = []
    link_parts: list[str] = []
    links = 0

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = html.unescape(" ".join(link_parts)).split()
            _, main, furniture = open_[-1] if open_ else ("", False, False)
            n = text.count(" ") + 1
            blocks.append((text, n, min(n, len(linked)), main, furniture))
        parts.clear()
        link_parts.clear()

    def push(tag: str, main: bool, furniture: bool) -> None:
        open_.append((tag, main, furniture))
        depth[tag] += 1

    def pop_to(tag: str) -> None:
        while depth[tag]:
            last = open_.pop()[0]
            depth[last] -= 1
            if last == tag:
                return

    for token in _TOKEN.finditer(page):
        text = token["text"]
        if text is not None:
            parts.append(text)
            if links:
                link_parts.append(text)
            continue
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue  # comments, declarations, scripts and the like
        tag = tag.lower()
        ends = token["end"] or token["end2"]
        if tag == "a":
            links = 0 if ends else 1
        elif tag in BLOCK_TAGS:
            close_block()
            if ends:
                pop_to(tag)
            elif tag not in VOID_TAGS:
                attrs = token["attrs"] or ""
                if open_ and open_[-1][0] == tag and tag in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):
                    pop_to(tag)  # its end tag may be left out
                _, main, furniture = open_[-1] if open_ else ("", False, False)
                own_furniture, own_main = _marks(tag, attrs, main)
                push(tag, main or own_main, furniture or own_furniture)
        elif not ends and tag not in VOID_TAGS and token["attrs"]:
            own_furniture, _ = _marks(tag, token["attrs"], False)
            if own_furniture:  # an inline element that is furniture holds a block of its own
                close_block()
                _, main, _ = open_[-1] if open_ else ("", False, False)
                push(tag, main, True)
        elif ends and depth[tag]:
            close_block()
            pop_to(tag)
    close_block()
    return blocks


def features(blocks: list[tuple[str, int, int, bool, bool]]) -> np.ndarray:
    """One row for each block: own, previous and next words and link density, marks."""
    words = np.array([b[1] for b in blocks], float)
    density = np.array([b[2] for b in blocks], float) / words
    edge = np.zeros(1)
    return np.column_stack(
        [
            words,
            density,
            np.concatenate([edge, words[:-1]]),
            np.concatenate([edge, density[:-1]]),
            np.concatenate([words[1:], edge]),
            np.concatenate([density[1:], edge]),
            np.array([b[3] for b in blocks], float),
            np.array([b[4] for b in blocks], float),
        ]
    )


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A classification tree by Gini impurity: a label, or (feature, limit, low, high).

    Of equal splits the one with the widest gap between the values wins.
    """
    if depth == 0 or labels.min() == labels.max():
        return int(2 * labels.sum() >= len(labels))
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        scale = values[-1] - values[0] or 1.0
        for low, high in zip(values[:-1], values[1:]):
            left = rows[:, f] <= (low + high) / 2
            impurity = sum(
                side.sum() * labels[side].mean() * (1 - labels[side].mean())
                for side in (left, ~left)
            )
            choice = (round(impurity, 9), -(high - low) / scale, f, (low + high) / 2)
            best = min(best, choice) if best else choice
    if best is None:
        return int(2 * labels.sum() >= len(labels))
    left = rows[:, best[2]] <= best[3]
    return (
        best[2],
        best[3],
        grow(rows[left], labels[left], depth - 1),
        grow(rows[~left], labels[~left], depth - 1),
    )


@lru_cache(maxsize=4)
def trained(labelled: tuple = LABELLED):
    data = np.array(labelled, float)
    return grow(data[:, :-1], data[:, -1])


def classify(tree, rows: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(rows), tree, bool)
    feature, limit, low, high = tree
    left = rows[:, feature] <= limit
    out = np.empty(len(rows), bool)
    out[left] = classify(low, rows[left])
    out[~left] = classify(high, rows[~left])
    return out


def main_text(page: str | None, tree=None) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    chosen = classify(tree or trained(), features(blocks))
    return " ".join(b[0] for b, keep in zip(blocks, chosen) if keep)


def extract(pages: DataFrame, labelled: tuple = LABELLED) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; nothing is shuffled.

    Null ids and urls and repeated rows stay as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained(labelled)
        for part in slices(batches):
            texts = [main_text(page, tree) for page in part.column(2).to_pylist()]
            yield pa.record_batch(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
