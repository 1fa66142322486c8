"""Operator 6: main text of pages from flat text blocks and a decision tree.

The page is cut into blocks at block-level markup. A block is a row of numbers:
its words and link density, the same of the blocks before and after it, whether
it stands in an element for the article (1), in one for menus, headers, footers,
side matter or forms (-1) or in neither (0), and whether a container's class, id
or role is a name of such matter (1) or not (0). A small decision tree, grown
from the labelled table below, decides which blocks are main text. Neither mark
decides alone: long text between long texts stays in whatever holds it, links go
even from an article, and pages without such markup are decided by words and
link densities.

Pages are scanned once: a search either consumes what it passes or is not tried
again, so broken pages cost in proportion to their length too.
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
from pyspark.sql import functions as F

from . import common

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_NEXT = re.compile(r"[>\"']")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")

# Elements whose content is never text, elements that end a block, elements without content.
_RAW = frozenset("script style title textarea noscript template svg annotation iframe object select button noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILERPLATE = frozenset("nav aside footer form menu dialog search fieldset".split())
_ARTICLE = frozenset("article main".split())
# Names of matter around a text, and names that say nothing by themselves. A class
# counts when all its words are of these and one at least of the first.
_SIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice popup "
    "modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment "
    "comments reply replies disqus respond widget widgets search copyright disclaimer pagination pager tags skip "
    "complementary contentinfo alert".split()
)
_PLAIN = frozenset(
    "area bar block bottom box buttons container content group holder inner item items label left link links list main "
    "menu number outer page panel post posts right row section site text thread top unit wrap wrapper 1 2 3 4 5 6 7 8 9".split()
)
#: An element of the first kind closes an open one of the second.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class _Scanner:
    """Tags and texts of a page, one after the other."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.no_quote = {'"': self.size + 1, "'": self.size + 1}  # from here on there is none

    def tag_end(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``. A quote opens a value after an equals sign only, and only if it closes."""
        page = self.page
        while True:
            found = _NEXT.search(page, at)
            if found is None:
                return self.size
            at = found.end()
            quote = found[0]
            if quote == ">":
                return at
            if at < self.no_quote[quote] and page[max(0, at - 65) : at - 1].rstrip()[-1:] == "=":
                end = page.find(quote, at)
                if end < 0:
                    self.no_quote[quote] = at
                else:
                    at = end + 1

    def parts(self) -> Iterator[tuple[str, str | None, str, str]]:
        """(text before, tag name or None, "/" for an end tag, attributes)."""
        page, at = self.page, 0
        while True:
            text_from, tag = at, None
            while True:
                begin = page.find("<", at)
                if begin < 0:
                    yield page[text_from:], None, "", ""
                    return
                if page.startswith("<!--", begin):
                    end = page.find("-->", begin + 2)
                    stop = self.size if end < 0 else end + 3
                elif page.startswith("<![CDATA[", begin):
                    end = page.find("]]>", begin)
                    stop = self.size if end < 0 else end + 3
                elif page[begin + 1 : begin + 2] in ("!", "?") or page.startswith("</", begin) and not page[begin + 2 : begin + 3].isalpha():
                    end = page.find(">", begin)
                    stop = self.size if end < 0 else end + 1
                elif (tag := _TAG.match(page, begin)) is not None:
                    break
                else:  # a bare sign is text
                    at = begin + 1
                    continue
                yield page[text_from:begin], None, "", ""
                at = text_from = stop
            at = self.tag_end(tag.end())
            name, closing = tag[2].lower(), tag[1]
            rest = page[tag.end() : at - 1] if page[at - 1 : at] == ">" else page[tag.end() : at]
            yield page[text_from:begin], name, closing, rest
            if name in _RAW and not closing and not rest.endswith("/"):
                stop = _raw_end(name).search(page, at)
                at = self.size if stop is None else stop.end()


@lru_cache(maxsize=64)
def _raw_end(name: str):
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I)


#: A block: its text, words, words in links, element mark and name mark.
Block = tuple[str, int, int, int, int]


def blocks(page: str) -> list[Block]:
    """The blocks of a page in its order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0  # words of the block so far that are in links
    links = False  # in a link
    stack: list[tuple[str, tuple[int, int]]] = []
    open_: Counter = Counter()
    marks = (0, 0)

    def end_block() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words)), *marks))
        pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        for name, _ in stack[depth:]:
            open_[name] -= 1
        del stack[depth:]

    for raw, name, closing, rest in _Scanner(page).parts():
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                linked += len(text.split())
        if name is None or name in _RAW:
            continue
        if name == "a":
            links = not closing
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in _BLOCKS:
            continue
        end_block()
        if closing:
            if open_[name] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
        elif name not in _VOID and not rest.endswith("/"):
            links = False
            if stack and stack[-1][0] == "p":  # a paragraph holds no blocks
                close(len(stack) - 1)
            if stack and stack[-1][0] in _CLOSES.get(name, ()):
                close(len(stack) - 1)
            stack.append((name, _marks(name, rest, stack[-1][1] if stack else (0, 0))))
            open_[name] += 1
        marks = stack[-1][1] if stack else (0, 0)
    end_block()
    return out


def _marks(name: str, rest: str, above: tuple[int, int]) -> tuple[int, int]:
    """Element and name mark of what a container holds, given those of what holds it."""
    element, named = above
    if name in _BOILERPLATE or rest and _HIDDEN.search(rest):
        element = -1
    elif name == "header":  # a page's header is boilerplate, an article's own is not
        element = element or -1
    elif name in _ARTICLE and element >= 0:
        return 1, named  # what an article is called says nothing
    if rest and name not in ("html", "body") and not named:
        named = int(any(_side_name(x) for found in _NAMES.finditer(rest) for x in (found[1] or found[2] or found[3] or "").split()))
    return element, named


@lru_cache(maxsize=4096)
def _side_name(value: str) -> bool:
    words = [w.lower() for w in _SPLIT.split(value) if w]
    return not _SIDE.isdisjoint(words) and all(w in _SIDE or w in _PLAIN for w in words)


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: element mark, name mark, words, link density, and words and link density of both neighbours."""
    own = np.array([[e, c, w, k / w] for _, w, k, e, c in found], float).reshape(-1, 4)
    edge = np.zeros((1, 2))
    before, after = np.concatenate((edge, own[:-1, 2:])), np.concatenate((own[1:, 2:], edge))
    return np.concatenate((own, before, after), axis=1)


# The labelled table: element mark, name mark, words, link density, then words and link
# density of the block before and of the block after, and whether the block is main text.
LABELLED = [
    # menus, in and out of their elements
    (-1, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (-1, 0, 2, 1.0, 1, 1.0, 12, 0.0, 0), (0, 1, 2, 1.0, 1, 1.0, 1, 1.0, 0),
    (0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (0, 0, 2, 1.0, 1, 1.0, 2, 1.0, 0), (0, 0, 3, 1.0, 2, 1.0, 9, 0.0, 0),
    (0, 0, 6, 0.9, 4, 1.0, 5, 1.0, 0), (0, 0, 12, 0.8, 3, 1.0, 40, 0.0, 0), (0, 0, 90, 0.9, 60, 0.9, 80, 0.95, 0),
    # headers, side matter, forms and footers by their elements
    (-1, 0, 3, 0.0, 0, 0.0, 4, 1.0, 0), (-1, 0, 9, 0.0, 1, 1.0, 10, 0.0, 0), (-1, 0, 14, 0.0, 80, 0.0, 0, 0.0, 0),
    (-1, 0, 30, 0.0, 150, 0.0, 0, 0.0, 0), (-1, 0, 60, 0.05, 120, 0.0, 6, 0.0, 0), (-1, 0, 30, 0.4, 20, 0.0, 2, 1.0, 0),
    (-1, 0, 5, 0.0, 3, 0.0, 2, 0.0, 0), (-1, 0, 12, 0.0, 40, 0.0, 20, 0.0, 0), (-1, 0, 24, 0.0, 9, 0.0, 90, 0.0, 0),
    (-1, 0, 8, 0.0, 20, 0.0, 14, 0.0, 0), (-1, 0, 45, 0.0, 30, 0.0, 60, 0.0, 0), (-1, 0, 110, 0.0, 150, 0.0, 0, 0.0, 0), (-1, 0, 70, 0.0, 90, 0.0, 70, 0.0, 0),
    (-1, 0, 200, 0.0, 150, 0.0, 0, 0.0, 0), (-1, 0, 180, 0.0, 3, 1.0, 10, 0.0, 0), (-1, 0, 250, 0.0, 12, 0.0, 20, 0.0, 0),
    (-1, 0, 160, 0.0, 20, 0.0, 60, 0.0, 0), (-1, 0, 2, 1.0, 1, 1.0, 150, 0.0, 0), (-1, 0, 10, 0.0, 2, 1.0, 200, 0.0, 0),
    (-1, 0, 20, 0.0, 150, 0.0, 140, 0.0, 0), (-1, 0, 60, 0.0, 140, 0.0, 180, 0.0, 0), (-1, 0, 40, 0.0, 300, 0.0, 260, 0.0, 0),
    # a page that is one form: long text between long texts
    (-1, 0, 160, 0.0, 140, 0.0, 150, 0.0, 1), (-1, 0, 130, 0.0, 140, 0.0, 15, 0.0, 0), (-1, 0, 220, 0.02, 180, 0.0, 130, 0.0, 1), (-1, 0, 150, 0.0, 125, 0.05, 300, 0.0, 1),
    # notices, adverts, side bars and comments by their names
    (0, 1, 3, 0.0, 1, 1.0, 8, 0.0, 0), (0, 1, 14, 0.0, 1, 1.0, 11, 0.0, 0), (0, 1, 25, 0.0, 60, 0.0, 0, 0.0, 0),
    (0, 1, 40, 0.0, 90, 0.0, 30, 0.0, 0), (0, 1, 80, 0.0, 120, 0.0, 20, 0.0, 0), (0, 1, 110, 0.0, 90, 0.0, 3, 0.3, 0),
    (1, 1, 4, 0.0, 60, 0.0, 20, 0.0, 0), (1, 1, 14, 0.0, 14, 0.0, 90, 0.0, 0), (1, 1, 30, 0.0, 90, 0.0, 25, 0.0, 0),
    (0, 1, 9, 0.0, 20, 0.0, 15, 0.0, 0), (0, 1, 30, 0.0, 20, 0.0, 80, 0.0, 0), (1, 1, 50, 0.0, 140, 0.0, 12, 0.0, 0),
    (1, 1, 60, 0.0, 30, 0.0, 70, 0.0, 0), (1, 1, 90, 0.0, 12, 0.0, 20, 0.0, 0), (-1, 1, 20, 0.0, 40, 0.0, 20, 0.0, 0),
    (1, 1, 140, 0.0, 20, 0.0, 15, 0.0, 0), (0, 1, 200, 0.0, 90, 0.0, 0, 0.0, 0), (1, 1, 150, 0.0, 60, 0.0, 30, 0.0, 0),
    (0, 1, 160, 0.0, 10, 0.0, 90, 0.0, 0), (0, 1, 10, 0.0, 1, 1.0, 180, 0.0, 0), (1, 1, 12, 0.0, 140, 0.0, 150, 0.0, 0),
    (1, 1, 50, 0.0, 160, 0.0, 140, 0.0, 0), (0, 1, 30, 0.0, 200, 0.0, 300, 0.0, 0),
    # a text whose container only sounds like that: long, between long texts
    (0, 1, 150, 0.0, 130, 0.0, 160, 0.0, 1), (1, 1, 140, 0.0, 130, 0.0, 150, 0.0, 1), (1, 1, 260, 0.02, 125, 0.0, 200, 0.0, 1),
    # short stray lines outside any article
    (0, 0, 3, 0.0, 0, 0.0, 2, 1.0, 0), (0, 0, 5, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 8, 0.0, 3, 0.0, 0, 0.0, 0),
    (0, 0, 4, 0.0, 8, 0.0, 3, 0.0, 0), (0, 0, 9, 0.35, 5, 0.0, 4, 1.0, 0), (0, 0, 14, 0.5, 2, 1.0, 6, 0.5, 0),
    (0, 0, 8, 0.0, 60, 0.0, 0, 0.0, 0), (0, 0, 7, 0.2, 40, 0.0, 2, 1.0, 0),
    # text outside an article, long or next to long text
    (0, 0, 70, 0.0, 60, 0.0, 55, 0.0, 1), (0, 0, 45, 0.02, 10, 0.0, 60, 0.0, 1), (0, 0, 30, 0.0, 80, 0.0, 50, 0.0, 1),
    (0, 0, 120, 0.05, 4, 1.0, 90, 0.0, 1), (0, 0, 25, 0.0, 60, 0.0, 3, 1.0, 1), (0, 0, 18, 0.1, 50, 0.0, 45, 0.0, 1),
    (0, 0, 9, 0.0, 2, 1.0, 60, 0.0, 1), (0, 0, 12, 0.0, 45, 0.0, 70, 0.0, 1), (0, 0, 6, 0.0, 50, 0.0, 80, 0.0, 1),
    (0, 0, 300, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 70, 0.0, 80, 0.0, 8, 0.0, 1), (0, 0, 40, 0.0, 60, 0.0, 0, 0.0, 1),
    (0, 0, 60, 0.0, 60, 0.0, 2, 0.0, 1), (0, 0, 120, 0.02, 70, 0.0, 12, 0.2, 1), (0, 0, 35, 0.0, 20, 0.0, 12, 0.0, 1),
    (0, 0, 5, 0.0, 30, 0.0, 12, 0.0, 1), (0, 0, 3, 0.0, 14, 0.0, 40, 0.0, 1), (0, 0, 10, 0.0, 16, 0.0, 18, 0.0, 1),
    (0, 0, 15, 0.0, 25, 0.0, 9, 0.0, 1), (0, 0, 2, 0.0, 60, 0.0, 20, 0.0, 1), (0, 0, 20, 0.0, 12, 0.0, 25, 0.0, 1),
    (0, 0, 60, 0.0, 120, 0.0, 5, 0.0, 1), (0, 0, 30, 0.0, 100, 0.0, 15, 0.0, 1), (0, 0, 80, 0.0, 130, 0.0, 0, 0.0, 1),
    (0, 0, 45, 0.0, 2, 1.0, 4, 1.0, 1), (0, 0, 90, 0.0, 3, 1.0, 14, 0.0, 1), (0, 0, 28, 0.1, 40, 0.0, 20, 0.0, 1),
    # an article's heading, paragraphs, short paragraphs, lists, lines with links
    (1, 0, 10, 0.0, 9, 0.0, 70, 0.0, 1), (1, 0, 3, 0.0, 1, 1.0, 40, 0.0, 1), (1, 0, 80, 0.0, 10, 0.0, 60, 0.0, 1),
    (1, 0, 25, 0.0, 70, 0.0, 14, 0.0, 1), (1, 0, 6, 0.0, 60, 0.0, 40, 0.0, 1), (1, 0, 1, 0.0, 30, 0.0, 12, 0.0, 1),
    (1, 0, 4, 0.0, 3, 0.0, 5, 0.0, 1), (1, 0, 150, 0.02, 90, 0.0, 80, 0.0, 1), (1, 0, 12, 0.3, 50, 0.0, 40, 0.0, 1),
    (1, 0, 40, 0.0, 60, 0.0, 9, 0.0, 1), (1, 0, 200, 0.0, 10, 0.0, 12, 0.0, 1), (1, 0, 30, 0.0, 8, 0.0, 4, 0.0, 1),
    (1, 0, 80, 0.0, 120, 0.0, 8, 0.0, 1), (1, 0, 40, 0.0, 150, 0.0, 20, 0.0, 1), (1, 0, 25, 0.0, 110, 0.0, 0, 0.0, 1),
    (1, 0, 120, 0.0, 95, 0.0, 10, 0.0, 1), (1, 0, 3, 0.0, 130, 0.0, 9, 0.0, 1), (1, 0, 14, 0.0, 8, 0.0, 11, 0.0, 1),
    (1, 0, 12, 0.0, 40, 0.0, 3, 1.0, 1), (1, 0, 6, 0.0, 30, 0.0, 2, 1.0, 1), (1, 0, 15, 0.0, 9, 0.0, 5, 0.8, 1),
    (1, 0, 9, 0.4, 9, 0.3, 8, 0.2, 1), (1, 0, 60, 0.5, 50, 0.0, 30, 0.0, 1), (1, 0, 2, 0.0, 14, 0.0, 0, 0.0, 1),
    # links in an article that are no text: more to read, back to the top
    (1, 0, 5, 1.0, 60, 0.0, 6, 1.0, 0), (1, 0, 8, 1.0, 6, 1.0, 7, 1.0, 0), (1, 0, 3, 1.0, 40, 0.0, 14, 0.0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8):
    """A tree of (feature, threshold, below, above), or a leaf's label: least Gini impurity, to purity."""
    if depth == 0 or len(set(labels.tolist())) == 1:
        return int(labels.mean() >= 0.5)
    best = None
    for k in range(rows.shape[1]):
        values = np.unique(rows[:, k])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, k] < t
            p, q = labels[low].mean(), labels[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, t, low)
    if best is None:
        return int(labels.mean() >= 0.5)
    _, k, t, low = best
    return k, float(t), grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


@lru_cache(maxsize=1)
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def decide(node, row) -> int:
    while not isinstance(node, int):
        k, t, below, above = node
        node = below if row[k] < t else above
    return node


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds; null and empty pages have none."""
    found = blocks(page or "")
    if not found:
        return ""
    node = tree()
    return "\n".join(b[0] for b, row in zip(found, features(found).tolist()) if decide(node, row))


RESULT = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Null, empty and broken pages give the text there is, or the empty string; null
    ids and urls stay null; repeated rows each give a row. An empty table gives no
    rows. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    common.tune(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, RESULT)
