"""Operator 8: benchmark passages in documents by pigeonhole edit matching.

Texts are normalised: lower case, every run of other than letters and digits
one space, and one space at either end, so that an item's first and last word
count as whole words. An item of ``m`` characters, these spaces included, may
differ by ``m // BUDGET_SHARE`` edits, however short or long it is. Cut into one
piece more than that, it must have a piece without an edit in any match, so an
automaton of all pieces finds every place worth a look; Myers' bit-parallel
distance then decides on the stretch of text around it, item whole. The
benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``, one scan for
each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: One edit for so many characters of a normalised item.
BUDGET_SHARE = 16
#: Text of benchmark items that one scan takes along.
BLOCK_BYTES = 4 << 20

_GAPS = re.compile(r"[\W_]+")


_ASCII_GAPS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def normalise(text: str | None) -> str:
    """Words in lower case, a space before, between and after them; without words the empty string."""
    if not text:
        return ""
    if text.isascii():  # the same result, several times faster
        words = " ".join(text.lower().translate(_ASCII_GAPS).split())
    else:
        words = _GAPS.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def best_match(item: str, text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` nearest to ``item``, first of the best; None beyond ``limit``.

    Myers (1999): the differences of a column of the distance table are bits of
    two words as long as the item; a step takes a few operations on them.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, now = full, 0, m
    best = None
    get = masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        diagonal = ((eq & plus) + plus ^ plus) | eq
        up = minus | full & ~(diagonal | plus)
        down = plus & diagonal
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up = up << 1  # a match may begin anywhere: the first row is zero
        down = down << 1
        plus = (down | full & ~(vertical | up)) & full
        minus = up & vertical & full
        if now <= limit and (best is None or now < best[0]):
            best = (now, at)
    return best


class Matcher:
    """Finds items in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], share: int = BUDGET_SHARE):
        import ahocorasick

        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            m = len(text)
            limit = m // share
            number = len(self.items)
            self.items.append((key, text, limit))
            cuts = [m * k // (limit + 1) for k in range(limit + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item with a match in ``text``: distance and end of the first of the best matches."""
        if not self.items:
            return {}
        looks: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                looks.setdefault(number, []).append(end + 1 - length - offset)
        found = {}
        for number, starts in looks.items():
            key, item, limit = self.items[number]
            best = None
            for low, high in self._stretches(sorted(set(starts)), len(item) + limit, limit, len(text)):
                if limit:
                    got = best_match(item, text[low:high], limit)
                    got = got and (got[0], low + got[1])
                else:
                    got = (0, high) if text[low:high] == item else None
                if got and (best is None or got < best):
                    best = got
                    if best[0] == 0:
                        break
            if best is not None:  # an item id may have several texts
                found[key] = min(found.get(key, best), best)
        return found

    @staticmethod
    def _stretches(starts: list[int], after: int, before: int, length: int) -> Iterator[tuple[int, int]]:
        """Stretches of text around the places where an item may begin; those that overlap become one."""
        low = high = None
        for start in starts:
            a, b = max(0, start - before), min(length, start + after)
            if low is None:
                low, high = a, b
            elif before and a <= high:
                high = b
            else:
                yield low, high
                low, high = a, b
        if low is not None:
            yield low, high


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of bounded size, ascending by id; null or wordless items match nothing."""
    block, size = [], 0
    for key, text in benchmark.select("item_id", "text").distinct().sort("item_id", "text").toLocalIterator():
        item = normalise(text)
        if key is None or not item:
            continue
        if block and size + len(item) > block_bytes:
            yield block
            block, size = [], 0
        block.append((key, item))
        size += len(item)
    if block:
        yield block


HITS = "doc_id long, item_id long, distance int, match_end long"


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document id and item id with a match: doc_id, item_id, distance, match_end.

    ``match_end`` counts normalised characters. Null and empty texts have no
    match; null ids and repeated rows are searched like others. An item id with
    several texts, in whichever blocks, and a document id with several rows, null
    too, count with the best match: least distance, then first end. An empty table
    on either side gives no rows. Other columns are not looked at.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = [rows.mapInArrow(_hits_of(items), HITS) for items in blocks_of(benchmark)]
    if not parts:
        return docs.sparkSession.createDataFrame([], HITS)
    best = F.min(F.struct("distance", "match_end")).alias("best")
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _hits_of(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        matcher = Matcher(items)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend((key, i, d, e) for i, (d, e) in matcher.find(normalise(text)).items())
            columns = list(zip(*out)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in HITS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without rows that hold an item; columns as they were, nothing shuffled."""
    common.tune(docs.sparkSession)

    def without(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            matcher = Matcher(items)
            for batch in batches:
                if batch.num_rows:
                    texts = batch.column(text_col).to_pylist()
                    yield batch.filter(pa.array([not matcher.find(normalise(t)) for t in texts]))

        return run

    for items in blocks_of(benchmark):
        docs = docs.mapInArrow(without(items), docs.schema)
    return docs
