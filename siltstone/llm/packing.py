"""Operator 10: order-preserving packing of token streams into fixed windows.

Documents follow each other in id order. A window may end only at a candidate
place: the end of a document, the end of a sentence, or, within a run longer
than ``max_run`` tokens without either, at a forced place. The cost of a window
of ``L`` tokens is its padding, ``size - L``, or nothing where ``L`` is a power
of two, plus a penalty for its last cut: none at a document's end, some at a
sentence's, more at a forced place. With ``f(j)`` the least cost of windows
that end at candidate ``j``,

    f(j) = cut(j) + min( min over i with p(j) - size <= p(i) < p(j) of
                         f(i) + size - (p(j) - p(i)),
                         min over i with p(j) - p(i) a power of two of f(i) ),

where the first minimum is that of ``f(i) + p(i)`` over a sliding range, kept in
a monotone queue, and the second has at most as many terms as there are powers
below ``size``; they are found for all candidates at once. Linear in the number
of candidates.

Ranges of documents are packed independently, so that tasks need nothing of
each other; within a range, blocks of about ``block_tokens`` are solved one
after another and the last window of a block opens the next one, so memory
does not grow with the range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SIZE = 2048
#: Tokens of padding that a cut is worth.
SENTENCE_PENALTY = 2
FORCED_PENALTY = 8
MAX_RUN = 16
BLOCK_TOKENS = 1 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def sentence_ends(surface: list[str]) -> np.ndarray:
    """For each id, whether a sentence may end with it (byte-level spelling: Ċ is a line feed)."""
    return np.array([t.rstrip("\"')]»”")[-1:] in tuple(".!?Ċ") and t != "" for t in surface], bool)


def candidates(ends: np.ndarray, is_end: np.ndarray, max_run: int = MAX_RUN) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending, and the kind of each: 0 document, 1 sentence, 2 forced."""
    n = int(ends[-1])
    kind = np.full(n + 1, 3, np.int8)
    kind[np.flatnonzero(is_end) + 1] = 1
    kind[ends] = 0
    kind[0] = 0
    natural = np.flatnonzero(kind < 3)
    gaps = np.diff(natural)
    wide = np.flatnonzero(gaps > max_run)
    if len(wide):
        steps = (gaps[wide] - 1) // max_run
        base = np.repeat(natural[wide], steps)
        rank = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        kind[base + (rank + 1) * max_run] = 2
    places = np.flatnonzero(kind < 3)
    return places, kind[places]


def _powers_before(places: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The candidates a power of two below ``size`` before each candidate, ascending, one after the other, and how many each has."""
    n = len(places)
    index = np.full(int(places[-1]) + 1, -1, np.int32)
    index[places] = np.arange(n, dtype=np.int32)
    pairs = [np.empty(0, np.int64)]
    for step in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        first = int(np.searchsorted(places, step))
        found = index[places[first:] - step]
        has = np.flatnonzero(found >= 0)
        pairs.append((has + first) * n + found[has])
    pairs = np.sort(np.concatenate(pairs))
    end = pairs // n
    return (pairs - end * n).tolist(), np.bincount(end, minlength=n).tolist()


def cut(places: np.ndarray, kinds: np.ndarray, size: int = SIZE, penalties=(0, SENTENCE_PENALTY, FORCED_PENALTY)) -> list[int]:
    """Ends of the windows over ``places`` (from 0 to the last) of least cost."""
    p = places.tolist()
    price = np.array(penalties)[kinds].tolist()
    price[-1] = 0
    befores, numbers = _powers_before(places, size)
    at = 0
    best, back = [0], [0]
    keys, queue, head = [0], [0], 0  # f + p, ascending, and the candidates; what lies before head has left
    for j, (here, penalty, number) in enumerate(zip(p[1:], price[1:], numbers[1:]), 1):
        low = here - size
        while p[queue[head]] < low:
            head += 1
        i = queue[head]
        value = keys[head] + size - here
        if number:
            for k in befores[at : at + number]:  # the longest window first
                cost = best[k]
                if cost < value:
                    value, i = cost, k
            at += number
        value += penalty
        best.append(value)
        back.append(i)
        key = value + here
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return out[::-1]


class _Packer:
    """Packs the documents of one range, block after block."""

    def __init__(self, first_sequence: int, ends: np.ndarray, size: int, penalties, max_run: int):
        self.next, self.is_end, self.size, self.penalties, self.max_run = first_sequence, ends, size, penalties, max_run

    def block(self, docs: list[tuple], last: bool) -> tuple[list[tuple], list[tuple]]:
        """Pieces of all windows but the last, and the documents' remains that open the next block.

        A document is (id, tokens before these, ids, tokens in all); ids are never empty.
        """
        ids = np.concatenate([d[2] for d in docs])
        lengths = np.array([len(d[2]) for d in docs])
        ends = np.cumsum(lengths)
        known = ids < len(self.is_end)
        is_end = self.is_end[np.where(known, ids, 0)] & known
        places, kinds = candidates(ends, is_end, self.max_run)
        windows = cut(places, kinds, self.size, self.penalties)
        until = windows[-1] if last or len(windows) < 2 else windows[-2]
        bounds = np.unique(np.concatenate((np.array([w for w in windows if w <= until]), ends[ends < until])))
        begins = np.concatenate(([0], bounds[:-1]))
        doc = np.searchsorted(ends, begins, side="right")
        window = np.searchsorted(windows, begins, side="right")
        window_begin = np.concatenate(([0], windows))[window]
        doc_begin = ends - lengths
        raw = ids.astype("<u4")
        pieces = [
            (docs[d][0], docs[d][1] + b - int(doc_begin[d]), e - b, zlib.crc32(raw[b:e]), docs[d][3], self.next + w, b - o)
            for b, e, d, w, o in zip(begins.tolist(), bounds.tolist(), doc.tolist(), window.tolist(), window_begin.tolist())
        ]
        self.next += int(window[-1]) + 1
        rest = []
        for d in range(int(np.searchsorted(ends, until, side="right")), len(docs)):
            skip = max(0, until - int(doc_begin[d]))
            rest.append((docs[d][0], docs[d][1] + skip, docs[d][2][skip:], docs[d][3]))
        return pieces, rest


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 1,
    size: int = SIZE,
    penalties: tuple[int, int, int] = (0, SENTENCE_PENALTY, FORCED_PENALTY),
    max_run: int = MAX_RUN,
    block_tokens: int = BLOCK_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_words: int = tokens.CACHE_WORDS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text: only the end id. Null ids come first, rows of one id go by their
    text, each a document of its own; what repeats very often is dealt to several
    tasks all the same. An empty table gives no rows. Sequence ids
    ascend with the documents; they are unique, not gapless. Other columns of
    ``docs`` are not looked at. A worker keeps up to ``cache_words`` words, of about
    250 bytes each, and the next task there goes on with them.
    """
    vocabulary = vocabulary or tokens.vocabulary_path()
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary, cache_words)
        end = np.array([end_id], "<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 33, sentence_ends(coder.surface), size, penalties, max_run)
        held, amount = [], 0

        def solve(last: bool) -> pa.RecordBatch:
            nonlocal held, amount
            pieces, held = packer.block(held, last)
            amount = sum(len(d[2]) for d in held)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces)], schema=schema)

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, "<u4")
                held.append((key, 0, ids, len(ids)))
                amount += len(ids)
                if amount >= block_tokens:
                    yield solve(False)
        if held:
            yield solve(True)

    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.in_order(rows).mapInArrow(run, PIECES)
