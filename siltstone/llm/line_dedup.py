"""Operator 5: repeated and nearly repeated lines by an edit join over each line's rarest pieces.

Lines are stripped; empty ones count for nothing. Of equal lines the first
occurrence, by document id and line number, stands for all. Two lines are near
when their distance is within one edit for each ``GROW`` characters of the shorter
one, however long it is: below ``GROW`` characters lines are near only if equal.

Keys are pieces of a fixed number of characters. All lines put pieces in one
order, rarest first, and a line sends its first ones: as few as cannot all be
touched by the edits that it may have, which is so once more of them lie side by
side than there are edits (Xiao et al., "Ed-Join"). Of two near lines, the one
whose last sent piece is the rarer has one that survives in the other, and the
other sends it too. Any order gives the same result; one learnt from a bounded
sample makes the pieces that are sent rare. Lines of several times ``GROW`` have
longer pieces than shorter lines; those at the bound between send both kinds.
Of their pieces only those rarer than the ones a character before and after count,
so fewer are sent: a piece with a character on either side tells whether it counts,
and as few of these as edits cannot all touch must lie side by side. A line without
as many sends all pieces that count, so it meets every line that has enough, and
its rarest of all pieces too, by which it meets others like itself.

1. Documents are packed into blocks, written once to a bucketed table with the
   hashes of their distinct lines. A partial minimum for each hash gives the block
   that has the first occurrence; a line in every block is one row a task.
2. Those blocks send four bytes for each key, of its hash and place, with classes
   of the lines' lengths, one row for each bucket that gets any. A bucket pairs the
   lines that share a key near the same place and have fitting lengths. Lines with
   keys of very many are cut into parts; two parts meet in one task for all such keys.
3. The block of a pair's one line drops repeated pairs and sends the line, once
   for each block that holds partners. There counts of characters rule out most
   pairs at once, and bit-parallel automata decide on the others.
4. Each block drops repeats, and first occurrences linked with an earlier line.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_dedup import _NULL_RANK, _pack, _runs, _unpack, sizes

#: Characters of a line for each edit that a near one may have.
GROW = 16
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
#: Lines of a key from which on its members meet in tasks of their own, and lines of a part there.
CROWD, TASK_LINES = 1024, 2048


# ---------------------------------------------------------------- edit distance


def within(a: str, b: str, edits: int) -> bool:
    """Whether ``b`` is at most ``edits`` edits from ``a``.

    What both begin and end with is cut off first. Then ``edits + 1`` words of
    ``2 * edits + 1`` bits slide along the diagonal: bit ``k`` of word ``d`` after
    ``j`` characters of ``b`` says that the first ``j - edits + k`` of ``a`` are
    within ``d`` edits of them (Wu and Manber's recurrence, kept to the band).
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    m = len(a)
    if not m or not b:
        return max(m, len(b)) <= edits
    if edits > 3:
        return _columns(a, b, edits)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i + edits  # shifted so that the band never starts below zero
    band = (1 << 2 * edits + 1) - 1
    # Before any character: the first i of a are i deletions away.
    rows = [((1 << d + 1) - 1) << edits & band for d in range(edits + 1)]
    get = masks.get
    for j, c in enumerate(b):
        same = get(c, 0) >> j & band
        before = rows[0]
        new = before & same
        rows[0] = new
        alive = new
        for d in range(1, edits + 1):
            old = rows[d]
            # Match, replaced character, character of b too many, character of a too many.
            new = (old & same | before | before >> 1 | new << 1) & band
            before, rows[d] = old, new
            alive |= new
        if not alive:
            return False
    at = m - len(b) + edits
    return 0 <= at <= 2 * edits and bool(rows[edits] >> at & 1)


def _columns(a: str, b: str, edits: int) -> bool:
    """The same by Myers' bit vectors, whose steps do not grow with ``edits``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last, score, left = (1 << len(a)) - 1, 1 << len(a) - 1, len(a), len(b)
    up, down = full, 0
    for c in b:
        same = masks.get(c, 0)
        vertical = same | down
        across = ((same & up) + up ^ up) | same
        more, less = down | ~(across | up) & full, up & across
        score += bool(more & last) - bool(less & last)
        left -= 1
        if score - left > edits:
            return False
        more, less = more << 1 & full | 1, less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
    return score <= edits


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without what they begin and end with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return a[: len(a) - low], b[: len(b) - low]


#: Most edits of a pair whose band fits a word, and characters of pairs that go in step.
BAND_EDITS, BAND_CHARS = 62, 1 << 18
#: Words that tell where letters stand, at most, unless one pair needs more.
BAND_WORDS = 1 << 22


def within_all(pairs: list[tuple[str, str, int]]) -> np.ndarray:
    """``within`` of many pairs: those whose band fits a word go in step, ordered by length."""
    out = np.zeros(len(pairs), bool)
    banded = []
    for k, (a, b, edits) in enumerate(pairs):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > edits:
            continue
        a, b = _trimmed(a, b)
        if not a or len(b) <= edits:
            out[k] = len(b) <= edits
        elif len(a) <= edits or not (a.isascii() and b.isascii()) and max(max(a), max(b)) > "\uffff":
            out[k] = may_be_within(a, b, edits) and _columns(a, b, edits)
        elif edits > BAND_EDITS and not may_be_within(a, b, edits):
            continue
        elif len(b) - len(a) <= BAND_EDITS:
            banded.append((len(b), k, a, b, edits))
        else:
            out[k] = _columns(a, b, edits)
    banded.sort(reverse=True)
    at = 0
    while at < len(banded):
        n = max(1, BAND_CHARS // banded[at][0])
        _, ks, a, b, edits = zip(*banded[at : at + n])
        out[list(ks)] = _bands(a, b, np.minimum(edits, BAND_EDITS))
        at += n
    # Most pairs with more edits have few; the others are decided without a band.
    for _, k, a, b, edits in banded:
        if edits > BAND_EDITS and not out[k]:
            out[k] = _columns(a, b, edits)
    return out


def _bands(a: tuple[str, ...], b: tuple[str, ...], edits: np.ndarray) -> np.ndarray:
    """Myers' bit vectors over the diagonals that edits can reach (Hyyroe), a word for each pair; ``b`` no shorter, longest first.

    Bit 63 of a word is the lowest diagonal; while it lies within ``a`` the score
    follows it, then the last row. What goes to a diagonal must come back to the
    last one, so no more diagonals than one and the edits count (Ukkonen).
    """
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    below = (edits - (m - n)) // 2  # diagonals under the first one
    pairs, width = len(a), int(m[0])
    xa = np.frombuffer("".join(a).encode("utf-16-le", "surrogatepass"), "<u2")
    xb = np.frombuffer("".join(b).encode("utf-16-le", "surrogatepass"), "<u2")
    letters = np.zeros(1 << 16, np.int64)
    letters[xa] = 1
    count = int(letters.sum()) + 1  # 0: a letter in no line of the first side
    letters[letters > 0] = np.arange(1, count)
    # Where each letter stands in a line, with a word of zeros on either side.
    words = int(n.max()) // 64 + 3
    if pairs > 1 and pairs * count * words > BAND_WORDS:
        half = pairs // 2
        return np.concatenate((_bands(a[:half], b[:half], edits[:half]), _bands(a[half:], b[half:], edits[half:])))
    row_a = np.repeat(np.arange(pairs), n)
    at = np.arange(len(xa)) - np.repeat(np.cumsum(n) - n, n)
    where = np.zeros(pairs * count * words, np.uint64)
    slot = (row_a * count + letters[xa]) * words + at // 64 + 1
    np.bitwise_or.at(where, slot, np.uint64(1) << (at % 64).astype(np.uint64))
    where.reshape(pairs, count, words)[:, 0] = 0
    text = np.zeros((width, pairs), np.int64)
    row_b = np.repeat(np.arange(pairs), m)
    text[np.arange(len(xb)) - np.repeat(np.cumsum(m) - m, m), row_b] = letters[xb]
    text = (text + np.arange(pairs) * count) * words

    one, ones = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    plus = ones << (63 - below).astype(np.uint64)
    minus = np.zeros(pairs, np.uint64)
    score, begin = below.copy(), below + 1 - 64
    alive, result = np.arange(pairs), np.zeros(pairs, bool)
    bound = edits + below + m - n  # a score falls by one a step at most, and only along the last row
    for j in range(width):
        ended = m == j
        if ended.any() or j % 16 == 15:
            result[alive[ended]] = score[ended] <= edits[ended]
            on = ~ended & (score <= bound)
            if not on.all():
                n, m, edits, below, plus, minus, score, bound, alive = (x[on] for x in (n, m, edits, below, plus, minus, score, bound, alive))
                begin = begin[on]
            if not len(alive):
                return result
        first = begin + j + 64
        word, shift = first >> 6, (first & 63).astype(np.uint64)
        slot = text[j, alive] + word
        # The word beyond the last is read only where shifted out or zero.
        same = where[slot] >> shift | where[np.minimum(slot + 1, len(where) - 1)] << one << (np.uint64(63) - shift)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        more, less = minus | ~(diagonal | plus), diagonal & plus
        low = j < n - below
        last = np.where(low, 0, 62 - (j - n + below)).astype(np.uint64)
        step = (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64)
        score = score + np.where(low, (diagonal >> np.uint64(63) ^ one).astype(np.int64), step)
        down = diagonal >> one
        plus, minus = less | ~(down | more), down & more
    result[alive] = score <= edits
    return result


# ---------------------------------------------------------------- keys


#: Entries of a table of costs, of the first three characters of a piece and of one character after three.
COSTS = 1 << 16
#: Bytes that the costs are learnt from, at most, of each of so many blocks.
SAMPLE, SAMPLE_BLOCKS = 1 << 20, 4

#: Parts of the text, by length of lines, whose keys are dealt one after the other.
PASSES = 3
#: The place of a key that a line has at several ones; of keys with more members than ``FEW`` each line is one.
ANYWHERE, FEW = 255, 16

#: Salts from here on are for lines with too few pieces rarer than their neighbours.
_ALL_PIECES = 1 << 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _threes_and_fours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the tables of costs for the three and the four characters at each place but the last three."""
    h = x[:-3] * np.uint32(0x9E3779B1) + x[1:-2] * np.uint32(0x85EBCA6B) + x[2:-1] * np.uint32(0xC2B2AE35)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    four = h + x[3:] * np.uint32(0x27D4EB2F)
    four = (four ^ four >> np.uint32(13)) * np.uint32(0x297A2D39)
    return h >> np.uint32(16), four >> np.uint32(16)


def _codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")


def _count_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each entry of the tables of costs occurs; for four characters, how often the first three of them do."""
    x = np.concatenate((_codes(texts), np.zeros(3, "<u4")))
    three, four = _threes_and_fours(x)
    counts = np.bincount(three, minlength=COSTS)
    after = np.zeros(COSTS, np.int64)
    after[four] = counts[three]
    return np.concatenate((counts, np.bincount(four, minlength=COSTS))), after


def _learn(counts: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs in sixteenths of a bit: of a piece's first three characters, and of each further one."""
    three, four = counts[:COSTS], counts[COSTS:]
    first = np.log2(three.sum() + 2.0) - np.log2(three + 0.5)
    then = np.where(four > 0, np.log2(after + 8.0) - np.log2(four + 0.25), 8.0)
    return np.rint(16 * first).astype(np.int32), np.rint(16 * np.clip(then, 0, 12)).astype(np.int32)


def _any_costs() -> tuple[np.ndarray, np.ndarray]:
    """Costs for a table without a sample."""
    h = _mixed(np.arange(1, 2 * COSTS + 1, dtype=np.uint64) * _STEP)
    return (h[:COSTS] % np.uint64(256)).astype(np.int32), (h[COSTS:] % np.uint64(64)).astype(np.int32)


class _Plan:
    """Keys of lines: the pieces that come first in an order common to all lines."""

    #: Steps of the search for the last piece that a line sends, in sixteenths of a bit.
    STEPS = (64, 32, 16)

    def __init__(self, grow: int, costs: tuple[np.ndarray, np.ndarray] | None = None, cuts: tuple[int, ...] = ()):
        self.grow, self.costs = grow, costs or _any_costs()
        #: Classes of lengths: where they begin, and the characters of their pieces.
        self.classes = []
        for start, size in ((grow, grow // 2), (4 * grow, grow // 2 + 2)):
            size = max(1, size)
            while any(n // size <= n // grow for n in range(start, start + 4 * grow)):
                size -= 1
            self.classes.append((start, size))
        #: Classes whose keys are dealt at one time, so that fewer lie on disk; ``cuts`` are lengths between them.
        self.passes = [[0, 1]]
        for cut in cuts:
            if cut > self.classes[-1][0]:
                self.passes.append([len(self.classes)])
                self.classes.append((cut, size))

    def chosen(self, lines: list[str], size: int, salt: int, margin: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of line, place and hash of the pieces that lines send, in order of lines, and which lines have too few.

        With a ``margin`` of 1 only pieces rarer than those a character before and after count.
        """
        raw = _codes(lines)
        n, lens = len(raw), np.array([len(x) for x in lines])
        heads = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        x = np.concatenate((raw, np.zeros(size + 4, "<u4")))
        if size > 3:
            three, four = _threes_and_fours(x)
            sums = np.concatenate((np.zeros(1, np.int32), np.cumsum(self.costs[1][four], dtype=np.int32)))
            rare = self.costs[0][three[:n]] + sums[size - 3 : n + size - 3] - sums[:n]
        else:
            rare = (self._hash(x, np.arange(n), size, salt) >> np.uint64(40)).astype(np.int32) & 1023
        bounds = np.zeros(n + 2, np.int8)  # a piece ends where its line does, at the latest
        np.add.at(bounds, heads, 1)
        np.add.at(bounds, heads + lens - size + 1, -1)
        rare[np.cumsum(bounds, dtype=np.int8)[:n] == 0] = -1
        count = rare >= 0
        if margin:
            count[1:-1] = (rare[:-2] >= 0) & (rare[2:] >= 0) & (rare[1:-1] > rare[:-2]) & (rare[1:-1] >= rare[2:])
            count[[0, -1]] = False

        # From here on pieces that count go by number; ``before``: how many begin before a place.
        pieces, before = np.flatnonzero(count), np.concatenate((np.zeros(1, np.int32), np.cumsum(count, dtype=np.int32)))
        rare, m = rare[pieces], len(pieces)
        need, begins, ends, jump = lens // self.grow + 1, before[heads], before[heads + lens], before[np.minimum(pieces + size + 2 * margin, n)]
        numbers, enough_at = ends - begins, np.zeros(len(lines), bool)
        start = np.percentile(rare[::7], 20 if margin else 70) if m else 0
        least, tried = np.zeros(len(lines), np.int32), np.full(len(lines), start, np.int32)
        piece, after = np.arange(m, dtype=np.int32), np.full(m + 1, m, np.int32)
        for step in (*self.STEPS, 0):
            found = np.where(rare >= np.repeat(np.maximum(tried, 0), numbers), piece, np.int32(m))
            np.minimum.accumulate(found[::-1], out=after[:m][::-1])
            enough = self._disjoint(after, begins, ends, need, jump)
            enough_at |= enough
            least = np.where(enough, np.maximum(least, tried), least)
            tried = np.where(enough, tried + step, tried - step)
        sent = np.flatnonzero(rare >= np.repeat(least, numbers))
        line, at = np.repeat(np.arange(len(lines), dtype=np.int32), numbers)[sent], pieces[sent]
        return line, at - heads[line], self._hash(x, at, size, salt), ~enough_at

    @staticmethod
    def _disjoint(after: np.ndarray, begins: np.ndarray, ends: np.ndarray, need: np.ndarray, jump: np.ndarray) -> np.ndarray:
        """Whether ``need`` pieces of each line lie side by side; ``after``: the next piece from each on, ``jump``: the first beside it."""
        out, left, at, line, end = np.zeros(len(begins), bool), need, after[begins], np.arange(len(begins)), ends
        while len(line):
            on = at < end
            line, left, at, end = line[on], left[on] - 1, at[on], end[on]
            done = left == 0
            if done.any():
                out[line[done]] = True
                line, left, at, end = line[~done], left[~done], at[~done], end[~done]
            at = after[jump[at]]
        return out

    @staticmethod
    def _hash(x: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
        h = np.full(len(at), salt, np.uint64)
        for i in range(size):
            h = h * _STEP + x[at + i]
        return _mixed(h)

    def keys(self, lines: list[str], classes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of line, place, hash and class of the keys of lines that ascend by length, none below ``grow``."""
        lens = np.array([len(x) for x in lines], np.int64)
        out = []
        for c, (start, size) in enumerate(self.classes):
            if classes is not None and c not in classes:
                continue
            last = self.classes[c + 1][0] - 1 if c + 1 < len(self.classes) else 1 << 62
            # Lines beyond the class that may be near to one in it have its keys, too.
            a, b = np.searchsorted(lens, start), np.searchsorted(lens, last + last // self.grow, side="right")
            if a < b:
                margin = int(start // (size + 2) > start // self.grow)
                line, place, hashed, few = self.chosen(lines[a:b], size, c + 1, margin)
                out.append((line + a, place, hashed, np.full(len(line), c)))
                if margin and few.any():
                    some = np.flatnonzero(few) + a
                    line, place, hashed, _ = self.chosen([lines[k] for k in some.tolist()], size, _ALL_PIECES + c)
                    out.append((some[line], place, hashed, np.full(len(line), c)))
        if not out:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*out))

    def grams(self, line: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a line for its own class of lengths, and for the one below."""
        _, _, hashed, c = self.keys([line])
        own = max((i for i, (start, _) in enumerate(self.classes) if start <= len(line)), default=0)
        return np.unique(hashed[c == own]), np.unique(hashed[c != own])


def may_be_within(a: str, b: str, edits: int) -> bool:
    """False when more pieces of eight characters of ``a`` are missing in ``b``, near their places, than edits could touch."""
    missing = 0
    for at in range(0, len(a) - 7, 8):
        if b.find(a[at : at + 8], max(0, at - edits), at + edits + 8) < 0:
            missing += 1
            if missing > edits:
                return False
    return True


class _Lines:
    """The lines of one block: each distinct line with its first occurrence here, and all occurrences."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        self.ids, self.texts = ids, texts
        entry: dict[str, int] = {}
        self.lines: list[str] = []
        self.occurrences: list[list[int]] = []  # for each document, the entry of each line, -1: empty
        order = np.argsort(ids, kind="stable")
        found: list[list[int] | None] = [None] * len(texts)
        first = []
        for d in order.tolist():  # by id, so that an entry's first occurrence comes first
            own = []
            for number, line in enumerate(texts[d].split("\n")):
                line = line.strip()
                if not line:
                    own.append(-1)
                    continue
                k = entry.setdefault(line, len(entry))
                if k == len(self.lines):
                    self.lines.append(line)
                    first.append((d, number))
                    own.append(k)
                else:
                    own.append(-2 - k)  # a repeat within the block
            found[d] = own
        self.occurrences = found
        self.first_doc = np.array([f[0] for f in first], np.int64)
        self.first_line = np.array([f[1] for f in first], np.int64)
        self.rank = self.ids[self.first_doc] if len(first) else np.empty(0, np.int64)

    def hashes(self) -> list[bytes]:
        return [xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) for line in self.lines]

    def owned(self, entries: list[int]) -> np.ndarray:
        """For each entry whether its first occurrence of all is the one here."""
        out = np.zeros(len(self.lines), bool)
        out[entries] = True
        return out

    def by_length(self) -> np.ndarray:
        """The entries in ascending order of length; keys and pairs name a line by its rank there."""
        return np.argsort(np.array([len(x) for x in self.lines], np.int64), kind="stable")

    def sketches(self) -> bytes:
        """Lengths and counts of characters of all lines, by length."""
        lines = [self.lines[k] for k in self.by_length().tolist()]
        lens = np.array([len(x) for x in lines], "<i8")
        return _pack(lens.tobytes() + np.minimum(_counts(lines), 255).astype(np.uint8).tobytes())


def _counts(lines: list[str]) -> np.ndarray:
    """How often each of 32 classes of characters occurs in each line."""
    x = _codes(lines)
    line = np.repeat(np.arange(len(lines)), np.array([len(k) + 1 for k in lines], np.int64))[: len(x)]
    out = np.bincount(line * 32 + (x & 31), minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)
    out[:-1, ord("\n") & 31] -= 1  # what joins them
    return out


def _sketches(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unpack(raw)
    n = len(raw) // 40
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, 32)


# ---------------------------------------------------------------- dealing


def _write_blocks(docs: DataFrame, name: str, block_bytes: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            ids = np.array([_NULL_RANK if k is None else k for k, _ in held], np.int64)
            raw = [t.encode("utf-8", "surrogatepass") for _, t in held]
            lengths = np.array([len(r) for r in raw], np.int64)
            made = _Lines(ids, [t for _, t in held])
            lines = [made.hashes(), made.rank.tolist(), made.first_line.tolist()]
            values = [number, ids.tobytes(), lengths.tobytes(), _pack(b"".join(raw)), made.sketches(), *lines]
            types = [pa.int64(), *[pa.binary()] * 4, pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            names = ["block", "ids", "lengths", "text", "sketches", "hashes", "ranks", "numbers"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((key, text))
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    files = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "block long, ids binary, lengths binary, text binary, sketches binary, hashes array<binary>, ranks array<long>, numbers array<long>"
    docs.mapInArrow(run, schema).write.bucketBy(files, "block").saveAsTable(name)


def _load(row: pa.Table) -> tuple[int, _Lines]:
    one = row.to_pylist()[0]
    raw = _unpack(one["text"])
    ends = np.cumsum(np.frombuffer(one["lengths"], np.int64)).tolist()
    texts = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
    return one["block"], _Lines(np.frombuffer(one["ids"], np.int64), texts)


def _plan(table: DataFrame, grow: int) -> _Plan:
    """Costs and cuts learnt from a few blocks. They change how many lines meet and when, not which are near."""
    texts = [_unpack(r.text)[:SAMPLE].decode("utf-8", "ignore") for r in table.select("text").take(SAMPLE_BLOCKS)]
    lens = np.sort([len(line) for text in texts for line in text.split("\n")])
    parts = np.searchsorted(np.cumsum(lens), lens.sum() * np.arange(1, PASSES) // PASSES)
    return _Plan(grow, _learn(*_count_pieces(texts)), tuple(lens[parts].tolist()) if len(lens) else ())


def _entries(table: pa.Table) -> list[int]:
    return [k for k, is_own in zip(table.column("entry").to_pylist(), table.column("own").to_pylist()) if is_own]


#: What a bucket says of a block: pairs of its lines with others, or its lines that have a key of very many.
MET = "block long, key long, list binary"
_PAIR = np.dtype([("line", "<i4"), ("other", "<i4"), ("block", "<i8")])


def _pack_pairs(pairs: np.ndarray) -> bytes:
    """Their lines ascend nearly throughout: steps between them, and planes of bytes, pack well."""
    steps = pairs.copy()
    steps["line"][1:] -= pairs["line"][:-1]
    return _pack(steps.view(np.uint8).reshape(-1, _PAIR.itemsize).T.tobytes())


def _unpack_pairs(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(raw), np.uint8).reshape(_PAIR.itemsize, -1)
    pairs = planes.T.copy().reshape(-1).view(_PAIR)
    pairs["line"] = np.cumsum(pairs["line"], dtype=np.int32)
    return pairs


def _send_keys(buckets: int, plan: _Plan, classes: list[int]):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        block, made = _load(row)
        own = made.owned(_entries(answers))
        order = made.by_length()
        ranks = [r for r, k in enumerate(order.tolist()) if own[k] and len(made.lines[k]) >= plan.grow]
        lines = [made.lines[k] for k in order[ranks].tolist()]
        line, place, hashed, _ = plan.keys(lines, classes)
        length = np.array([len(x) for x in lines], np.int32)
        bucket = (hashed >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        used, bounds = _runs(bucket[order])
        words = ((hashed & np.uint64(0x1FFFFFF)) << np.uint64(7) | (place * 128 // length[line]).astype(np.uint64)).astype("<u4")[order]
        line = line[order]
        ranks, length = np.array(ranks, np.int32)[line], length[line]
        sent = [_key_list(words[a:b], ranks[a:b], length[a:b]) for a, b in zip(bounds, bounds[1:])]
        return pa.table({
            "block": pa.array([block] * len(used), pa.int64()), "bucket": pa.array(used, pa.int32()),
            "list": pa.array(sent, pa.binary()),
        })

    return run


def _key_list(words: np.ndarray, ranks: np.ndarray, length: np.ndarray) -> bytes:
    """Keys as they are; what tells their lines ascends nearly throughout, so differences by planes of bytes pack well."""
    steps = np.diff(np.stack((ranks, length)), prepend=np.int32(0)).astype("<i4")
    told = _pack(steps.view(np.uint8).reshape(-1, 4).T.tobytes())
    return np.uint32(len(words)).tobytes() + words.tobytes() + told


def _read_key_list(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    told = np.frombuffer(_unpack(raw[4 + 4 * n :]), np.uint8).reshape(4, 2 * n)
    steps = np.ascontiguousarray(told.T).view("<i4").reshape(2, n)
    return np.frombuffer(raw, "<u4", n, 4), *np.cumsum(steps, axis=1, dtype=np.int32)


def _pairs(group: np.ndarray, place: np.ndarray, length: np.ndarray, block: np.ndarray, line: np.ndarray, part: np.ndarray | None, plan: _Plan):
    """Indices of pairs with one key whose places and lengths fit; all is in ascending order of group and length.

    Given ``part``, only pairs across parts count.
    """
    at, step = np.arange(len(group) - 1), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        # Lengths ascend, so who does not fit one partner fits none beyond it.
        at = at[length[at + step] - length[at] <= length[at] // plan.grow]
        to = at + step
        # What a shared key moves by, and what comes after it, cost an edit a character. Places are known to a 128th.
        n, m = length[at].astype(np.int64), length[to].astype(np.int64)
        before = (2 * place[at] + 1) * n - (2 * place[to] + 1) * m
        fit = np.abs(before) + np.abs(256 * (n - m) - before) <= 256 * (n // plan.grow) + 2 * (n + m)
        fit |= (place[at] == ANYWHERE) | (place[to] == ANYWHERE)
        fit &= (block[at] != block[to]) | (line[at] != line[to])
        if part is not None:
            fit &= part[at] != part[to]
        yield at[fit], to[fit]
        step += 1


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows of columns of numbers, none below zero, in ascending order."""
    bits = [int(c.max()).bit_length() for c in columns]
    if sum(bits) < 64:  # one number a row sorts much faster
        key = np.zeros(len(columns[0]), np.int64)
        for c, b in zip(columns, bits):
            key <<= b
            key |= c
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        out = []
        for b in reversed(bits):
            out.append(key & (1 << b) - 1)
            key >>= b
        return out[::-1]
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    return [c[order[new]] for c in columns]


class _Met:
    """Gathers pairs, and makes rows of them for the blocks of their first lines."""

    #: Pairs held before repeated ones are dropped.
    HELD = 1 << 20

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, block: np.ndarray, line: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        if len(at):
            turned = (block[at] > block[to]) | (block[at] == block[to]) & (line[at] > line[to])
            at, to = np.where(turned, to, at), np.where(turned, at, to)
            self.held.append(np.stack((block[at], line[at], block[to], line[to])))
            self.n += len(at)
            if self.n > 2 * self.HELD:
                self.held = [self.all()]
                self.n = self.held[0].shape[1]
                self.HELD = max(self.HELD, self.n)

    def all(self) -> np.ndarray:
        if not self.held:
            return np.empty((4, 0), np.int64)
        block, line, second, other = np.concatenate(self.held, axis=1).astype(np.int64)
        low = 0xFFFFFFFF
        b, c, line, d, e, other = _distinct([block >> 32, block & low, line, second >> 32, second & low, other])
        return np.stack((b << 32 | c, line, d << 32 | e, other))

    def rows(self) -> list[tuple]:
        first, line, second, other = self.all()
        blocks, bounds = _runs(first)
        out = []
        for block, a, b in zip(blocks, bounds, bounds[1:]):
            pairs = np.empty(b - a, _PAIR)
            pairs["line"], pairs["other"], pairs["block"] = line[a:b], other[a:b], second[a:b]
            out.append((block, None, _pack_pairs(pairs)))
        return out


def _met_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.binary()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "key", "list"), zip(*rows) if rows else [[]] * 3, types)})


def _meet(plan: _Plan, buckets: int, most: int):
    """Pairs of one bucket; members of keys that more than ``most`` lines have, as they are."""

    def run(group: pa.Table) -> pa.Table:
        lists = [_read_key_list(x) for x in group.column("list").to_pylist()]
        blocks = np.array(group.column("block").to_pylist())
        words, line, length = (np.concatenate(x) for x in zip(*lists))
        block = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x[0]) for x in lists])
        # Most keys are a line's alone; a smaller hash tells so of most of them.
        small = words >> np.uint32(7) & np.uint32((1 << 22) - 1)
        shared = np.flatnonzero((np.bincount(small, minlength=1 << 22) > 1)[small])
        words, line, length, block = words[shared], line[shared], length[shared], block[shared]
        order = np.argsort((words >> np.uint32(7)).astype(np.uint64) << np.uint64(32) | length.astype(np.uint64))
        words, line, length, block = words[order], line[order], length[order], blocks[block[order]]
        key, place = words >> np.uint32(7), (words & np.uint32(127)).astype(np.int64)
        rows, met = [], _Met()
        sizes = np.diff(_runs(key)[1])
        many = np.repeat(sizes > FEW, sizes)
        for at, to in _pairs(*(x[~many] for x in (key, place, length, block, line)), None, plan):
            at, to = (np.flatnonzero(~many)[x] for x in (at, to))
            met.add(block, line, at, to)
        key, place, length, block, line = (x[many] for x in (key, place, length, block, line))
        order = np.lexsort((line, block, length, key))
        key, place, length, block, line = (x[order] for x in (key, place, length, block, line))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (line[1:] != line[:-1])
        heads = np.flatnonzero(new)
        place = np.where(np.diff(heads, append=len(key)) > 1, ANYWHERE, place[heads])
        key, length, block, line = (x[heads] for x in (key, length, block, line))
        found, bounds = _runs(key)
        sizes = np.diff(bounds)
        crowded = np.repeat(sizes > most, sizes)
        for k in np.flatnonzero(sizes > most).tolist():
            a, b = bounds[k], bounds[k + 1]
            number = found[k] << 32 | int(group.column("bucket")[0].as_py())
            by_block = a + np.argsort(block[a:b], kind="stable")
            held, cuts = _runs(block[by_block])
            for one, i, j in zip(held, cuts, cuts[1:]):
                at = by_block[i:j]
                raw = line[at].astype("<i4").tobytes() + place[at].astype(np.uint8).tobytes() + length[at].astype("<i4").tobytes()
                rows.append((one, number, _pack(raw)))
        key, place, length, block, line = (x[~crowded] for x in (key, place, length, block, line))
        for at, to in _pairs(key, place, length, block, line, None, plan):
            met.add(block, line, at, to)
        return _met_table(rows + met.rows())

    return run


GATHERED = "block long, n long, list binary"
_MEMBER = np.dtype([("key", "<i8"), ("line", "<i4"), ("place", "u1"), ("length", "<i4")])


def _gather(group: pa.Table) -> pa.Table:
    """All members of a block, and how many lines they are."""
    members = []
    for key, raw in zip(group.column("key").to_pylist(), group.column("list").to_pylist()):
        x = np.frombuffer(_unpack(raw), np.uint8)
        n = len(x) // 9
        one = np.empty(n, _MEMBER)
        one["key"], one["line"], one["place"] = key, x[: 4 * n].copy().view("<i4"), x[4 * n : 5 * n]
        one["length"] = x[5 * n :].copy().view("<i4")
        members.append(one)
    members = np.concatenate(members)
    values = [group.column("block")[0].as_py(), len(np.unique(members["line"])), _pack(members.tobytes())]
    return pa.table({c.split()[0]: pa.array([v]) for c, v in zip(GATHERED.split(", "), values)})


def _meet_parts(plan: _Plan):
    """Pairs of lines of two parts, or of one part, that share keys of very many lines; each pair once, however many keys."""

    def run(group: pa.Table) -> pa.Table:
        blocks = np.array(group.column("block").to_pylist())
        lists = [np.frombuffer(_unpack(x), _MEMBER) for x in group.column("list").to_pylist()]
        sizes = [len(x) for x in lists]
        lists = np.concatenate(lists)
        key, line, place, length = (lists[n].astype(np.int64) for n in _MEMBER.names)
        part, block = (np.repeat(x, sizes) for x in (group.column("part").to_numpy(), blocks))
        order = np.lexsort((length, key))
        line, place, length, key, part, block = (x[order] for x in (line, place, length, key, part, block))
        held = np.unique(blocks)
        members, number = np.unique(np.searchsorted(held, block) << 32 | line, return_inverse=True)
        across = part if group.column("i")[0] != group.column("j")[0] else None
        found = np.zeros((len(members), len(members)), bool)
        for at, to in _pairs(key, place, length, block, line, across, plan):
            found[number[at], number[to]] = True
        met = _Met()
        blocks, lines = held[members >> 32], members & 0xFFFFFFFF
        for first in range(0, len(members), 1024):
            at, to = np.nonzero(found[first : first + 1024])
            met.add(blocks, lines, at + first, to)
        return _met_table(met.rows())

    return run


SKETCHES = "block long, other long, pairs binary, lines binary, sketches binary"


def _merged(answers: pa.Table) -> tuple[np.ndarray, list[int], list[int]]:
    """The distinct pairs of a block's lines, and the blocks of their partners with bounds."""
    pairs = np.concatenate([_unpack_pairs(x) for x in answers.column("list").to_pylist()])
    if len(pairs):
        high, low, line, other = _distinct([pairs["block"] >> 32, pairs["block"] & 0xFFFFFFFF, pairs["line"], pairs["other"]])
        pairs = np.empty(len(line), _PAIR)
        pairs["line"], pairs["other"], pairs["block"] = line, other, high << 32 | low
    return pairs, *_runs(pairs["block"])


def _send_sketches(row: pa.Table, answers: pa.Table) -> pa.Table:
    """Lengths and counts of the lines of a block that have pairs, for each block of their partners."""
    out = []
    if len(answers):
        block = row.column("block")[0].as_py()
        lens, counts = _sketches(row.column("sketches")[0].as_py())
        pairs, to, bounds = _merged(answers)
        for other, a, b in zip(to, bounds, bounds[1:]):
            ranks, of = np.unique(pairs["line"][a:b], return_inverse=True)
            packed = np.stack((of, pairs["other"][a:b])).astype("<i4").tobytes()
            sent = _pack(lens[ranks].tobytes() + counts[ranks].tobytes())
            out.append((other, block, packed, ranks.astype("<i4").tobytes(), sent))
    names, types = [c.split()[0] for c in SKETCHES.split(", ")], [pa.int64()] * 2 + [pa.binary()] * 3
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out) if out else [[]] * len(names), types)})


def _sift(grow: int):
    """Pairs whose lengths and counts of characters let them be near, for the blocks of their first lines."""

    def run(row: pa.Table, sent: pa.Table) -> pa.Table:
        rows = []
        if len(sent):
            block = row.column("block")[0].as_py()
            lens, counts = _sketches(row.column("sketches")[0].as_py())
            for one in sent.to_pylist():
                n, theirs = _sketches(one["sketches"])
                of, others = np.frombuffer(one["pairs"], "<i4").reshape(2, -1)
                most = np.minimum(n[of], lens[others]) // grow
                on = np.flatnonzero(np.abs(n[of] - lens[others]) <= most)
                # An edit changes at most two counts by one.
                apart = np.abs(theirs[of[on]].astype(np.int16) - counts[others[on]]).sum(axis=1)
                on = on[apart <= 2 * most[on]]
                if len(on):
                    pairs = np.empty(len(on), _PAIR)
                    pairs["line"], pairs["other"], pairs["block"] = np.frombuffer(one["lines"], "<i4")[of[on]], others[on], block
                    rows.append((one["other"], None, _pack_pairs(pairs)))
        return _met_table(rows)

    return run


LINES = "block long, other long, lines binary, lengths binary, text binary, ranks binary, numbers binary, pairs binary"


def _send_lines(row: pa.Table, answers: pa.Table) -> pa.Table:
    """The lines of a block that have pairs, for each block of their partners."""
    names = [c.split()[0] for c in LINES.split(", ")]
    types = [pa.int64()] * 2 + [pa.binary()] * 6
    out = []
    if len(answers):
        block, made = _load(row)
        order = made.by_length()
        pairs, to, bounds = _merged(answers)
        for other, a, b in zip(to, bounds, bounds[1:]):
            ranks, of = np.unique(pairs["line"][a:b], return_inverse=True)
            entries = order[ranks]
            raw = [made.lines[k].encode("utf-8", "surrogatepass") for k in entries.tolist()]
            lengths = np.array([len(x) for x in raw], np.int64)
            packed = np.stack((of, pairs["other"][a:b])).astype("<i4")
            values = [entries.astype("<i8"), lengths, _pack(b"".join(raw)), made.rank[entries], made.first_line[entries], packed]
            out.append((other, block, *(x if isinstance(x, bytes) else x.tobytes() for x in values)))
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out) if out else [[]] * len(names), types)})


class _Neighbours:
    """How often each of 256 classes of two characters side by side occurs in each line."""

    #: Characters counted, and pairs of lines compared, in one go.
    CHARS, PAIRS = 1 << 19, 1 << 12

    def __init__(self, lines: list[str]):
        self.lens = np.array([len(x) for x in lines], np.int64)
        self.counts = np.zeros((len(lines), 256), np.uint8)
        begin, size = 0, 0
        for k, n in enumerate(self.lens.tolist()):
            size += n + 1
            if size >= self.CHARS or k + 1 == len(lines):
                self.counts[begin : k + 1] = np.minimum(self._count(lines[begin : k + 1]), 255)
                begin, size = k + 1, 0

    @staticmethod
    def _count(lines: list[str]) -> np.ndarray:
        x = _codes(lines)
        line = np.repeat(np.arange(len(lines)), np.array([len(k) + 1 for k in lines], np.int64))[: len(x) - 1]
        kind = (x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)
        inside = (x[:-1] != ord("\n")) & (x[1:] != ord("\n"))  # a line feed joins two lines
        return np.bincount((line * 256 + kind)[inside], minlength=256 * len(lines)).reshape(-1, 256)

    def fit(self, of: np.ndarray, others: _Neighbours, to: np.ndarray, grow: int) -> np.ndarray:
        """Which pairs have counts that let them be near: an edit takes two neighbourhoods away and makes two, at most."""
        out = np.zeros(len(of), bool)
        for at in range(0, len(of), self.PAIRS):
            i, j = of[at : at + self.PAIRS], to[at : at + self.PAIRS]
            apart = np.abs(self.counts[i].astype(np.int16) - others.counts[j]).sum(axis=1, dtype=np.int32)
            out[at : at + self.PAIRS] = apart <= 4 * (np.minimum(self.lens[i], others.lens[j]) // grow)
        return out


def _batches(sent: list[dict], pairs: list[np.ndarray]) -> Iterator[list[tuple[dict, np.ndarray]]]:
    """What other blocks sent, some blocks of not much text at a time."""
    some, size = [], 0
    for one, own in zip(sent, pairs):
        some.append((one, own))
        size += len(one["text"])
        if size >= _Neighbours.CHARS // 4:
            yield some
            some, size = [], 0
    if some:
        yield some


#: Pairs that wait to be decided at once, about.
TRIED = 1 << 14
LINKS = "block long, entry long, n_links long, rank long, line_no long"


def _join(grow: int):
    """Links of the lines of a block with those sent to it: for each line their number and the earliest linked occurrence."""

    def run(row: pa.Table, sent: pa.Table) -> pa.Table:
        links: dict = {}

        def note(key, when):
            got = links.get(key)
            links[key] = (1, when) if got is None else (got[0] + 1, min(got[1], when))

        if len(sent):
            block, made = _load(row)
            order = made.by_length()
            tried, whose = [], []

            def decide():
                for k in np.flatnonzero(within_all(tried)).tolist():
                    other, entry, rank, number, j = whose[k]
                    note((other, entry), (int(made.rank[j]), int(made.first_line[j])))
                    note((block, j), (rank, number))
                tried.clear()
                whose.clear()

            all_pairs = [np.frombuffer(x, "<i4").reshape(2, -1) for x in sent.column("pairs").to_pylist()]
            needed = order[np.unique(np.concatenate([p[1] for p in all_pairs]))]
            ours, own = _Neighbours([made.lines[k] for k in needed.tolist()]), np.zeros(len(made.lines), np.int64)
            own[needed] = np.arange(len(needed))
            for some in _batches(sent.drop(["pairs"]).to_pylist(), all_pairs):
                lines, entries, ranks, numbers, others, of, to = [], [], [], [], [], [], []
                for one, pairs in some:
                    raw = _unpack(one["text"])
                    ends = np.cumsum(np.frombuffer(one["lengths"], np.int64)).tolist()
                    of.append(pairs[0] + len(lines))
                    to.append(order[pairs[1]])
                    lines.extend(raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends))
                    others.extend([one["other"]] * len(ends))
                    for held, name in ((entries, "lines"), (ranks, "ranks"), (numbers, "numbers")):
                        held.extend(np.frombuffer(one[name], np.int64).tolist())
                of, to = np.concatenate(of), np.concatenate(to)
                on = np.flatnonzero(_Neighbours(lines).fit(of, ours, own[to], grow))
                for at in range(0, len(on), TRIED):
                    for i, j in zip(of[on[at : at + TRIED]].tolist(), to[on[at : at + TRIED]].tolist()):
                        a, b = lines[i], made.lines[j]
                        tried.append((a, b, min(len(a), len(b)) // grow))
                        whose.append((others[i], entries[i], ranks[i], numbers[i], j))
                    if len(tried) >= TRIED:
                        decide()
            decide()
        rows = [(b, e, n, w[0], w[1]) for (b, e), (n, w) in links.items()]
        columns = list(zip(*rows)) or [[]] * 5
        names = [c.split()[0] for c in LINKS.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return run


RESULT = "doc_id long, n_lines long, n_repeats long, n_near long, n_links long, kept_sha256 string"


def _mark(texts: bool):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        _, made = _load(row)
        own = made.owned(_entries(answers))
        links = np.zeros(len(made.lines), np.int64)
        near = np.zeros(len(made.lines), bool)
        for k, n, rank, number in zip(*(answers.column(c).to_pylist() for c in ("entry", "n_links", "rank", "line_no"))):
            if n is not None:
                links[k] = n
                near[k] = (rank, number) < (int(made.rank[k]), int(made.first_line[k]))
        out = []
        for d, (text, found) in enumerate(zip(made.texts, made.occurrences)):
            lines, repeats, nears, n_links, kept = 0, 0, 0, 0, []
            for line, k in zip(text.split("\n"), found):
                if k == -1:
                    kept.append(line)
                    continue
                lines += 1
                if k < 0 or not own[k]:
                    repeats += 1
                elif near[k]:
                    nears += 1
                    n_links += int(links[k])
                else:
                    n_links += int(links[k])
                    kept.append(line)
            left = "\n".join(kept)
            key = int(made.ids[d])
            last = left if texts else hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((None if key == _NULL_RANK else key, lines, repeats, nears, n_links, last))
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [pa.int64()] * 5 + [pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*out), types)})

    return run


def deduplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grow: int = GROW,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    task_lines: int = TASK_LINES,
    texts: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_repeats, n_near, n_links, kept_sha256.

    ``n_lines`` counts non-empty stripped lines, ``n_repeats`` those equal to an
    earlier line, ``n_near`` first occurrences near an earlier line, ``n_links`` the
    links of the distinct lines that first occur here. Both kinds are dropped; what
    is left is joined by line feeds and hashed, or returned in place of the hash with
    ``texts``. Lines are near within one edit for each ``grow`` characters of the
    shorter of two. Null text is empty. Documents with a null id come last; rows of
    one id go by their blocks. An empty table gives no rows. Other columns are not
    looked at.
    """
    spark = docs.sparkSession
    common.tune(spark)
    before = spark.conf.get(_CLEAN, None)
    # Each step ends in a table; what it shuffled need not lie on disk beside the next step's.
    spark.conf.set(_CLEAN, "true")
    try:
        return _deduplicate(docs, id_col, text_col, grow, block_bytes, bucket_bytes, task_lines, texts)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _deduplicate(
    docs: DataFrame, id_col: str, text_col: str, grow: int, block_bytes: int, bucket_bytes: int, task_lines: int, texts: bool
) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes, buckets = sizes(total, block_bytes, bucket_bytes, keys_a_byte=0.2)
    name = f"lines_{uuid.uuid4().hex}"
    _write_blocks(rows, name, block_bytes)
    table = spark.table(name)
    columns = F.arrays_zip(F.col("hashes").alias("hash"), F.col("ranks").alias("rank"), F.col("numbers").alias("number"))
    lines = table.select("block", F.posexplode(columns).alias("entry", "line")).select("block", "entry", "line.*")
    first = F.min(F.struct("rank", "number", "block", "entry")).alias("f")
    own = lines.groupBy("hash").agg(first).select("f.block", "f.entry", F.lit(True).alias("own"))
    own = common.save(spark, own, "first-lines")
    blocks = table.select("block", "ids", "lengths", "text")
    plan, met = _plan(table, grow), None
    for number, classes in enumerate(plan.passes):
        keys = blocks.groupBy("block").cogroup(own.groupBy("block"))
        keys = keys.applyInArrow(_send_keys(buckets, plan, classes), "block long, bucket int, list binary")
        found = keys.groupBy("bucket").applyInArrow(_meet(plan, buckets, min(CROWD, task_lines)), MET)
        found = common.save(spark, found, f"met-lines-{number}")
        met = met.unionByName(found) if met else found

    # Lines with keys of very many are cut into parts, each pair of parts a task for all such keys.
    crowded = met.where("key is not null")
    if not crowded.isEmpty():
        crowded = common.save(spark, crowded.groupBy("block").applyInArrow(_gather, GATHERED), "crowded-lines")
        parts = -(-crowded.agg(F.sum("n")).first()[0] // task_lines)
        placed = crowded.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
        placed = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        tasks = placed.select("block", "list", "part", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"))
        split = tasks.groupBy("i", "j").applyInArrow(_meet_parts(plan), MET)
        met = met.where("key is null").unionByName(split)
    sketches = table.select("block", "sketches")
    told = sketches.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_send_sketches, SKETCHES)
    met = sketches.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_sift(grow), MET)
    met = common.save(spark, met, "sifted-lines")
    sent = blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(_send_lines, LINES)
    linked = blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(_join(grow), LINKS)
    earliest = F.min(F.struct("rank", "line_no"))
    linked = linked.groupBy("block", "entry").agg(F.sum("n_links").alias("n_links"), earliest.alias("f"))
    linked = linked.select("block", "entry", "n_links", F.col("f.rank").alias("rank"), F.col("f.line_no").alias("line_no"))
    final = own.unionByName(linked, allowMissingColumns=True)
    marked = blocks.groupBy("block").cogroup(final.groupBy("block")).applyInArrow(_mark(texts), RESULT)
    out = common.save(spark, marked, "kept-lines")
    spark.sql(f"DROP TABLE {name}")
    return out
