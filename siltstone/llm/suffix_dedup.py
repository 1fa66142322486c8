"""Operator 2: repeated byte strings across documents by sorted suffix tuples of sampled places.

This is not the external induced sorting of every suffix that the operator is
named after: that writes tuples of several times the text in each pass (the
README gives the figures). What is kept of it is the sampling of locally least
places, the external sort of suffix tuples, and the induction of all other
strings' order from theirs. An *anchor* is a place where the hash of ``GRAM``
bytes is least within a window, so equal strings of ``WINDOW`` bytes have the
same anchor at the same place, and every string of WINDOW bytes belongs to just
one anchor.

1. Documents are packed into blocks of a few MB, written once to a bucketed
   table. Each block sends the distinct keys of its anchors, four bytes each,
   to buckets, one row for each bucket that gets any. A bucket answers with a bit
   for each key: seen in two documents or not, and seen in very many blocks or not.
2. Anchors seen twice send their suffix tuple: up to WINDOW bytes to the right,
   up to WINDOW - GRAM to the left, and the least document of the block that has
   it. Tuples travel through Spark's shuffle, whose external sorter merges runs
   from disk. A bucket sorts its tuples by their right sides and by their left
   sides and keeps the common-prefix values of neighbours. The order of the
   strings that begin ``o`` bytes before their anchors is induced from these:
   strings are equal just if no common prefix below WINDOW - o and no common
   suffix below ``o`` lies between them. The least document of each class goes
   back to the block.
3. Each block marks the bytes of strings whose class has a smaller document.

Strings of anchors seen in more than ``HOT_BLOCKS`` blocks are rows of their own,
a 128-bit hash and a document: their minimum is a partial aggregate and an equi-
join, so a string in every block is one row a task before the shuffle. The keys of
a bucket are merged in groups of so many blocks first, likewise. No step emits
pairs: a class sends its minimum. The rows of step 1 are at most one for each
anchor key, so they grow in proportion to the input; blocks and buckets grow up to
``MOST_BLOCK_BYTES`` where a block has fewer keys than there are buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mix64

WINDOW = 50
GRAM = 24
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
#: The most that blocks grow to.
MOST_BLOCK_BYTES = 64 << 20
#: An anchor in more blocks than this sends its strings one by one; a bucket's lists of more blocks are merged in groups.
HOT_BLOCKS = 4096

_NULL_RANK = np.iinfo(np.int64).max  # a document without id comes after all others

_rng_state = np.arange(1, 257, dtype=np.uint64)
_BYTES = (mix64(_rng_state * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_BASE = 0x01000193


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


# ---------------------------------------------------------------- anchors


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes at each place, by doubling."""
    parts, width, out, have = _BYTES[text], 1, None, 0
    rest = gram
    while True:
        if rest & 1:
            if out is None:
                out, have = parts, width
            else:
                n = len(text) - have - width + 1
                out = out[:n] * np.uint32(pow(_BASE, width, 1 << 32)) + parts[have : have + n]
                have += width
        rest >>= 1
        if not rest:
            return out * np.uint32(0x9E3779B1)
        parts = parts[:-width] * np.uint32(pow(_BASE, width, 1 << 32)) + parts[width:]
        width *= 2


def _least_in(values: np.ndarray, span: int) -> np.ndarray:
    """Minima of all ranges of ``span`` values."""
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (span - width)], values[span - width :]) if span > width else values


def anchors(text: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) for each run of strings of one anchor; strings lie within documents."""
    firsts = [np.empty(0, np.int64)]
    lasts, places = list(firsts), list(firsts)
    step = 1 << 18
    begins = np.concatenate(([0], ends[:-1]))
    for at in range(0, max(0, len(text) - window + 1), step):
        part = text[at : at + step + window - 1]
        hashed = _gram_hashes(part, gram).astype(np.uint64) << np.uint64(32)
        hashed |= np.arange(len(hashed), dtype=np.uint64)
        owner = (_least_in(hashed, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        a, b = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + len(part), side="left")
        for s, e in zip(begins[a:b].tolist(), ends[a:b].tolist()):  # no string crosses a document's end
            owner[max(max(s, e - window + 1) - at, 0) : max(e - at, 0)] = -1
        change = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        stop = np.concatenate((change[1:], [len(owner)])) - 1
        real = owner[change] >= 0
        firsts.append(change[real] + at)
        lasts.append(stop[real] + at)
        places.append(owner[change[real]] + at)
    first, last, place = (np.concatenate(x) for x in (firsts, lasts, places))
    if len(place) > 1:  # a run may go on in the next step
        head = np.concatenate(([True], (place[1:] != place[:-1]) | (first[1:] != last[:-1] + 1)))
        tail = np.concatenate((head[1:], [True]))
        first, last, place = first[head], last[tail], place[head]
    return place, first, last


def _rows_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes; the width is a multiple of 8."""
    words = np.ascontiguousarray(rows).view(np.uint64)
    out = np.full(len(words), rows.shape[1], np.uint64)
    for k in range(words.shape[1]):
        out = mix64(out ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(out)


def _bytes_at(text: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, width)[begins] if len(begins) else np.empty((0, width), np.uint8)


def _runs(ordered: np.ndarray) -> tuple[list[int], list[int]]:
    """The distinct values of an ascending array and the bounds of their runs."""
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
    return ordered[heads].astype(np.int64).tolist(), [*heads.tolist(), len(ordered)]


def _key_list(keys: np.ndarray, twice: np.ndarray) -> bytes:
    return np.uint32(len(keys)).tobytes() + keys.tobytes() + np.packbits(twice).tobytes()


def _read_key_lists(lists: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Lengths of key lists, all their keys, and whether two documents of one block have each."""
    sizes = [int.from_bytes(x[:4], "little") for x in lists]
    keys = np.concatenate([np.frombuffer(x, "<u4", n, 4) for x, n in zip(lists, sizes)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=4 + 4 * n), count=n) for x, n in zip(lists, sizes)])
    return sizes, keys, twice > 0


def _bits(seen: np.ndarray, hot: np.ndarray) -> bytes:
    return np.packbits(seen).tobytes() + np.packbits(hot).tobytes()


class _Block:
    """The documents of one block with their anchors; equal for equal content, wherever it runs."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, text: np.ndarray, buckets: int, window: int, gram: int):
        self.ids, self.text, self.buckets, self.window, self.gram = ids, text, buckets, window, gram
        self.ends = np.cumsum(lengths)
        self.place, self.first, self.last = anchors(text, self.ends, window, gram)
        self.doc = np.searchsorted(self.ends, self.place, side="right")
        pad = -gram % 8
        grams = np.zeros((len(self.place), gram + pad), np.uint8)
        grams[:, :gram] = _bytes_at(text, self.place, gram)
        hashed = _rows_hash(grams)
        bucket = (hashed >> np.uint64(32)) % np.uint64(buckets)
        self.keys, self.of_key = np.unique(bucket << np.uint64(32) | hashed & np.uint64(0xFFFFFFFF), return_inverse=True)
        self.used, self.bounds = _runs(self.keys >> np.uint64(32))

    def key_lists(self) -> tuple[list[int], list[bytes]]:
        """Buckets that get keys, and for each: number of keys, the keys ascending, and whether two documents here have each."""
        rank = self.ids[self.doc]
        low = np.full(len(self.keys), _NULL_RANK)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of_key, rank)
        np.maximum.at(high, self.of_key, rank)
        low_keys = (self.keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        twice = low != high
        return self.used, [_key_list(low_keys[a:b], twice[a:b]) for a, b in zip(self.bounds, self.bounds[1:])]

    def tuples(self, answers: dict[int, bytes]) -> None:
        """Suffix tuples of anchors that ``answers`` marks, distinct, in an order that a rerun repeats; strings of hot ones."""
        window, side = self.window, self.window - self.gram
        twice, hot = np.zeros(len(self.keys), bool), np.zeros(len(self.keys), bool)
        bounds = dict(zip(self.used, zip(self.bounds, self.bounds[1:])))
        for bucket, bits in answers.items():
            a, b = bounds[bucket]
            got = np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)
            twice[a:b], hot[a:b] = got[: b - a], got[len(got) // 2 : len(got) // 2 + b - a]
        use = (twice & ~hot)[self.of_key]
        place, first, last, doc = (x[use] for x in (self.place, self.first, self.last, self.doc))
        self._hot_strings((twice & hot)[self.of_key])
        left, right = place - first, last + window - place
        self.rows = np.zeros((len(place), -(-(side + window + 2) // 8) * 8), np.uint8)
        padded = np.concatenate((np.zeros(side, np.uint8), self.text, np.zeros(window, np.uint8)))
        self.rows[:, :side] = _bytes_at(padded, place, side)[:, ::-1]
        self.rows[:, side : side + window] = _bytes_at(padded, place + side, window)
        # Lengths are below 256: one byte a comparison.
        self.rows[:, :side] *= np.arange(side, dtype=np.uint8) < left.astype(np.uint8)[:, None]
        self.rows[:, side : side + window] *= np.arange(window, dtype=np.uint8) < right.astype(np.uint8)[:, None]
        self.rows[:, side + window], self.rows[:, side + window + 1] = left, right
        hashed = _rows_hash(self.rows)
        # Which bucket: by what all documents with the anchor agree on.
        grams = np.zeros((len(place), -(-self.gram // 8) * 8), np.uint8)
        grams[:, : self.gram] = self.rows[:, side : side + self.gram]
        bucket = _rows_hash(grams) % np.uint64(self.buckets)
        order = np.lexsort((hashed, bucket))
        hashed, bucket = hashed[order], bucket[order]
        head = np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (bucket[1:] != bucket[:-1]))) if len(order) else np.empty(0, bool)
        self.of_tuple = np.empty(len(order), np.int64)
        self.of_tuple[order] = np.cumsum(head) - 1
        starts = np.flatnonzero(head)
        self.occurrence = (first, last, doc)
        self.rows = self.rows[order[starts]]
        ranks = self.ids[doc][order]
        self.least = np.minimum.reduceat(ranks, starts) if len(starts) else np.empty(0, np.int64)
        self.tuple_used, self.tuple_bounds = _runs(bucket[starts])

    def _hot_strings(self, use: np.ndarray) -> None:
        """Each string of the anchors in ``use``: its place, document and hash; of each hash the least document here."""
        n = (self.last - self.first + 1)[use]
        self.hot_starts = np.repeat(self.first[use], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.hot_docs = np.repeat(self.doc[use], n)
        raw = np.zeros((len(self.hot_starts), -(-self.window // 8) * 8), np.uint8)
        raw[:, : self.window] = _bytes_at(self.text, self.hot_starts, self.window)
        pair = np.stack((_rows_hash(raw), _rows_hash(raw ^ np.uint8(0xA5))), axis=1)
        distinct, self.of_hot = np.unique(pair, axis=0, return_inverse=True)
        self.of_hot = self.of_hot.reshape(-1)
        self.hot_hashes = [x.tobytes() for x in distinct]
        self.hot_least = np.full(len(distinct), _NULL_RANK)
        np.minimum.at(self.hot_least, self.of_hot, self.ids[self.hot_docs])

    def removed(self, least_of: dict[int, tuple[np.ndarray, np.ndarray]], hot_least: dict[bytes, int]) -> np.ndarray:
        """Bytes covered by strings that a smaller document has.

        ``least_of``: by bucket, counts and least documents; ``hot_least``: by hash of a hot string, its least document.
        """
        first, last, doc = self.occurrence
        counts = np.zeros(len(self.rows), np.int64)
        values = []
        for bucket, a, b in zip(self.tuple_used, self.tuple_bounds, self.tuple_bounds[1:]):
            counts[a:b], found = least_of[bucket]
            values.append(found)
        values = np.concatenate([*values, np.empty(0, np.int64)])
        begins = np.cumsum(counts) - counts
        n = last - first + 1
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        least = values[np.repeat(begins[self.of_tuple], n) + within]
        hit = least < np.repeat(self.ids[doc], n)
        starts = np.zeros(len(self.text) + 1, np.int32)
        starts[(np.repeat(first, n) + within)[hit]] = 1
        if len(self.hot_starts):
            least = np.array([hot_least[h] for h in self.hot_hashes], np.int64)[self.of_hot]
            starts[self.hot_starts[least < self.ids[self.hot_docs]]] = 1
        running = np.cumsum(starts[:-1])
        covered = running.copy()
        covered[self.window :] -= running[: -self.window]
        return covered > 0


def _common_prefix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and how many first bytes each shares with the one before it."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8")
    order = np.lexsort([words[:, k] for k in range(words.shape[1] - 1, -1, -1)])
    ordered = rows[order]
    shared = np.full(len(rows), -1, np.int64)
    differ = ordered[1:] != ordered[:-1]
    shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, shared


def induce(rows: np.ndarray, least: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tuple the number of its strings, and for each string the least document with it."""
    side = window - gram
    left, right = rows[:, side + window].astype(np.int64), rows[:, side + window + 1].astype(np.int64)
    counts = left + right - window + 1
    begins = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    right_order, right_shared = _common_prefix(rows[:, side : side + window])
    left_order, left_shared = _common_prefix(rows[:, :side])
    right_class, left_class = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
    for o in range(side + 1):
        use = np.flatnonzero((left >= o) & (right >= window - o))
        if not len(use):
            continue
        right_class[right_order] = np.cumsum(right_shared < window - o)
        left_class[left_order] = np.cumsum(left_shared < o)
        both = right_class[use] << np.uint64(32) | left_class[use]
        order = np.argsort(both, kind="stable")
        head = np.concatenate(([True], both[order][1:] != both[order][:-1]))
        lows = np.minimum.reduceat(least[use][order], np.flatnonzero(head))
        out[begins[use[order]] + left[use[order]] - o] = lows[np.cumsum(head) - 1]
    return counts, out


# ---------------------------------------------------------------- dealing

BLOCKS = "block long, ids binary, lengths binary, text binary, buckets array<int>, keys array<binary>"


def sizes(total: int, block_bytes: int, bucket_bytes: int, most: int = MOST_BLOCK_BYTES, keys_a_byte: float = 1 / 14) -> tuple[int, int]:
    """Bytes of a block and number of buckets for a text of ``total`` bytes: blocks grow until they have a key for most buckets."""
    while 2 * block_bytes <= most and block_bytes * keys_a_byte < total / bucket_bytes:
        block_bytes, bucket_bytes = 2 * block_bytes, 2 * bucket_bytes
    return block_bytes, max(64, -(-total // bucket_bytes))


def _write_blocks(docs: DataFrame, name: str, buckets: int, window: int, gram: int, block_bytes: int) -> None:
    names = ["block", "ids", "lengths", "text", "buckets", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            ids = np.array([_NULL_RANK if k is None else k for k, _ in held], np.int64)
            lengths = np.array([len(t) for _, t in held], np.int64)
            raw = b"".join(t for _, t in held)
            made = _Block(ids, lengths, np.frombuffer(raw, np.uint8), buckets, window, gram)
            values = [number, ids.tobytes(), lengths.tobytes(), _pack(raw), *made.key_lists()]
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary())]
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

    spark = docs.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(run, BLOCKS).write.bucketBy(files, "block").saveAsTable(name)


ANSWERS = "block long, bucket int, bits binary"


def _answer_keys(hot_blocks: int):
    def run(group: pa.Table) -> pa.Table:
        lengths, keys, twice = _read_key_lists(group.column("list").to_pylist())
        distinct, of, blocks = np.unique(keys, return_inverse=True, return_counts=True)
        seen = blocks > 1
        seen[of[twice]] = True
        seen, hot = seen[of], (blocks > hot_blocks)[of]
        ends = np.cumsum(lengths).tolist()
        bits = [_bits(seen[e - n : e], hot[e - n : e]) for e, n in zip(ends, lengths)]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _merge_keys(group: pa.Table) -> pa.Table:
    """One list of a bucket's keys in one group of blocks, with the number of blocks that have each."""
    _, keys, twice = _read_key_lists(group.column("list").to_pylist())
    distinct, of, blocks = np.unique(keys, return_inverse=True, return_counts=True)
    seen = np.zeros(len(distinct), bool)
    seen[of[twice]] = True
    return pa.table({
        "bucket": group.column("bucket").slice(0, 1), "part": group.column("part").slice(0, 1),
        "list": pa.array([_key_list(distinct, seen)], pa.binary()), "blocks": pa.array([blocks.astype("<u4").tobytes()], pa.binary()),
    })


def _answer_merged(hot_blocks: int):
    """For the merged lists of a bucket, a bit for each key as ``_answer_keys`` gives them."""

    def run(group: pa.Table) -> pa.Table:
        lengths, keys, twice = _read_key_lists(group.column("list").to_pylist())
        blocks = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("blocks").to_pylist()]).astype(np.int64)
        distinct, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, weights=blocks, minlength=len(distinct))
        seen = total > 1
        seen[of[twice]] = True
        seen, hot = seen[of], (total > hot_blocks)[of]
        ends = np.cumsum(lengths).tolist()
        bits = [_bits(seen[e - n : e], hot[e - n : e]) for e, n in zip(ends, lengths)]
        own = [keys[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths)]
        return pa.table({
            "bucket": group.column("bucket"), "part": group.column("part"), "keys": pa.array(own, pa.binary()), "bits": pa.array(bits, pa.binary()),
        })

    return run


def _answer_blocks(lists: pa.Table, answer: pa.Table) -> pa.Table:
    """The answers of a merged list given to each block's own list."""
    lengths, keys, _ = _read_key_lists(lists.column("list").to_pylist())
    known = np.frombuffer(answer.column("keys")[0].as_py(), "<u4")
    got = np.unpackbits(np.frombuffer(answer.column("bits")[0].as_py(), np.uint8)).view(bool)
    at = np.searchsorted(known, keys)
    seen, hot = got[at], got[len(got) // 2 + at]
    ends = np.cumsum(lengths).tolist()
    bits = [_bits(seen[e - n : e], hot[e - n : e]) for e, n in zip(ends, lengths)]
    return pa.table({"block": lists.column("block"), "bucket": lists.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _answers(lists: DataFrame, blocks: int, hot_blocks: int) -> DataFrame:
    """Bits for the keys of each list (block, bucket, list); with very many blocks, groups of blocks are merged first."""
    parts = -(-blocks // hot_blocks)
    if parts == 1:
        return lists.groupBy("bucket").applyInArrow(_answer_keys(hot_blocks), ANSWERS)
    lists = lists.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    merged = lists.groupBy("bucket", "part").applyInArrow(_merge_keys, "bucket int, part int, list binary, blocks binary")
    answer = merged.groupBy("bucket").applyInArrow(_answer_merged(hot_blocks), "bucket int, part int, keys binary, bits binary")
    return lists.groupBy("bucket", "part").cogroup(answer.groupBy("bucket", "part")).applyInArrow(_answer_blocks, ANSWERS)


def _load(row: pa.Table, answers: pa.Table, buckets: int, window: int, gram: int) -> _Block:
    one = row.to_pylist()[0]
    text = np.frombuffer(_unpack(one["text"]), np.uint8)
    made = _Block(np.frombuffer(one["ids"], np.int64), np.frombuffer(one["lengths"], np.int64), text, buckets, window, gram)
    bits = zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist())
    made.tuples({bucket: got for bucket, got in bits if got is not None})
    return made


def _send_tuples(buckets: int, window: int, gram: int):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        made = _load(row, answers, buckets, window, gram)
        cuts = [slice(a, b) for a, b in zip(made.tuple_bounds, made.tuple_bounds[1:])]
        n = len(cuts) + 1  # the last row has the hot strings
        return pa.table({
            "block": pa.array([row.column("block")[0].as_py()] * n, pa.int64()),
            "bucket": pa.array([*made.tuple_used, None], pa.int32()),
            "rows": pa.array([*(_pack(made.rows[c].tobytes()) for c in cuts), None], pa.binary()),
            "least": pa.array([*(_pack(made.least[c].tobytes()) for c in cuts), None], pa.binary()),
            "hashes": pa.array([None] * len(cuts) + [made.hot_hashes], pa.list_(pa.binary())),
            "lows": pa.array([None] * len(cuts) + [made.hot_least.tolist()], pa.list_(pa.int64())),
        })

    return run


def _answer_tuples(window: int, gram: int):
    width = -(-(2 * window - gram + 2) // 8) * 8

    def run(group: pa.Table) -> pa.Table:
        least = [np.frombuffer(_unpack(x), np.int64) for x in group.column("least").to_pylist()]
        rows = np.frombuffer(b"".join(_unpack(x) for x in group.column("rows").to_pylist()), np.uint8)
        counts, found = induce(rows.reshape(-1, width), np.concatenate(least), window, gram)
        ends = np.cumsum([len(x) for x in least])
        stops = np.concatenate(([0], np.cumsum(counts)))
        sent = []
        for end, own in zip(ends.tolist(), least):
            a = end - len(own)
            # Runs of one value: most tuples have a single one.
            part = found[stops[a] : stops[end]]
            head = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            lengths = np.diff(np.concatenate((head, [len(part)])))
            sent.append(_pack(
                np.array([len(own), len(head)], "<i8").tobytes() + counts[a:end].astype(np.uint8).tobytes()
                + lengths.astype("<i8").tobytes() + part[head].tobytes()
            ))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "found": pa.array(sent, pa.binary())})

    return run


def _read_found(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unpack(raw)
    tuples, runs = np.frombuffer(raw, "<i8", 2).tolist()
    counts = np.frombuffer(raw, np.uint8, tuples, 16).astype(np.int64)
    rest = np.frombuffer(raw, "<i8", 2 * runs, 16 + tuples)
    return counts, np.repeat(rest[runs:], rest[:runs])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mark(buckets: int, window: int, gram: int):
    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        made = _load(row, answers, buckets, window, gram)
        found = zip(answers.column("bucket").to_pylist(), answers.column("found").to_pylist())
        hot = zip(answers.column("hash").to_pylist(), answers.column("low").to_pylist())
        gone = made.removed(
            {bucket: _read_found(raw) for bucket, raw in found if raw is not None}, {h: low for h, low in hot if h is not None}
        )
        begins = np.concatenate(([0], made.ends[:-1])).tolist()
        removed, spans, kept = [], [], []
        for b, e in zip(begins, made.ends.tolist()):
            part = gone[b:e]
            removed.append(int(part.sum()))
            if removed[-1]:
                spans.append(int(part[0]) + int((part[1:] & ~part[:-1]).sum()))
                kept.append(hashlib.sha256(made.text[b:e][~part]).hexdigest())
            else:
                spans.append(0)
                kept.append(hashlib.sha256(made.text[b:e]).hexdigest())
        return pa.table({
            "doc_id": pa.array(made.ids, mask=made.ids == _NULL_RANK),
            "n_bytes": pa.array(np.diff(np.concatenate(([0], made.ends)))),
            "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(kept, pa.string()),
        })

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    hot_blocks: int = HOT_BLOCKS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``window`` bytes that covers it also starts in a
    document of smaller id, in the input as given. Null text is empty. A document
    with a null id comes after all that have one. Rows of one id do not count as
    smaller than each other. Texts below ``window`` bytes keep all. An empty table
    gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    common.tune(spark)
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes, buckets = sizes(total, block_bytes, bucket_bytes)
    name = f"blocks_{uuid.uuid4().hex}"
    _write_blocks(rows, name, buckets, window, gram, block_bytes)
    blocks = spark.table(name)
    lists = blocks.select("block", F.inline(F.arrays_zip(F.col("buckets").alias("bucket"), F.col("keys").alias("list"))))
    bits = common.save(spark, _answers(lists, blocks.count(), hot_blocks), "anchor-answers")
    texts = blocks.select("block", "ids", "lengths", "text")
    sent = texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        _send_tuples(buckets, window, gram), "block long, bucket int, rows binary, least binary, hashes array<binary>, lows array<long>"
    )
    if blocks.count() > hot_blocks:  # else nothing is hot
        sent = common.save(spark, sent, "suffix-tuples")
        strings = sent.where("bucket is null").select("block", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("lows").alias("low"))))
        least = strings.groupBy("hash").agg(F.min("low").alias("low"))
        hot = strings.select("block", "hash").join(least, "hash")
    else:
        hot = spark.createDataFrame([], "block long, hash binary, low long")
    tuples = sent.where("bucket is not null").select("block", "bucket", "rows", "least")
    found = tuples.groupBy("bucket").applyInArrow(_answer_tuples(window, gram), "block long, bucket int, found binary")
    answers = bits.unionByName(found, allowMissingColumns=True).unionByName(hot.select("block", "hash", "low"), allowMissingColumns=True)
    marked = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_mark(buckets, window, gram), RESULT)
    out = common.save(spark, marked, "kept")
    spark.sql(f"DROP TABLE {name}")
    return out
