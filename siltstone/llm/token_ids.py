"""Operator 1: token ids as directly addressable codes.

A segment holds the ids of consecutive documents. Each id is cut into 8-bit
chunks, lowest first. Level ``k`` stores chunk ``k`` of every id that has one,
next to a continuation bitmap (bit set: the id goes on at level ``k + 1``)
and a rank directory (set bits before each block of 512). The place of an id
at the next level is the rank of its bit, so any id is read with at most four
byte reads and three ranks; nothing is decoded around it.

Segments are rows of a Parquet table, written by Spark and so on any store:
``part`` (range of documents), ``segment`` (within the part), ``doc_ids`` and
``ends`` (64-bit, the end of each document within the segment), ``n_tokens``,
``levels``, ``bitmaps`` and ``ranks``. ``part`` and ``segment`` ascend with the
document id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_BITS = 512
SEGMENT_TOKENS = 1 << 20
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)

SEGMENTS = (
    "part int, segment int, n_docs int, n_tokens long, doc_ids binary, doc_nulls binary, ends binary, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


# ---------------------------------------------------------------- the code


def encode_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, continuation bitmaps and rank directories of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            return levels, bitmaps, ranks
        packed = np.packbits(more, bitorder="little")
        ones = _BYTE_ONES[packed].astype(np.uint32)
        blocks = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK_BITS // 8))
        bitmaps.append(packed.tobytes())
        ranks.append(np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u4").tobytes())
        rest = rest[more]


def decode_levels(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.frombuffer(levels[-1], np.uint8).astype(np.uint32)
    for level, bitmap in zip(levels[-2::-1], bitmaps[::-1]):
        low = np.frombuffer(level, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(low), bitorder="little").view(bool)
        low[more] |= out << np.uint32(8)
        out = low
    return out


def access(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i`` of a segment, from a few bytes of each level."""
    value = 0
    for k, level in enumerate(levels):
        value |= level[i] << 8 * k
        if k == len(bitmaps) or not bitmaps[k][i >> 3] >> (i & 7) & 1:
            return value
        block = i // BLOCK_BITS
        begin = block * (BLOCK_BITS // 8)
        before = int.from_bytes(ranks[k][4 * block : 4 * block + 4], "little")
        before += int.from_bytes(bitmaps[k][begin : i >> 3], "little").bit_count()
        i = before + (bitmaps[k][i >> 3] & (1 << (i & 7)) - 1).bit_count()
    return value


# ---------------------------------------------------------------- writing


def _segment(part: int, number: int, rows: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(r[1] for r in rows), "<u4")
    levels, bitmaps, ranks = encode_levels(ids)
    ends = np.cumsum([len(r[1]) // 4 for r in rows]).astype("<i8")
    values = [
        part, number, len(rows), len(ids),
        np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
        np.array([r[0] is None for r in rows], np.uint8).tobytes(),
        ends.tobytes(), levels, bitmaps, ranks,
    ]
    lists = pa.list_(pa.binary())
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), lists, lists, lists]
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode whole texts, each with ``end_id`` after it, in ascending id order, to ``path``.

    Null text is empty. Null ids come first; rows of one id go by their text's first
    ``common.HEAD`` characters, and by their whole text as far as one task holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                held.append((key, ids + end))
                size += len(ids) // 4 + 1
                if size >= segment_tokens:
                    yield _segment(part, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _segment(part, number, held)

    common.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common.in_order(rows).mapInArrow(run, SEGMENTS).write.parquet(path)


# ---------------------------------------------------------------- reading


def open_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def documents(segments: DataFrame) -> DataFrame:
    """Per document of the files: part, segment, place, doc_id, local start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_levels(row["levels"], row["bitmaps"]).astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                nulls = np.frombuffer(row["doc_nulls"], np.uint8).view(bool)
                n = row["n_docs"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls),
                        pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64()),
                    ],
                    ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    schema = "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long"
    return segments.mapInArrow(run, schema)


def tokens_at(segments: DataFrame, part: int, segment: int, places: list[int]) -> list[int]:
    """Random access: ids at places of one segment, without decoding it."""
    row = segments.where((F.col("part") == part) & (F.col("segment") == segment)).first()
    return [access(row["levels"], row["bitmaps"], row["ranks"], i) for i in places]


def digest(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 0,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> DataFrame:
    """Write the ids, read the files back: doc_id, start, n_tokens, ids_crc32 of each document.

    Null text: only the end id. Null doc_id: a row like the others, before them.
    Repeated rows each have their place. An empty table gives no rows. Other
    columns of ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    path = path or f"{common.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, vocabulary or tokens.vocabulary_path(), end_id, id_col, text_col, segment_tokens)
    segments = open_segments(spark, path)
    # One row for each segment of about a million tokens: running sums within a part are a
    # window; the driver gets one number for each part, as many as the write had tasks.
    sizes = segments.select("part", "segment", "n_tokens")
    totals = sorted(sizes.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, starts = 0, []
    for part, n in totals:
        starts.append((part, before))
        before += n
    parts = spark.createDataFrame(starts, "part int, before_part long")
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.join(F.broadcast(parts), "part").select(
        "part", "segment", (F.col("before_part") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).alias("first")
    )
    return (
        documents(segments)
        .join(firsts, ["part", "segment"])
        .select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
    )
