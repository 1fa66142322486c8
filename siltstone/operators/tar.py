"""Archives: parse, cut by members, move headers behind payloads and back.

An archive is walked header by header, so its cuts come from a Python function
over whole binaries; what the header fields mean is in ``functions.names`` as
column functions and, for the walk, here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import BATCH_BYTES, bound_batches, whole_udf
from .chunking import fastcdc_cuts

BLOCK = 512
BIG = 4 << 20
HEADERS = 16
# Type flags whose members have a payload; x, g and L, K carry names and attributes.
_REGULAR = frozenset(b"0\x007xgLK")
_LONG = frozenset(b"xgLK")


def _size(header: bytes) -> int:
    field = header[124:136]
    if field[0] & 0x80:  # GNU base-256 for very large members
        return int.from_bytes(field[1:], "big")
    digits = field.split(b"\0")[0].strip()
    return int(digits, 8) if digits else 0


def members(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, offset, size) in order: ``header``, ``long`` or ``file`` pieces of whole blocks; what is left is ``tail``."""
    out, at = [], 0
    while at + BLOCK <= len(data):
        header = data[at : at + BLOCK]
        if not any(header):
            break
        size = _size(header) if header[156] in _REGULAR else 0
        out.append(("header", at, BLOCK))
        at += BLOCK
        padded = min((size + BLOCK - 1) // BLOCK * BLOCK, len(data) - at)
        if padded:
            out.append(("long" if header[156] in _LONG else "file", at, padded))
            at += padded
    if at < len(data):
        out.append(("tail", at, len(data) - at))
    return out


def tar_cuts(data: bytes, big: int = BIG, least: int = 4096, average: int = 8192, most: int = 16384) -> list[tuple[str, int, int]]:
    """Pieces by member; payloads above ``big`` are cut by content."""
    out = []
    for kind, at, size in members(data):
        if kind == "file" and size > big:
            begin = 0
            for end in fastcdc_cuts(data[at : at + size], least, average, most):
                out.append(("cdc", at + begin, end - begin))
                begin = end
        else:
            out.append((kind, at, size))
    return out


def grouped_headers(data: bytes, headers: int = HEADERS, **options) -> list[tuple[str, list[tuple[int, int]]]]:
    """Chunks as lists of (offset, size): up to ``headers`` headers, with their long names, share a chunk.

    A group ends before a big member's content, and never between a header and its own payload.
    """
    out, held, after, names = [], [], [], 0

    def flush():
        nonlocal names
        out.extend(after)
        if held:
            out.append(("header", list(held)))
        held.clear()
        after.clear()
        names = 0

    for kind, at, size in tar_cuts(data, **options):
        if kind == "header":
            if names == headers:
                flush()
            held.append((at, size))
            names += 1
        elif kind == "long":
            held.append((at, size))
        elif kind == "file":
            after.append(("file", [(at, size)]))
        else:
            flush()
            out.append((kind, [(at, size)]))
    flush()
    return out


def migrate(data: bytes) -> bytes:
    """Length of the payloads, all payload blocks, then all header blocks."""
    body, heads = [], []
    for kind, at, size in members(data):
        (body if kind == "file" else heads).append(data[at : at + size])
    payload = b"".join(body)
    return struct.pack("<Q", len(payload)) + payload + b"".join(heads)


def restore_migrated(data: bytes) -> bytes:
    """The archive that ``migrate`` rewrote."""
    (n,) = struct.unpack_from("<Q", data)
    body, heads, out, at, used = data[8 : 8 + n], data[8 + n :], [], 0, 0
    while at + BLOCK <= len(heads):
        header = heads[at : at + BLOCK]
        if not any(header):
            break
        out.append(header)
        at += BLOCK
        flag = header[156]
        padded = (_size(header) + BLOCK - 1) // BLOCK * BLOCK if flag in _REGULAR else 0
        if flag in _LONG:
            out.append(heads[at : at + padded])
            at += padded
        else:
            out.append(body[used : used + padded])
            used += min(padded, len(body) - used)
    out.append(heads[at:])
    return b"".join(out)


def rewrite(df: DataFrame, f, content: str = "content") -> DataFrame:
    """``df`` with ``f`` (bytes -> bytes) of each archive in its place.

    Rows pass through Python whole, so no copy of an archive waits for its result,
    and results leave in batches of about ``BATCH_BYTES`` however many archives came in one.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, made = 0, 0, []
            for k, x in enumerate(batch.column(at), 1):
                made.append(f(x.as_buffer().to_pybytes()) if x.is_valid else None)
                size += len(made[-1] or b"")
                if size >= BATCH_BYTES or k == batch.num_rows:
                    part = batch.slice(begin, k - begin)
                    yield part.set_column(at, content, pa.array(made, pa.binary()))
                    begin, size, made = k, 0, []

    return df.mapInArrow(run, df.schema)


def chunk_archives(df: DataFrame, content: str = "content", headers: int | None = None, **options) -> DataFrame:
    """``df`` with a row for each chunk: seq, kind, parts (offset, size), chunk, chunk_size. Parts restore the order."""

    @whole_udf("array<struct<kind:string,parts:array<struct<offset:long,size:long>>,chunk:binary>>")
    def run(archives: pd.Series) -> pd.Series:
        out = []
        for data in archives:
            data = bytes(data or b"")
            if headers is None:
                cut = [(kind, [(at, size)]) for kind, at, size in tar_cuts(data, **options)]
            else:
                cut = grouped_headers(data, headers, **options)
            out.append([
                {"kind": kind, "parts": [{"offset": a, "size": n} for a, n in parts], "chunk": b"".join(data[a : a + n] for a, n in parts)}
                for kind, parts in cut
            ])
        return pd.Series(out)

    rows = df.select("*", F.posexplode(run(F.col(content))).alias("seq", "c")).drop(content)
    return rows.select(*[c for c in rows.columns if c not in ("c", "seq")], F.col("seq").cast("long").alias("seq"), "c.*").withColumn(
        "chunk_size", F.octet_length("chunk").cast("long")
    )


def restore_archives(chunks: DataFrame) -> DataFrame:
    """(version, content) from chunks with parts, in the order of the parts' offsets."""

    @whole_udf("binary")
    def run(pieces: pd.Series) -> pd.Series:
        out = []
        for rows in pieces:
            placed = []
            for row in rows:
                at, data = 0, bytes(row["chunk"])
                for part in row["parts"]:
                    placed.append((part["offset"], data[at : at + part["size"]]))
                    at += part["size"]
            out.append(b"".join(x for _, x in sorted(placed)))
        return pd.Series(out)

    grouped = chunks.groupBy("version").agg(F.collect_list(F.struct("parts", "chunk")).alias("pieces"))
    return grouped.select("version", run("pieces").alias("content"))


def pack_archives(df: DataFrame, name: str, content: str, order: str | None = None) -> DataFrame:
    """(version, content): an archive of each row, or, with ``order``, of all rows of a version in that order; for demonstrations."""
    import io
    import tarfile

    @whole_udf("binary")
    def run(members: pd.Series) -> pd.Series:
        out = []
        for rows in members:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w", format=tarfile.GNU_FORMAT) as tar:
                for row in rows:
                    info = tarfile.TarInfo(row["name"])
                    info.size = len(row["body"])
                    tar.addfile(info, io.BytesIO(bytes(row["body"])))
            out.append(buffer.getvalue())
        return pd.Series(out)

    member = F.struct(*([F.col(order).alias("place")] if order else []), F.col(name).alias("name"), F.col(content).alias("body"))
    if order is None:
        return df.select("version", run(F.array(member)).alias("content"))
    members = df.groupBy("version").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return members.select("version", run("members").alias("content"))
