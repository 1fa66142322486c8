"""Cutting bytes into chunks: fixed size, gear and FastCDC, one row a chunk.

Every chunker gives rows (seq, offset, chunk_size, chunk) whose concatenation is
the input. Fixed cuts are DataFrame functions; content-defined cuts hash all
places of a text at once and then only look at the few candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import gear


def fixed(df: DataFrame, content: str, size: int) -> DataFrame:
    """``df`` with a row for each chunk of ``size`` bytes; the last is what remains. Empty content has none."""
    n = F.octet_length(F.col(content))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    cut = df.select("*", F.posexplode(starts).alias("seq", "offset"))
    chunk = F.substring(F.col(content), F.col("offset") + 1, F.lit(size))
    return _finish(cut.withColumn("chunk", chunk), content)


def _finish(df: DataFrame, content: str) -> DataFrame:
    out = df.drop(content) if content != "chunk" else df
    return out.withColumns({"seq": F.col("seq").cast("long"), "offset": F.col("offset").cast("long"), "chunk_size": F.octet_length("chunk").cast("long")})


def fastcdc_masks(average: int, level: int = 1, normalized: bool = True) -> tuple[int, int]:
    """Masks before and after the normal size, on the high bits, which most bytes of the window reach."""
    bits = max(2, int(round(np.log2(average))))
    strict, loose = (bits + level, bits - level) if normalized else (bits - level, bits - level)
    high = lambda k: ((1 << k) - 1) << (63 - k)
    return high(strict), high(loose)


def fastcdc_cuts(data: bytes, least: int, average: int, most: int, normalized: bool = True) -> list[int]:
    """Ends of the chunks: the first candidate place past ``least``, strict up to ``average``, loose up to ``most``."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    hashes = gear(data)
    strict, loose = (np.flatnonzero((hashes & np.uint64(m)) == 0) + 1 for m in fastcdc_masks(average, 1, normalized))
    out, at = [], 0
    while at < n:
        end = min(at + most, n)
        if n - at > least:
            normal = min(at + average, n)
            k = np.searchsorted(strict, at + least + 1)
            if k < len(strict) and strict[k] <= normal:
                end = int(strict[k])
            else:
                k = np.searchsorted(loose, max(normal, at + least) + 1)
                if k < len(loose) and loose[k] <= end:
                    end = int(loose[k])
        out.append(end)
        at = end
    return out


def gear_cuts(data: bytes, mask_bits: int) -> list[int]:
    """Ends of chunks wherever the gear hash has ``mask_bits`` zero bits; no least and no greatest size."""
    n = len(data)
    if not n:
        return []
    mask = np.uint64(((1 << mask_bits) - 1) << (63 - mask_bits))
    ends = (np.flatnonzero((gear(data) & mask) == 0) + 1).tolist()
    return ends if ends and ends[-1] == n else [*ends, n]


def _cut_udf(cuts):
    @F.pandas_udf("array<struct<offset:int,size:int>>")
    def run(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            ends = cuts(bytes(data)) if data is not None else []
            out.append([{"offset": a, "size": b - a} for a, b in zip([0, *ends], ends)])
        return pd.Series(out)

    return run


def content_defined(df: DataFrame, content: str, cuts) -> DataFrame:
    """``df`` with a row for each chunk that ``cuts`` (bytes -> ends) makes."""
    cut = df.select("*", F.posexplode(_cut_udf(cuts)(F.col(content))).alias("seq", "cut"))
    chunk = F.substring(F.col(content), F.col("cut.offset") + 1, F.col("cut.size"))
    return _finish(cut.withColumn("chunk", chunk).withColumn("offset", F.col("cut.offset")).drop("cut"), content)


#: Archives whose members are cut apart, and archives rewritten with their headers last and then cut by content.
ARCHIVES = ("tar", "tar_headers")
REWRITTEN = {"mtar": "fastcdc", "mtar_gear": "gear", "mtar_fastcdc": "fastcdc"}


def chunk(df: DataFrame, content: str = "content", how: str = "fixed", **sizes) -> DataFrame:
    """Dispatch by ``how``.

    ``fixed`` (size), ``fastcdc`` (least, average, most, normalized), ``gear``
    (mask_bits); ``tar`` and ``tar_headers`` (headers, big, least, average, most) add
    kind and parts; ``mtar``, ``mtar_gear`` and ``mtar_fastcdc`` cut the rewritten
    archive, whose chunks restore what ``tar.restore_migrated`` turns back.
    """
    if how == "fixed":
        return fixed(df, content, sizes.get("size", 8192))
    if how == "fastcdc":
        least, average, most = sizes.get("least", 4096), sizes.get("average", 8192), sizes.get("most", 16384)
        normalized = sizes.get("normalized", True)
        return content_defined(df, content, lambda data: fastcdc_cuts(data, least, average, most, normalized))
    if how == "gear":
        bits = sizes.get("mask_bits", 13)
        return content_defined(df, content, lambda data: gear_cuts(data, bits))
    from . import tar

    if how in ARCHIVES:
        headers = sizes.pop("headers", tar.HEADERS) if how == "tar_headers" else None
        return tar.chunk_archives(df, content, headers, **sizes)
    if how in REWRITTEN:
        return chunk(tar.rewrite(df, tar.migrate, content), content, REWRITTEN[how], **sizes)
    raise ValueError(f"no chunker {how!r}")


def utf8(column: str) -> Column:
    """Text as bytes, null as no bytes."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")
