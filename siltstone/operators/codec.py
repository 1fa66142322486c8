"""Local and delta codecs as Arrow functions. The codec of each row is stored with it.

Local: LZ4 blocks, or deflate at its best level; what would not shrink stays raw.
Delta: a Zstandard frame with the whole base as its dictionary, so a chunk of any
size can refer to any part of its base.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

LOCAL = ("lz4", "deflate")
LEVEL = 9


@lru_cache(maxsize=1)
def _lz4() -> pa.Codec:
    return pa.Codec("lz4_raw")


def compress(data: bytes, how: str = "lz4", level: int = LEVEL) -> tuple[str, bytes]:
    if how not in LOCAL:
        raise ValueError(f"no codec {how!r}")
    out = _lz4().compress(data, asbytes=True) if how == "lz4" and data else zlib.compress(data, level)
    return (how, out) if len(out) < len(data) else ("raw", data)


def delta_encode(data: bytes, base: bytes) -> bytes:
    known = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    window = max(10, min(27, (len(data) + len(base)).bit_length()))
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=len(data), dict_size=len(base), window_log=window, write_checksum=False, write_content_size=True, write_dict_id=False
    )
    return zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress(data)


def delta_decode(payload: bytes, base: bytes) -> bytes:
    known = zstandard.ZstdCompressionDict(base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdDecompressor(dict_data=known).decompress(payload)


def decompress(codec: str, payload: bytes, size: int, base: bytes | None = None) -> bytes:
    if codec == "lz4":
        return _lz4().decompress(payload, size, asbytes=True)
    if codec == "deflate":
        return zlib.decompress(payload)
    return delta_decode(payload, base) if codec == "delta" else payload


def local_codec(how: str = "lz4", level: int = LEVEL):
    """Column function: chunk -> struct(codec, payload); what would not shrink stays raw."""

    @F.pandas_udf("struct<codec:string,payload:binary>")
    def run(chunk: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compress(bytes(c), how, level) for c in chunk], columns=["codec", "payload"])

    return run


def delta(chunk, base):
    """Column: the delta of a chunk against a base; null without base."""

    @F.pandas_udf("binary")
    def run(chunk: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else delta_encode(bytes(c), bytes(b)) for c, b in zip(chunk, base)])

    return run(chunk, base)


def decode(codec, payload, size, base):
    """Column: a stored chunk's bytes; ``base`` is only looked at where the codec is ``delta``."""

    @F.pandas_udf("binary")
    def run(codec: pd.Series, payload: pd.Series, size: pd.Series, base: pd.Series) -> pd.Series:
        rows = zip(codec, payload, size, base)
        return pd.Series([decompress(c, bytes(p), int(n), None if b is None else bytes(b)) for c, p, n, b in rows])

    return run(codec, payload, size, base)
