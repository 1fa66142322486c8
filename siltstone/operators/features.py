"""Resemblance features of chunks and their super-features.

Features come from all places of a chunk at once (numpy, Arrow batches);
grouping them into super-features is a column expression. A chunk without
sampled bytes has null features and takes no part in any lookup.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import gear, mix, windows

COUNT = 12
_MULTIPLIERS = np.array([mix(1000 + k) | 1 for k in range(COUNT)], np.uint64)
_OFFSETS = np.array([mix(2000 + k) for k in range(COUNT)], np.uint64)


def odess(data: bytes, sample_bits: int = 7) -> list[int] | None:
    """Twelve maxima of linear maps over the gear hashes whose top ``sample_bits`` bits are zero."""
    hashes = gear(data)
    sample = hashes[hashes >> np.uint64(64 - sample_bits) == 0]
    if not len(sample):
        return None
    return [int(np.max(sample * a + b).view(np.int64)) for a, b in zip(_MULTIPLIERS, _OFFSETS)]


def n_transform(data: bytes, width: int = 64) -> list[int] | None:
    """For each map the low 32 bits of the window hash whose mapped low word is greatest; the last window is left out."""
    hashes = windows(np.frombuffer(data, np.uint8), 257, width)[:-1]
    if not len(hashes):
        return None
    mapped = [(hashes * a + b) & np.uint64(0xFFFFFFFF) for a, b in zip(_MULTIPLIERS, _OFFSETS)]
    return [int(hashes[np.argmax(m)] & np.uint64(0xFFFFFFFF)) for m in mapped]


# Base and modulus of the window hash of the twelve-part features.
PART_BASE, PART_MODULUS, PART_WIDTH = 37, 1_000_000_007, 48


def finesse(data: bytes, width: int = PART_WIDTH) -> list[int] | None:
    """The greatest window hash of each of twelve equal parts; a part below ``width`` bytes gives zero, the last takes the rest."""
    if len(data) < COUNT:
        return None
    part = len(data) // COUNT
    values = np.frombuffer(data, np.uint8)
    out = []
    for k in range(COUNT):
        end = (k + 1) * part if k < COUNT - 1 else len(data)
        hashes = windows(values[k * part : end], PART_BASE, width, PART_MODULUS)
        out.append(int(hashes.max()) if len(hashes) else 0)
    return out if any(out) else None


_KINDS = {"odess": odess, "n_transform": n_transform, "finesse": finesse, "palantir": odess}


def with_features(chunks: DataFrame, kind: str = "odess", sample_bits: int = 7) -> DataFrame:
    """``chunks`` with ``features``: array of twelve longs, or null."""
    make = _KINDS[kind]
    arguments = {"sample_bits": sample_bits} if make is odess else {}

    @F.pandas_udf("array<long>")
    def run(chunk: pd.Series) -> pd.Series:
        return pd.Series([make(bytes(c), **arguments) if c is not None else None for c in chunk])

    return chunks.withColumn("features", run("chunk"))


def _hash(features: Column) -> Column:
    """A 60-bit number of several features: the first digits of their MD5, which any engine can follow."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", features.cast("array<string>"))), 1, 15), 16, 10).cast("long")


def consecutive(features: Column, groups: int, size: int) -> Column:
    """Super-feature i: the hash of features i * size .. i * size + size - 1; as many groups as features copy through."""
    if size == 1:
        return features
    return F.array(*[_hash(F.slice(features, i * size + 1, size)) for i in range(groups)])


def strided(features: Column, groups: int, size: int) -> Column:
    """Super-feature i: the hash of features i, i + groups, ..."""
    return F.array(*[_hash(F.array(*[F.get(features, F.lit(groups * j + i)) for j in range(size)])) for i in range(groups)])


def sorted_groups(features: Column, groups: int, size: int) -> Column:
    """Features in groups of ``size`` are sorted; super-feature i hashes the i-th of each group."""
    ordered = [F.array_sort(F.slice(features, g * size + 1, size)) for g in range(groups)]
    return F.array(*[_hash(F.array(*[F.get(o, F.lit(i)) for o in ordered])) for i in range(size)])


#: Super-features by tier: (tier, groups, features in each).
TIERS = ((1, 3, 4), (2, 4, 3), (3, 6, 2))


def super_features(chunks: DataFrame, kind: str = "odess") -> DataFrame:
    """(chunk_id, tier, sf_pos, sf) of the chunks that have features."""
    has = chunks.where(F.col("features").isNotNull())
    f = F.col("features")
    if kind == "palantir":
        tiers = [(t, consecutive(f, n, size)) for t, n, size in TIERS]
    elif kind == "odess":
        tiers = [(1, consecutive(f, 3, 4))]
    elif kind == "n_transform":
        tiers = [(1, strided(f, 3, 4))]
    else:
        tiers = [(1, sorted_groups(f, 4, 3))]
    each = F.array(*[F.struct(F.lit(t).alias("tier"), sf.alias("sfs")) for t, sf in tiers])
    out = has.select("chunk_id", F.explode(each).alias("t"))
    return out.select("chunk_id", F.col("t.tier").alias("tier"), F.posexplode("t.sfs").alias("sf_pos", "sf"))
