"""Lookups of similar bases: super-feature, tiered and aged, name and position matches.

The index side is reduced to one row a key (oldest) or found by a ranged
window (newest), so a super-feature that very many chunks share never meets
itself in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import latest_before


def oldest_match(sfs: DataFrame, bases: DataFrame | None = None) -> DataFrame:
    """(chunk_id, base_id): the first super-feature, by place, that an earlier base has, and the oldest such base.

    ``sfs`` is (chunk_id, sf_pos, sf); ``bases`` limits who may be a base (chunk_id), else all chunks may.
    """
    owners = sfs if bases is None else sfs.join(bases.select("chunk_id"), "chunk_id", "left_semi")
    oldest = owners.groupBy("sf").agg(F.min("chunk_id").alias("base_id"))
    hits = sfs.join(oldest, "sf").where("base_id < chunk_id")
    return hits.groupBy("chunk_id").agg(F.min(F.struct("sf_pos", "base_id")).alias("hit")).select("chunk_id", "hit.base_id")


def newest_match(sfs: DataFrame, base: Column | None = None) -> DataFrame:
    """(chunk_id, base_id): the first place whose super-feature an earlier base has there, and the newest such base.

    ``base`` is a condition on ``sfs`` for who may be a base.
    """
    value = F.col("chunk_id") if base is None else F.when(base, F.col("chunk_id"))
    found = latest_before(sfs, ["sf_pos", "sf"], "chunk_id", value, "base_id").where("base_id is not null")
    return found.groupBy("chunk_id").agg(F.min(F.struct("sf_pos", "base_id")).alias("hit")).select("chunk_id", "hit.base_id")


def tiered_match(sfs: DataFrame, ages: dict[int, int] | None = None, order: str = "chunk_id", probe: Column | None = None) -> DataFrame:
    """(chunk_id, tier, base_id): all of tier 1 first, then 2, then 3; each super-feature has its latest base only.

    With ``ages``, a tier's match must be at most so many versions old; ``sfs`` then has
    ``version``. For duplicates that refresh their base, ``sfs`` has a row for every
    occurrence, by ``order``; ``probe`` says which rows ask.
    """
    value = F.struct("chunk_id", "version") if ages else F.struct("chunk_id")
    found = latest_before(sfs, ["tier", "sf"], order, value, "match").where("match is not null")
    if probe is not None:
        found = found.where(probe)
    return best_tier(found, ages)


def best_tier(found: DataFrame, ages: dict[int, int] | None) -> DataFrame:
    """The first tier and place whose ``match`` (chunk_id, version) is young enough."""
    for tier, age in (ages or {}).items():
        found = found.where((F.col("tier") != tier) | (F.col("version") - F.col("match.version") <= age))
    best = F.min(F.struct("tier", "sf_pos", F.col("match.chunk_id").alias("base_id"))).alias("hit")
    return found.groupBy("chunk_id").agg(best).select("chunk_id", "hit.tier", "hit.base_id")


#: Versions after which tiers 2 and 3 forget a super-feature.
AGES = {2: 5, 3: 2}


def name_match(chunks: DataFrame, name: str = "name_hash", base: Column | None = None) -> DataFrame:
    """(chunk_id, base_id): the latest earlier base of the same name, from version 1 on."""
    value = F.col("chunk_id") if base is None else F.when(base, F.col("chunk_id"))
    found = latest_before(chunks, [name], "chunk_id", value, "base_id")
    return found.where("base_id is not null and version > 0").select("chunk_id", "base_id")


def resolved(matches: DataFrame, index: DataFrame) -> DataFrame:
    """Matches that are deltas replaced by their own base."""
    own = index.select(F.col("chunk_id").alias("base_id"), F.col("base_chunk_id").alias("_of"))
    return matches.join(own, "base_id", "left").select("chunk_id", F.coalesce("_of", "base_id").alias("base_id"))


def position_match(events: DataFrame) -> DataFrame:
    """(version, seq, guess): the last duplicate's id plus the unique chunks since, where that lies before the newest id.

    ``events`` is (version, seq, chunk_id, is_new) in recipe order; gaps reset with each version.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("version").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("is_new"), F.col("chunk_id")), ignorenulls=True).over(before)
    at = F.last(F.when(~F.col("is_new"), F.col("seq")), ignorenulls=True).over(before)
    found = events.withColumn("guess", last + F.col("seq") - at)
    return found.where("is_new and version > 0 and guess is not null and guess < chunk_id - 1").select("version", "seq", "chunk_id", "guess")


def similar_counts(sfs: DataFrame) -> DataFrame:
    """(sf, n_chunks) of super-features that several chunks share."""
    return sfs.groupBy("sf").agg(F.countDistinct("chunk_id").alias("n_chunks")).where("n_chunks > 1")


def similar_chunks(sfs: DataFrame) -> DataFrame:
    """Chunks that share a super-feature with any other."""
    return sfs.join(similar_counts(sfs), "sf", "left_semi").select("chunk_id").distinct()


def motivation_cases(feature: DataFrame, name: DataFrame) -> DataFrame:
    """How feature and name matches agree: same, different, only_feature, only_name."""
    both = feature.select("chunk_id", F.col("base_id").alias("f")).join(
        name.select("chunk_id", F.col("base_id").alias("n")), "chunk_id", "full"
    )
    case = F.when(F.col("n").isNull(), "only_feature").when(F.col("f").isNull(), "only_name").when(F.col("f") == F.col("n"), "same").otherwise("different")
    return both.groupBy(case.alias("case")).agg(F.count("*").alias("n"))


def put_records(records: DataFrame, new: DataFrame) -> DataFrame:
    """Feature records (key, ...) with those of ``new`` in place of their older ones."""
    return delete_records(records, new).unionByName(new)


def delete_records(records: DataFrame, gone: DataFrame) -> DataFrame:
    return records.join(gone.select("key").distinct(), "key", "left_anti")
