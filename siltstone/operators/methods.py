"""Reduction methods: which unique chunk is a base, which a delta, and against what.

A delta does not register its super-features, so whether a chunk is a base
depends on earlier decisions. ``leaders`` resolves that in rounds over the
bipartite table of chunks and super-features: a chunk becomes a base once no
earlier undecided chunk or base shares any of its super-features, and a delta
once an earlier base does. A round is two minima and two joins; it ends as the
sequential scan would. ``first_seen`` lets every unique chunk register; it is
one pass, and not the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import save
from . import codec, similarity
from .asof import running_totals
from .features import super_features, with_features

#: Feature kind and lookup of each method; position-based and name-based ones add their own matches.
METHODS = {
    "dedup": None,
    "n_transform": ("n_transform", "newest"),
    "finesse": ("finesse", "newest"),
    "odess": ("odess", "oldest"),
    "palantir": ("palantir", "tiered"),
    "hybrid": ("odess", "oldest"),
    "locality": None,
}

#: How much bases are taken to shrink until the first one is stored.
BASE_RATIO = 2.0


def leaders(sfs: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(chunk_id, is_base) of every chunk of ``sfs`` (chunk_id, sf), as a scan in id order decides."""
    spark = sfs.sparkSession
    sfs = save(spark, sfs.select("chunk_id", "sf").distinct(), "super-features")
    state = save(spark, sfs.select("chunk_id").distinct().withColumn("is_base", F.lit(None).cast("boolean")), "leaders")
    for _ in range(max_rounds):
        if state.where("is_base is null").isEmpty():
            return state
        open_ = sfs.join(state, "chunk_id")
        # Deltas leave the table: only what may still register counts.
        alive = open_.where("is_base is null or is_base").groupBy("sf").agg(
            F.min("chunk_id").alias("first"), F.min(F.when(F.col("is_base"), F.col("chunk_id"))).alias("first_base")
        )
        seen = open_.where("is_base is null").join(alive, "sf").groupBy("chunk_id").agg(
            F.min("first").alias("first"), F.min("first_base").alias("first_base")
        )
        decided = seen.select(
            "chunk_id",
            F.when(F.col("first") >= F.col("chunk_id"), True).when(F.col("first_base") < F.col("chunk_id"), False).alias("now"),
        )
        state = state.join(decided, "chunk_id", "left").select("chunk_id", F.coalesce("is_base", "now").alias("is_base"))
        state = save(spark, state, "leaders")
    raise RuntimeError(f"leaders are not resolved after {max_rounds} rounds")


def feature_matches(index: DataFrame, kind: str, lookup: str, exact: bool = True, ages: dict | None = None) -> DataFrame:
    """(chunk_id, base_id) by features. ``index`` has chunk_id, version and chunk."""
    featured = with_features(index.select("chunk_id", "version", "chunk"), kind).select("chunk_id", "version", "features")
    sfs = super_features(featured, kind)
    sfs = save(index.sparkSession, sfs.join(index.select("chunk_id", "version"), "chunk_id"), "sfs")
    if exact:
        # Positional lookups only meet super-features of the same place (or tier).
        place = {"newest": ["sf_pos"], "tiered": ["tier"], "oldest": []}[lookup]
        state = leaders(sfs.select("chunk_id", F.xxhash64(*place, "sf").alias("sf")))
        sfs = sfs.join(state, "chunk_id")
    else:
        sfs = sfs.withColumn("is_base", F.lit(True))
    base = F.col("is_base")
    if lookup == "oldest":
        return similarity.oldest_match(sfs, sfs.where(base))
    if lookup == "newest":
        return similarity.newest_match(sfs, base)
    found = similarity.latest_before(
        sfs, ["tier", "sf"], "chunk_id", F.when(base, F.struct("chunk_id", "version")), "match"
    ).where("match is not null")
    return similarity.best_tier(found, ages).select("chunk_id", "base_id")


def fixed_filter(threshold: int):
    """Accept a name's delta when it shrinks the chunk by at least ``threshold``, in whole numbers."""
    return lambda size, saved: F.floor(size / saved) >= threshold


def adaptive_least(local_in: Column, local_out: Column, delta_gains: Column, deltas: Column, bases: Column, beta: Column) -> Column:
    """What a name's delta must shrink its chunk by: the bases' ratio so far and the gain of deltas that a new base may lose.

    ``local_in`` and ``local_out`` are bytes of bases before and after compression,
    ``delta_gains`` the sum of the deltas' whole-number shrinks; the number of deltas
    a base is whole too. Null, which accepts every delta, until there are bases and deltas.
    """
    ratio = local_in.cast("double") / local_out
    gain = delta_gains.cast("double") / deltas
    least = ratio + gain * F.floor(deltas / bases) * beta
    return F.when((bases > 0) & (deltas > 0) & (local_out > 0), least)


def adaptive_sweep(events: DataFrame, betas: DataFrame) -> DataFrame:
    """(beta, version, named, accepted): name deltas, and those that the adaptive filter accepts, for each ``beta``.

    ``events`` is a chunk log as in ``plans.metrics``; the running figures are those
    of all versions before.
    """
    first = F.col("is_first")
    is_base, is_delta = F.col("store_kind").startswith("base"), F.col("store_kind").startswith("delta")
    shrink = F.floor(F.col("chunk_size") / F.col("save_size"))
    figures = {"bases": (is_base, F.lit(1)), "base_in": (is_base, F.col("chunk_size")), "base_out": (is_base, F.col("save_size")),
               "deltas": (is_delta, F.lit(1)), "gains": (is_delta, shrink)}
    own = events.where(first).groupBy("version").agg(
        *[F.coalesce(F.sum(F.when(when, value)), F.lit(0)).alias(name) for name, (when, value) in figures.items()]
    )
    through = running_totals(own, "version", {f"all_{name}": name for name in figures})
    before = through.select("version", *[(F.col(f"all_{name}") - F.col(name)).alias(name) for name in figures])
    named = events.where(first & (F.col("store_kind") == "delta_name")).select("version", shrink.alias("shrink"))
    # A few parameter values beside every row.
    rows = named.groupBy("version", "shrink").agg(F.count("*").alias("n")).join(before, "version").crossJoin(F.broadcast(betas))
    least = adaptive_least(*(F.col(c) for c in ("base_in", "base_out", "gains", "deltas", "bases", "beta")))
    accepted = F.sum(F.when(least.isNull() | (F.col("shrink") >= least), F.col("n")).otherwise(0))
    return rows.groupBy("beta", "version").agg(F.sum("n").alias("named"), accepted.alias("accepted"))


def fixed_sweep(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, named, accepted): name deltas, and those that shrink their chunk by at least ``threshold`` in whole numbers."""
    shrink = F.floor(F.col("chunk_size") / F.col("save_size"))
    named = events.where(F.col("is_first") & (F.col("store_kind") == "delta_name")).groupBy(shrink.alias("shrink")).agg(F.count("*").alias("n"))
    accepted = F.sum(F.when(F.col("shrink") >= F.col("threshold"), F.col("n")).otherwise(0))
    return named.crossJoin(F.broadcast(thresholds)).groupBy("threshold").agg(F.sum("n").alias("named"), accepted.alias("accepted"))


def reduce(
    index: DataFrame, method: str = "odess", exact: bool = True, local: str = "lz4", accept=None, positions: DataFrame | None = None,
    least_ratio: float | None = None,
) -> DataFrame:
    """Stored chunks: chunk_id, store_kind, base_chunk_id, chunk_size, save_size, codec, payload.

    ``index`` has chunk_id, version, seq, chunk_size, chunk, and for ``hybrid`` also
    name_hash; it is read several times, so it should be a written table. A delta that is not smaller than its chunk is stored as a base would
    be, and nobody's base. ``accept`` (size, saved size -> condition) filters name
    deltas of ``hybrid``; a rejected one still stands when features find the same
    base. ``locality`` takes its matches from ``positions`` (chunk_id, guess). ``local``
    names the codec of bases. A delta must shrink its chunk by ``least_ratio`` at least;
    for ``palantir`` that is what the bases before it have shrunk by, ``BASE_RATIO``
    before the first.
    """
    spark = index.sparkSession
    none = F.lit(None).cast("long")
    if method == "dedup":
        matches = index.select("chunk_id", none.alias("base_id"), F.lit("base").alias("by")).where(F.lit(False))
    elif method == "locality":
        unique = index.select(F.col("chunk_id").alias("guess"))
        found = positions.select("chunk_id", "guess").join(unique, "guess")
        # A guess that is a delta itself would chain: only chunks without a guess are bases.
        free = index.select("chunk_id").join(found, "chunk_id", "left_anti").select(F.col("chunk_id").alias("guess"))
        matches = found.join(free, "guess", "left_semi").select("chunk_id", F.col("guess").alias("base_id"), F.lit("position").alias("by"))
    else:
        kind, lookup = METHODS[method]
        ages = similarity.AGES if method == "palantir" else None
        by_feature = feature_matches(index, kind, lookup, exact, ages)
        matches = by_feature.select("chunk_id", "base_id", F.lit("feature").alias("by"))
        if method == "hybrid":
            matches = _hybrid(index, by_feature, accept or fixed_filter(1))
    # Bases are never deltas: a match whose base matched something itself falls away.
    matches = save(spark, matches, "matches")
    matched = matches.select(F.col("chunk_id").alias("base_id"))
    matches = matches.join(matched, "base_id", "left_anti")
    bases = index.select(F.col("chunk_id").alias("base_id"), F.col("chunk").alias("base_chunk"))
    joined = index.select("chunk_id", "chunk_size", "chunk").join(
        matches.join(bases, "base_id"), "chunk_id", "left"
    )
    coded = joined.withColumn("delta", codec.delta("chunk", "base_chunk")).withColumn("local", codec.local_codec(local)("chunk"))
    least = F.lit(least_ratio or 1.0)
    if method == "palantir" and least_ratio is None:
        coded = _with_running_ratio(save(spark, coded.drop("chunk", "base_chunk"), "coded"))
        least = F.col("least")
    saved = F.octet_length("delta")
    use = F.col("delta").isNotNull() & (saved < F.col("chunk_size")) & (F.col("chunk_size") >= least * saved)
    payload = F.when(use, F.col("delta")).otherwise(F.col("local.payload"))
    kind = F.when(use, F.concat(F.lit("delta_"), "by")).when(F.col("local.codec") == "raw", "base_raw").otherwise("base_lz")
    return coded.select(
        "chunk_id",
        kind.alias("store_kind"),
        F.when(use, F.col("base_id")).alias("base_chunk_id"),
        "chunk_size",
        F.octet_length(payload).cast("long").alias("save_size"),
        F.when(use, "delta").otherwise(F.col("local.codec")).alias("codec"),
        payload.alias("payload"),
    )


def _with_running_ratio(coded: DataFrame) -> DataFrame:
    """``coded`` with ``least``: bytes of the chunks without a match that come before, by their bytes after compression."""
    is_base = F.col("delta").isNull()
    sizes = coded.select(
        "chunk_id", F.when(is_base, F.col("chunk_size")).otherwise(0).alias("own_in"),
        F.when(is_base, F.octet_length("local.payload")).otherwise(0).cast("long").alias("own_out"),
    )
    through = running_totals(sizes, "chunk_id", {"all_in": "own_in", "all_out": "own_out"})
    before_in, before_out = F.col("all_in") - F.col("own_in"), F.col("all_out") - F.col("own_out")
    least = F.when(before_out > 0, before_in / before_out).otherwise(BASE_RATIO).alias("least")
    return coded.join(through.select("chunk_id", least), "chunk_id")


def _hybrid(index: DataFrame, by_feature: DataFrame, accept) -> DataFrame:
    """Name matches first; rejected ones and chunks without go by features.

    The chunks that features made bases are the possible bases of names, so depth stays one.
    """
    free = index.join(by_feature, "chunk_id", "left_anti").select("chunk_id")
    marked = index.select("chunk_id", "version", "name_hash").join(free.withColumn("free", F.lit(True)), "chunk_id", "left")
    by_name = similarity.name_match(marked, base=F.col("free"))
    bases = index.select(F.col("chunk_id").alias("base_id"), F.col("chunk").alias("base_chunk"))
    sized = index.select("chunk_id", "chunk_size", "chunk").join(by_name.join(bases, "base_id"), "chunk_id")
    sized = sized.select("chunk_id", "base_id", "chunk_size", F.octet_length(codec.delta("chunk", "base_chunk")).alias("saved"))
    both = sized.join(by_feature.select("chunk_id", F.col("base_id").alias("feature_base")), "chunk_id", "left")
    keep = accept(F.col("chunk_size"), F.col("saved")) | (F.col("base_id") == F.coalesce("feature_base", F.lit(-1)))
    named = both.where(keep).select("chunk_id", "base_id", F.lit("name").alias("by"))
    # A base that took a name's delta must not serve others: features of its followers win.
    serving = by_feature.select(F.col("base_id").alias("chunk_id"))
    named = named.join(serving, "chunk_id", "left_anti")
    taken = by_feature.join(named, "chunk_id", "left_anti")
    return named.unionByName(taken.select("chunk_id", "base_id", F.lit("feature").alias("by")))
