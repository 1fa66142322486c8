"""Reduction figures over a chunk-event table.

``events``: version, seq, chunk_id, fp, kind, store_kind, chunk_size, save_size,
is_first. ``save_size`` is what a unique chunk takes; duplicates take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import running_totals

RECIPE_ENTRY = 32
#: Index bytes: a fingerprint entry of each unique chunk, a super-feature entry of each base.
FP_ENTRY, SF_ENTRY, HYBRID_SF_ENTRY = 120, 120, 160
#: The name-aware index: fingerprint, metadata and recipe of each unique chunk, then each base, then each name.
UNIQUE_ENTRY, BASE_ENTRY, NAME_ENTRY = 40 + 64 + 8, 48, 12


#: The columns of ``counts``.
COUNTS = (
    "logical_chunks", "unique_chunks", "base_chunks", "delta_chunks", "logical_bytes", "stored_bytes", "base_bytes", "delta_bytes", "ocr",
    "ocr_with_recipe", "dcc", "dcr", "dce", "dce2", "base_ratio",
)


def _conditions() -> tuple[Column, Column, Column]:
    """Whether a row is the first of its chunk, a base's, a delta's."""
    kind = F.col("store_kind")
    return F.col("is_first"), kind.startswith("base"), kind.startswith("delta")


def _sum(value: str, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0))


def counts(events: DataFrame) -> DataFrame:
    """One row: logical, unique, base and delta chunks and bytes, ratios."""
    first, is_base, is_delta = _conditions()
    logical, stored = F.sum("chunk_size"), _sum("save_size", first)
    delta_in, delta_out = _sum("chunk_size", first & is_delta), _sum("save_size", first & is_delta)
    ratio = F.when(first & is_delta, F.col("chunk_size") / F.col("save_size"))
    return events.agg(
        F.count("*").alias("logical_chunks"),
        F.count_if(first).alias("unique_chunks"),
        F.count_if(first & is_base).alias("base_chunks"),
        F.count_if(first & is_delta).alias("delta_chunks"),
        logical.alias("logical_bytes"),
        stored.alias("stored_bytes"),
        _sum("save_size", first & is_base).alias("base_bytes"),
        delta_out.alias("delta_bytes"),
        F.round(F.try_divide(logical, stored), 6).alias("ocr"),
        F.round(F.try_divide(logical, stored + RECIPE_ENTRY * F.count("*")), 6).alias("ocr_with_recipe"),
        F.round(F.try_divide(F.count_if(first & is_delta), F.count_if(first)), 6).alias("dcc"),
        F.round(F.try_divide(delta_in, delta_out), 6).alias("dcr"),
        F.round(F.avg(ratio), 6).alias("dce"),
        F.round(F.avg(1 - 1 / ratio), 6).alias("dce2"),
        F.round(F.avg(F.when(first & is_base, F.col("chunk_size") / F.col("save_size"))), 6).alias("base_ratio"),
    )


def ocr_without_headers(events: DataFrame) -> DataFrame:
    """The ratio against a tool that keeps headers elsewhere: unique headers leave both sides."""
    first, _, _ = _conditions()
    header = first & (F.col("kind") == "header")
    return events.agg(
        F.round(
            F.try_divide(F.sum("chunk_size") - _sum("chunk_size", header), _sum("save_size", first) - _sum("save_size", header)), 6
        ).alias("ocr_without_headers")
    )


def by_kind(events: DataFrame) -> DataFrame:
    """Unique chunks by kind: number, bytes before, bytes stored, bytes saved."""
    first, _, _ = _conditions()
    return events.where(first).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("chunk_size").alias("original"), F.sum("save_size").alias("stored"),
        F.sum(F.col("chunk_size") - F.col("save_size")).alias("saved"),
    )


def header_crosstab(events: DataFrame) -> DataFrame:
    """Header and other chunks, bases and deltas: logical and unique numbers and bytes."""
    first, _, is_delta = _conditions()
    return events.groupBy((F.col("kind") == "header").alias("is_header"), is_delta.alias("is_delta")).agg(
        F.count("*").alias("logical_n"), F.sum("chunk_size").alias("logical_bytes"),
        F.count_if(first).alias("unique_n"), _sum("save_size", first).alias("unique_bytes"),
    )


def stages(events: DataFrame) -> DataFrame:
    """Bytes each stage saves, and the ratio after each: duplicates, then deltas, then local compression."""
    first, is_base, is_delta = _conditions()
    sums = events.agg(
        F.sum("chunk_size").alias("logical"),
        _sum("chunk_size", ~first).alias("dedup_saved"),
        F.coalesce(F.sum(F.when(first & is_delta, F.col("chunk_size") - F.col("save_size"))), F.lit(0)).alias("delta_saved"),
        F.coalesce(F.sum(F.when(first & is_base, F.col("chunk_size") - F.col("save_size"))), F.lit(0)).alias("local_saved"),
        F.coalesce(
            F.sum(F.when(first & (F.col("store_kind") == "delta_feature"), F.col("chunk_size") - F.col("save_size"))), F.lit(0)
        ).alias("feature_saved"),
    )
    rest = F.col("logical") - F.col("dedup_saved")
    return sums.select(
        "*",
        F.round(F.try_divide("logical", rest), 6).alias("dedup_ratio"),
        F.round(F.try_divide("logical", rest - F.col("delta_saved")), 6).alias("delta_ratio"),
        F.round(F.try_divide("logical", rest - F.col("delta_saved") - F.col("local_saved")), 6).alias("local_ratio"),
    )


def overhead(events: DataFrame, hybrid: bool = False, names: str | None = None) -> DataFrame:
    """Index and recipe bytes of the linear models."""
    first, is_base, _ = _conditions()
    unique, base = F.count_if(first), F.count_if(first & is_base)
    sf = HYBRID_SF_ENTRY if hybrid else SF_ENTRY
    named = F.countDistinct(F.when(first, F.col(names))) if names else F.lit(0)
    return events.agg(
        (FP_ENTRY * unique + sf * base).alias("index_bytes"),
        (UNIQUE_ENTRY * unique + BASE_ENTRY * base + NAME_ENTRY * named).alias("name_index_bytes"),
        (RECIPE_ENTRY * F.count("*")).alias("recipe_bytes"),
        (3 * base).alias("sf_entries"),
    )


def per_version(events: DataFrame) -> DataFrame:
    """Each version's own bytes and the totals so far."""
    first, _, _ = _conditions()
    own = events.groupBy("version").agg(
        F.count("*").alias("chunks"), F.sum("chunk_size").alias("logical_bytes"), _sum("save_size", first).alias("stored_bytes")
    )
    so_far = running_totals(own, "version", {"total_logical": "logical_bytes", "total_stored": "stored_bytes"})
    return so_far.select(
        "version", "chunks", "logical_bytes", "stored_bytes", "total_logical", "total_stored",
        F.round(F.try_divide("total_logical", "total_stored"), 6).alias("ocr"),
    )


def tidy(figures: DataFrame) -> DataFrame:
    """One row of figures as (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in figures.columns])
    return figures.select(F.inline(pairs))


def throughput(runs: DataFrame, keys: list[str], size: str, seconds: str) -> DataFrame:
    """MiB a second of each group, and of all its runs together: bytes, seconds, their quotient and the mean of the runs' own."""
    mib = F.col(size) / F.lit(1 << 20)
    per_run = F.try_divide(mib, F.col(seconds))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.sum(size).alias("bytes"), F.round(F.sum(seconds), 6).alias("seconds"),
        F.round(F.try_divide(F.sum(mib), F.sum(seconds)), 4).alias("mib_s"), F.round(F.avg(per_run), 4).alias("mean_mib_s"),
    )


def write_report(figures: DataFrame, path: str) -> None:
    """Append a run's figures to a text report, a line for each: what ``analysis.metric_lines`` reads back."""
    line = F.concat_ws(": ", "metric", F.expr("format_number(value, '0.######')"))
    tidy(figures).where("value is not null").select(line.alias("line")).coalesce(1).write.mode("append").text(path)
