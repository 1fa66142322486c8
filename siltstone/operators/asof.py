"""The latest earlier value of a key, without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096


def latest_before(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = RANGE) -> DataFrame:
    """``df`` with the last non-null ``value`` of the same keys at a smaller ``order`` (a unique long).

    Rows are windowed within ranges of ``order``; what a range inherits is the last value
    of the ranges before it, one row a key and range.
    """
    ranged = df.withColumns({"_value": value, "_range": F.floor(F.col(order) / width)})
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.last("_value", ignorenulls=True).over(within))
    last = ranged.where("_value is not null").groupBy(*keys, "_range").agg(F.max_by("_value", order).alias("_last"))
    spans = ranged.select(*keys, "_range").distinct().join(last, [*keys, "_range"], "left")
    over = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_range", F.last("_last", ignorenulls=True).over(over).alias("_before"))
    return (
        own.join(spans, [*keys, "_range"], "left")
        .withColumn(name, F.coalesce("_own", "_before"))
        .drop("_value", "_range", "_own", "_before")
    )


def running_totals(df: DataFrame, order: str, totals: dict[str, str], width: int = RANGE) -> DataFrame:
    """``df`` with the sums so far, by the unique long ``order``, of columns: name of the sum -> column.

    Windows run within ranges of ``order``; one row a range carries the sums before it.
    Those rows, one for ``width`` values of ``order``, meet in one task.
    """
    ranged = df.withColumn("_span", F.floor(F.col(order) / width))
    within = Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spans = ranged.groupBy("_span").agg(*[F.sum(c).alias(f"_{name}") for name, c in totals.items()])
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_span", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    own = ranged.withColumns({name: F.sum(c).over(within) for name, c in totals.items()})
    summed = own.join(carried, "_span").withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals})
    return summed.drop("_span", *[f"_{n}" for n in totals])


def running_totals_by(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = RANGE) -> DataFrame:
    """``df`` with the sum of ``value`` so far within ``keys``, by the long ``order``; a key with very many rows fills several ranges."""
    ranged = df.withColumn("_span", F.floor(F.col(order) / width))
    own = F.sum(value).over(Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    spans = ranged.groupBy(*keys, "_span").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(*keys, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    summed = ranged.withColumn(name, own).join(carried, [*keys, "_span"])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_span", "_before")
