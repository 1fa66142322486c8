"""Statistics over run logs: truncated rates, means with confidence, first-following values, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def truncated(value: Column, digits: int) -> Column:
    """Towards zero after ``digits`` decimals, in decimals, as a desk calculator does."""
    scale = 10**digits
    d = value.cast("decimal(30,9)")
    return (F.when(d >= 0, F.floor(d * scale)).otherwise(F.ceil(d * scale)) / F.lit(scale)).cast(f"decimal(24,{digits})")


def rate_mib(size: Column, seconds: Column) -> Column:
    """MiB a second, cut to two decimals at each step."""
    kib = truncated(size / F.lit(1024).cast("decimal(10,0)"), 2)
    mib = truncated(kib / F.lit(1024).cast("decimal(10,0)"), 2)
    return F.when(seconds > 0, truncated(mib / seconds.cast("decimal(20,6)"), 2))


def ratio4(a: Column, b: Column) -> Column:
    return F.when(b > 0, truncated(a.cast("decimal(20,0)") / b.cast("decimal(20,0)"), 4))


def normal_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and 1.96 sd / sqrt(n); empty groups have no row."""
    x = F.col(value).cast("double")
    variance = F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))
    out = df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.sqrt(variance).alias("sd"))
    return out.select(*keys, "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round(Z95 * F.col("sd") / F.sqrt("n"), 4).alias("ci95"))


def student_quantile(n: Column) -> Column:
    """The 0.975 quantile of Student's t with ``n - 1`` degrees, by its expansion in the normal quantile."""
    z, v = 1.959963984540054, (n - 1).cast("double")
    g = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return F.lit(z) + F.lit(g[0]) / v + F.lit(g[1]) / (v * v) + F.lit(g[2]) / (v * v * v) + F.lit(g[3]) / (v * v * v * v)


def student_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and half width with the sample deviation; one value has width 0."""
    x = F.col(value).cast("double")
    out = df.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    width = F.when(F.col("n") < 2, 0.0).otherwise(student_quantile(F.col("n")) * F.col("sd") / F.sqrt("n"))
    return out.select(*keys, "n", F.round("mean", 4).alias("mean"), F.round(width, 4).alias("half_width"))


def interval_report(df: DataFrame, names: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A row for every wanted combination in ``names``; those without values have none."""
    return names.join(student_interval(df, keys, value), keys, "left")


def delta_ratio(dump: DataFrame) -> DataFrame:
    """Over rows with a delta flag other than 0 and 1 and a stored size: sum, number and mean of original by stored."""
    flag = F.expr("try_cast(delta_flag AS int)")
    size, stored = F.expr("try_cast(chunk_size AS double)"), F.expr("try_cast(save_size AS double)")
    kept = dump.where(~flag.isin(0, 1) & size.isNotNull() & (stored != 0))
    r = size / stored
    return kept.agg(F.round(F.sum(r), 4).alias("total"), F.count("*").alias("n"), truncated(F.avg(r), 2).alias("mean"))


def first_following(df: DataFrame, keys: list[str], order: str, marker: Column, values: dict[str, Column]) -> DataFrame:
    """Rows where ``marker`` holds, each with the first non-null of ``values`` on a later row of its keys."""
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    found = df.withColumns({name: F.first(v, ignorenulls=True).over(after) for name, v in values.items()})
    return found.where(marker)


def metric_lines(reports: DataFrame, line: str, pattern: str, keys: list[str], order: str) -> DataFrame:
    """One metric of all runs, in order, joined by commas."""
    value = F.regexp_extract(F.col(line), pattern, 1)
    rows = reports.where(value != "").select(*keys, F.struct(order, value.alias("v")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), ",")
    return rows.groupBy(*keys).agg(joined.alias("line"))


def pivot(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """A row for each ``row``, a column for each of ``values``: known values spare a pass over the data."""
    return df.groupBy(row).pivot(column, values).agg(F.first(value))


def sweep(spark, **parameters) -> DataFrame:
    """All combinations of a few parameter values."""
    out = spark.range(1).select()
    for name, values in parameters.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out
