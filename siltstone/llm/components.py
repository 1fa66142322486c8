"""Connected components of a link table by alternating stars, in DataFrame operations.

Kiveris et al., "Connected Components in MapReduce and Beyond": a large-star
step joins each larger neighbour of a node to the least node around it, a
small-star step each smaller one; links end as stars around the least node of
each component. Minima are aggregated before their shuffle and joined back by
an equi-join that adaptive execution can split, so a node with very many links
needs no task of its own. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """``links`` has (a, b), a > b. Large star: by every node; small star: by the larger end."""
    if larger:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if larger:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for each node of ``links`` (a, b) that is not the least of its component.

    A round at least halves what is left of a chain, so the bound is far beyond any
    table; a run that meets it fails, it never returns unfinished components.
    """
    spark = links.sparkSession
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = common.save(spark, now, "links")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # Stars are reached when no node has two smaller neighbours and no centre is itself a leaf.
        if seen == state or seen[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = seen
        now = common.save(spark, _stars(_stars(now, True), False), "links")
    raise RuntimeError(f"components are not resolved after {max_rounds} rounds")
