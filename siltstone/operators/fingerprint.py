"""Fingerprints, first occurrences, chunk ids and recipes.

Order is always (version, seq). First occurrences are a minimum of a struct, so
a chunk that a third of all versions share is one partial row a task before the
shuffle. Dense ids come from sorted ranges of (version, seq), whatever the number
of versions: a count for each range, their running sum, and a place within.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import save


def with_fingerprint(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("fp", F.sha2("chunk", 256))


def first_occurrences(chunks: DataFrame, *extra: str) -> DataFrame:
    """One row a fingerprint: fp, version, seq, chunk_size and ``extra`` of its first occurrence, times it occurs."""
    first = F.min(F.struct("version", "seq", "chunk_size", *extra)).alias("first")
    return chunks.groupBy("fp").agg(first, F.count("*").alias("times")).select("fp", "first.*", "times")


def with_order_number(df: DataFrame, *order: str, name: str, start: int = 0) -> DataFrame:
    """``df`` with consecutive numbers by ``order``, which must tell all rows apart.

    Rows are sorted in ranges and written once with their place in the range; the
    driver adds up one count a range, so as many numbers as there were tasks.
    """
    spark = df.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = save(spark, ranged.select("*", F.spark_partition_id().alias("_range"), place.alias("_n")), "ranges")
    before, starts = start, []
    for number, n in sorted(ranged.groupBy("_range").count().collect()):
        starts.append((number, before))
        before += n
    starts = spark.createDataFrame(starts, "_range int, _before long")
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_n")).drop("_range", "_n", "_before")


def chunk_index(chunks: DataFrame, *extra: str) -> DataFrame:
    """Unique chunks with their dense ids: the number of unique chunks before each first occurrence."""
    return with_order_number(first_occurrences(chunks, *extra), "version", "seq", name="chunk_id")


def recipes(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(version, seq, chunk_id): what rebuilds each version."""
    return chunks.select("version", "seq", "fp").join(index.select("fp", "chunk_id"), "fp").select("version", "seq", "chunk_id")


def new_and_known(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose fingerprint ``known`` lacks, and those whose it has."""
    keys = known.select("fp").distinct()
    return chunks.join(keys, "fp", "left_anti"), chunks.join(keys, "fp", "left_semi")
