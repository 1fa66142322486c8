"""What the corpus operators share: the shared folder, Arrow batch sizes, key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import save, shared_dir  # noqa: F401

#: Rows of an Arrow batch handed to Python: a few MB at usual document lengths.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(column: str):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


#: Characters of a text that order the rows of one id across tasks.
HEAD = 64


def in_order(rows: DataFrame) -> DataFrame:
    """(id, text) in ranges by id, sorted within. Rows that share an id, null ids among them, may fill several ranges.

    They go by their text's head across ranges, and repeats by where they were read:
    a place in the input, the same in every run over the same files.
    """
    placed = rows.withColumn("head", F.substring("text", 1, HEAD)).withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange("id", "head", "place").sortWithinPartitions("id", "text", "place")
    return ranged.select("id", "text")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of ``df`` has, upper and lower case taken alike."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_own_{k}" not in taken:
            out.append(f"_own_{k}")
        k += 1
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
