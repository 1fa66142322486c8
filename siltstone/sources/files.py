"""Version files, chunk dumps and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import natural_key

DETAIL = (
    "Version INT, LogicalSize_Bytes LONG, CommitTime_Seconds DECIMAL(20,9), `Throughput_MB/s` DECIMAL(10,2), "
    "LooseObjectsSize_Bytes LONG, LooseMetadataSize_Bytes LONG, LooseTotalSize_Bytes LONG"
)
RESTORE = (
    "Version INT, CommitHash STRING, RestoredLogicalSize_Bytes LONG, RestoreTime_Seconds DECIMAL(20,9), "
    "`RestoreThroughput_MB/s` DECIMAL(10,2)"
)
ARCHIVES = r"\.(tar|tar\.gz|tgz|tar\.bz2)$"


def versions(spark: SparkSession, folder: str, limit: int | None = None, pattern: str | None = None) -> DataFrame:
    """(version, path, content) of the files below ``folder`` in natural order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if pattern:
        files = files.where(F.col("path").rlike(pattern))
    # The listing is paths only; the driver holds it to plan the scan anyway.
    names = files.select("path").select("path", natural_key(F.col("path")).alias("k")).sort("k", "path")
    if limit is not None:
        names = names.limit(limit)
    ordered = [(i, r[0]) for i, r in enumerate(names.collect())]
    numbers = spark.createDataFrame(ordered, "version long, path string")
    return files.select("path", "content").join(F.broadcast(numbers), "path").select("version", "path", "content")


def log(spark: SparkSession, paths, schema: str = DETAIL) -> DataFrame:
    return spark.read.csv(paths, header=True, schema=schema)


def union_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other)
    return out


def numeric(df: DataFrame, column: str) -> DataFrame:
    """Values of a text column that are numbers; others are skipped."""
    value = F.expr(f"try_cast(`{column}` AS double)")
    return df.select(value.alias("value")).where("value is not null")


def write_index_dump(index: DataFrame, path: str) -> None:
    """Chunk metadata as CSV with a header."""
    index.drop("chunk", "payload").write.mode("overwrite").csv(path, header=True)


def write_recipe_dump(recipes: DataFrame, index: DataFrame, path: str) -> None:
    """One line a logical chunk: its place, chunk, base, sizes and how it is stored."""
    columns = ["chunk_id", "base_chunk_id", "chunk_size", "save_size", "store_kind"]
    flag = F.when(F.col("store_kind").startswith("delta"), "DELTA").when(F.col("store_kind") == "base_raw", "NO_LZ4").otherwise("NO_DELTA")
    recipes.join(index.select(*columns), "chunk_id").withColumn("flag", flag).write.mode("overwrite").csv(path, header=True)
