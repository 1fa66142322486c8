"""Online ingest: chunks as they arrive, deduplicated against all that came before.

State is one fingerprint a unique chunk, partitioned by fingerprint. Aged
super-feature tiers keep the last base of each key with an event-time timer and
forget it after a number of versions, event time standing for the version.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.fingerprint import with_fingerprint
from ..plans.storage import shared_dir


def read_documents(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """``documents`` as a stream of files, whether the table is one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    # A file source lists folders: from above the table, its one file or its folder's files.
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parque[t]")


def unique_chunks(documents: DataFrame, size: int) -> DataFrame:
    """(fp, chunk_size) of each chunk at its first arrival."""
    content = documents.select(F.col("doc_id").alias("version"), chunking.utf8("text").alias("content"))
    chunks = with_fingerprint(chunking.fixed(content, "content", size))
    return chunks.select("fp", "chunk_size").dropDuplicates(["fp"])


def aged_first_seen(sfs: DataFrame, age_days: int) -> DataFrame:
    """(sf, chunk_id, base_id): arrivals with the base last seen under a super-feature, at most ``age_days`` old.

    ``sfs`` is a stream (sf, chunk_id, seen timestamp) with a watermark on ``seen``; a
    day stands for a version. Once the watermark is more than ``age_days`` past the last
    arrival of a key, its state is removed, so state holds what may still match only.
    """

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last_id, last_seen = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values("chunk_id")
        for r in rows.itertuples():
            seen = int(r.seen.timestamp())
            if last_id is not None and seen - last_seen <= age_days * 86400:
                out.append((key[0], r.chunk_id, last_id))
            last_id, last_seen = r.chunk_id, seen
        state.update((last_id, last_seen))
        # An event-time timer lies after the watermark; arrivals behind it are late and dropped before they come here.
        state.setTimeoutTimestamp(max((last_seen + age_days * 86400 + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sf", "chunk_id", "base_id"])

    return sfs.groupBy("sf").applyInPandasWithState(
        update, "sf long, chunk_id long, base_id long", "id long, seen long", "append", "EventTimeTimeout"
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there into the shared folder, and read what it wrote."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
