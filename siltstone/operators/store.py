"""Containers, recipes and restore."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import save
from . import codec
from .asof import running_totals_by

CONTAINER = 4 << 20


def next_fit(df: DataFrame, order: str, size: str, capacity: int = CONTAINER) -> DataFrame:
    """``df`` with container_id and container_offset: in ``order``, a new container when the next would not fit.

    One fold over all rows, without one task for all rows. What a range of rows does
    to a container that is open on entry depends only on how many rows still fit; each
    range sends, for every such number that leads elsewhere, the fill and the
    containers after it. The driver follows the fills, one number a range.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    ranged = save(spark, ranged, "ranged")

    def ends(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order)[size].to_numpy(np.int64)
        n, total = len(sizes), np.concatenate(([0], np.cumsum(sizes)))
        # From a fresh container at row k: the row that opens the next one, then fill and count at the end.
        nxt = np.maximum(np.searchsorted(total, total[:-1] + capacity, side="right") - 1, np.arange(n) + 1)
        fill, count = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for k in range(n - 1, -1, -1):
            j = nxt[k]
            if j >= n:
                fill[k], count[k] = total[n] - total[k], 1
            else:
                fill[k], count[k] = fill[j], count[j] + 1
        fits = int(np.searchsorted(total, capacity, side="right"))
        fits = min(fits, n + 1)
        # Row k opens a container when the first k rows, but not more, fit into what is open.
        change = [k for k in range(min(fits, n)) if k == 0 or (fill[k], count[k]) != (fill[k - 1], count[k - 1])]
        rows = [(int(pdf["_range"].iloc[0]), int(total[k]), int(fill[k]), int(count[k]), int(total[n])) for k in change]
        return pd.DataFrame(rows, columns=["_range", "reach", "fill", "count", "total"])

    table = ranged.select("_range", order, size).groupBy("_range").applyInPandas(
        ends, "_range int, reach long, fill long, count long, total long"
    )
    by_range: dict[int, list] = {}
    for r in table.collect():
        by_range.setdefault(r[0], []).append(tuple(r[1:]))
    entry, state, opened = {}, None, 0  # state: fill of the open container
    for number in sorted(by_range):
        rows = sorted(by_range[number])
        entry[number] = (capacity + 1 if state is None else state, opened)
        total = rows[0][3]
        if state is not None and state + total <= capacity:
            state += total
            continue
        room = -1 if state is None else capacity - state
        reach = [x for x in rows if x[0] <= room] or rows[:1]
        state, opened = reach[-1][1], opened + reach[-1][2]

    schema = T.StructType(df.schema.fields).add("container_id", "long").add("container_offset", "long")
    names = schema.names

    def assign(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        fill, number = entry[int(pdf["_range"].iloc[0])]
        ids, offsets = [], []
        number -= 1
        for s in pdf[size].tolist():
            if fill + s > capacity:
                number, fill = number + 1, 0
            ids.append(number)
            offsets.append(fill)
            fill += s
        return pdf.assign(container_id=ids, container_offset=offsets)[names]

    return ranged.groupBy("_range").applyInPandas(assign, schema)


def write_containers(stored: DataFrame, path: str, capacity: int = CONTAINER) -> None:
    """Payloads by container: what ``read_containers`` looks up."""
    places = next_fit(stored.select("chunk_id", "save_size"), "chunk_id", "save_size", capacity)
    stored.join(places.drop("save_size"), "chunk_id").write.mode("overwrite").parquet(path)


def read_containers(spark: SparkSession, path: str, chunk_ids: DataFrame | None = None) -> DataFrame:
    """Stored chunks from the container files; with ``chunk_ids`` only those and the bases they need."""
    stored = spark.read.parquet(path)
    if chunk_ids is None:
        return stored
    asked = stored.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    needed = asked.select(F.coalesce("base_chunk_id", "chunk_id").alias("chunk_id")).unionAll(asked.select("chunk_id")).distinct()
    return stored.join(needed, "chunk_id", "left_semi")


def read_chunks(stored: DataFrame) -> DataFrame:
    """(chunk_id, chunk): every stored chunk decoded, deltas against their base."""
    bases = stored.where("base_chunk_id is null")
    plain = bases.select("chunk_id", codec.decode("codec", "payload", "chunk_size", F.lit(None).cast("binary")).alias("chunk"))
    base = plain.select(F.col("chunk_id").alias("base_chunk_id"), F.col("chunk").alias("base"))
    deltas = stored.where("base_chunk_id is not null").join(base, "base_chunk_id")
    return plain.unionByName(deltas.select("chunk_id", codec.decode("codec", "payload", "chunk_size", "base").alias("chunk")))


def joined(pieces: Column) -> Column:
    """Binaries of an array, one after the other, in time proportional to their bytes."""

    @F.pandas_udf("binary")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: b"".join(x))

    return run(pieces)


def _in_order(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, content): the chunks of each key by seq."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    return parts.groupBy(*keys).agg(ordered.alias("parts")).select(*keys, joined("parts").alias("content"))


def whole(chunks: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(version, content) of rows (version, seq, chunk); ``versions`` without chunks are empty."""
    found = _in_order(chunks, "version")
    if versions is None:
        return found
    found = versions.select("version").distinct().join(found, "version", "left")
    return found.select("version", F.coalesce("content", F.lit(b"")).alias("content"))


def restore(recipes: DataFrame, stored: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(version, content): each version's chunks in order; ``versions`` names those that may be empty."""
    return whole(recipes.join(read_chunks(stored), "chunk_id"), versions)


#: Bytes of a piece of a restored version.
PIECE = 64 << 20


def restore_pieces(recipes: DataFrame, stored: DataFrame, piece: int = PIECE) -> DataFrame:
    """(version, piece, content): versions of any size in pieces of about ``piece`` bytes, each a row of its own.

    A chunk belongs to the piece in which it begins. Places are running sums over ids
    and sizes only; no task holds a whole version.
    """
    sized = recipes.join(stored.select("chunk_id", "chunk_size"), "chunk_id")
    placed = running_totals_by(sized, ["version"], "seq", "chunk_size", "_through")
    number = F.floor((F.col("_through") - F.col("chunk_size")) / piece).cast("long")
    parts = placed.select("version", number.alias("piece"), "seq", "chunk_id").join(read_chunks(stored), "chunk_id")
    return _in_order(parts, "version", "piece")
