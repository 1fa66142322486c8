"""Operator 3: near-duplicates by circulant MinHash, banding and exact Jaccard.

Signatures (Li and Li, "C-MinHash"): one permutation of the 32-bit universe
scatters a document's shingles, a second one, circularly shifted by ``k``,
gives coordinate ``k`` as its least value. Both are fixed bijections.

1. Documents of one shingle set are one class, represented by its least id.
2. Representatives that agree in a band share a bucket. Each is compared with
   the least of its bucket, exactly, on full sets.
3. Buckets in which that left members apart are searched whole, in tasks of
   bounded size. A bucket's largest class needs no comparison within itself: its
   members fill blocks of their own, which only meet the blocks of the others. A
   task is a pair of blocks, compares one set with all others at once and returns
   only links that join two classes it still held apart, never all pairs.
4. Connected components of the links give each class its least id.

A pair of similarity 0.75 stays unseen by all 40 bands of 4 rows with
probability (1 - 0.75 ** 4) ** 40 = 2.5e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .components import components
from .shingles import mix64, shingle_sets

BANDS, ROWS = 40, 4
WIDTH, PERCENT = 5, 75
#: Most sets, and most shingles, in one block of a bucket.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 18
#: Tasks over which a bucket's members are dealt to learn their blocks.
DEALS = 16


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit integers."""
    x = x * np.uint32(0x9E3779B1)
    return x ^ x >> np.uint32(15)


def _circulant(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least of the second permutation, shifted by k, over the scattered set."""
    placed = _scatter((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), 256):
        np.minimum(least, _circulant(placed[at : at + 256, None] + shifts).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band."""
    parts = least.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key


SKETCH = "doc_id long, n long, set_key binary, bands array<long>"


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            found = [band_keys(signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "set_key", "bands"],
            )

    return docs.mapInArrow(run, SKETCH)


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "shingles"]
            )

    wanted = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    return wanted.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])


def _search(percent: int):
    """All links that join classes within the sets of one task."""

    def run(group: pa.Table) -> pa.Table:
        tokens.forget()
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        column = group.column("shingles").chunk(0)
        bounds = np.array(column.offsets)
        flat = np.unique(column.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True)[1]
        starts = bounds[:-1] - bounds[0]
        sizes = np.diff(bounds)
        label = np.unique(group.column("label").to_numpy(), return_inverse=True)[1]
        side = group.column("side").to_numpy()
        one_block = side.max() == side.min()
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        links = []
        for c in range(len(ids)):
            # Sets of another class whose size allows the similarity; across two blocks from the first side only.
            if not one_block and side[c]:
                continue
            open_ = (label != label[c]) & (100 * np.minimum(sizes, sizes[c]) >= percent * np.maximum(sizes, sizes[c]))
            open_ &= np.arange(len(ids)) > c if one_block else side == 1
            if not open_.any():
                continue
            own = flat[starts[c] : starts[c] + sizes[c]]
            mark[own] = 1
            shared = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            for o in np.flatnonzero(open_ & (100 * shared >= percent * (sizes[c] + sizes - shared))):
                if label[o] != label[c]:
                    links.append((ids[c], ids[o]))
                    label[label == label[o]] = label[c]
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def links(
    docs: DataFrame, reps: DataFrame, width: int, percent: int, block_sets: int, block_shingles: int
) -> DataFrame:
    """Links between representatives (a > b) with the same components as all similar pairs of the buckets."""
    spark = docs.sparkSession
    members = reps.select("doc_id", "n", F.explode("bands").alias("key"))
    first = F.min(F.struct("doc_id", "n"))
    buckets = members.groupBy("key").agg(first.alias("first"), F.count("*").alias("m")).where("m > 1")
    met = members.join(buckets, "key").select(
        "key", "m", F.col("doc_id").alias("a"), F.col("n").alias("na"),
        F.col("first.doc_id").alias("b"), F.col("first.n").alias("nb"),
    )
    met = common.save(spark, met, "buckets")
    pairs = met.where("a != b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = pairs.select("a", "na", "b", "nb").distinct()
    # Sets that some comparison may need: those of pairs, and of buckets with three or more.
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).unionAll(met.where("m > 2").select("a"))
    sets = common.save(spark, _full_sets(docs, ids.distinct(), width), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    tested = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", shared.alias("s"))
    linked = tested.where(100 * F.col("s") >= percent * (F.col("na") + F.col("nb") - F.col("s"))).select("a", "b")
    linked = common.save(spark, linked, "star-links")

    # Buckets of three or more whose members are not all linked with their first.
    label = linked.groupBy("a").agg(F.min("b").alias("label"))
    named = met.where("m > 2").join(label, "a", "left").select(
        "key", F.col("a").alias("id"), F.col("na").alias("n"), F.coalesce("label", "a").alias("label")
    )
    # Buckets of the same members are searched once; the sums tell them apart.
    sums = named.groupBy("key").agg(
        F.count("*").alias("m"), F.sum("n").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y"),
    )
    apart = sums.where("lo != hi").groupBy("m", "x", "y", "total").agg(F.min("key").alias("key"))
    # Members of one bucket are dealt to several tasks, each with a copy of what is known of the bucket.
    dealt = lambda found: found.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    named = named.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)).cast("int"))
    named = named.join(dealt(apart.select("key")), ["key", "deal"], "left_semi")
    # Of each bucket: its largest class, then the blocks of that class and of the rest.
    classes = named.groupBy("key", "label").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    need = lambda m, total: F.greatest(F.ceil(m / block_sets), F.ceil(total / block_shingles)).cast("int")
    largest = F.max(F.struct("m", "total", "label"))
    shape = classes.groupBy("key").agg(largest.alias("own"), F.sum("m").alias("m"), F.sum("total").alias("total"))
    shape = shape.select(
        "key", F.col("own.label").alias("largest"), need(F.col("own.m"), F.col("own.total")).alias("own"),
        need(F.col("m") - F.col("own.m"), F.col("total") - F.col("own.total")).alias("rest"),
    )
    placed = named.join(dealt(shape), ["key", "deal"]).withColumn("in_largest", F.col("label") == F.col("largest"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    placed = placed.withColumn("block", F.when(F.col("in_largest"), spread("own")).otherwise(F.col("own") + spread("rest")))
    first_met = F.when(F.col("in_largest"), F.col("own")).otherwise(F.lit(0))
    other = F.explode(F.sequence(first_met, F.col("own") + F.col("rest") - 1)).alias("other")
    tasks = placed.select("key", "id", "label", "block", other).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    tasks = tasks.join(sets, "id")
    searched = tasks.groupBy("key", "i", "j").applyInArrow(_search(percent), "a long, b long")
    return linked.unionAll(searched)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    block_sets: int = BLOCK_SETS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words part at ASCII white space. Null, empty and blank
    texts have no shingles and are linked with nothing, not with each other. A
    null id takes no part: its component_id is null and it is not kept. Rows of
    one id are one document; they should repeat one text. An empty table gives no
    rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    common.tune(spark)
    rows_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = common.save(spark, sketches(rows_, width, bands, rows), "sketches")
    known = sketch.where("doc_id is not null and n > 0")
    reps = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "bands")).alias("r")).select("set_key", "r.*")
    reps = common.save(spark, reps, "representatives")
    found = components(links(rows_, reps, width, percent, block_sets, block_shingles))
    # Every set's component, then every document's, by equi-joins with one row a set on one side.
    named = reps.select("set_key", "doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    named = named.select("set_key", F.coalesce("component", "doc_id").alias("component_id"))
    out = sketch.select("doc_id", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, all columns as they were; texts without words all stay.

    Rows with a null id take no part in classes and stay.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
