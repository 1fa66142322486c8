"""Operator 7: a quality score from document statistics.

Fifteen statistics of the whole text are standardised and mapped by random
Fourier features, whose inner products approximate a Gaussian kernel. Each
partition of the training rows sums its part of the normal equations; the
driver adds one row a partition, solves the ridge system and fits an isotonic
(pool adjacent violators) curve over bins of the raw scores. Neither ids nor
languages, sources or labels enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .shingles import mix64, word_hashes

FEATURES = 15
FOURIER = 192
RIDGE = 1e-3
BINS = 512
THRESHOLD = 0.7
#: Labelled rows that a model is fitted on at most; of more, those of least hash.
MAX_TRAINING_ROWS = 200_000
SEED = 7
#: Parts of the training rows that are summed by themselves.
PARTS = 16

_KINDS = np.zeros(256, np.int64)  # 0 other
for _k, _c in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\f", b"\n", b".,", b"|", bytes(range(128, 256)), b"!?;:'\"()-"), 1):
    _KINDS[list(_c)] = _k


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text; null and empty give zeros."""
    out = np.zeros(FEATURES, np.float64)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    buffer = np.frombuffer(raw + b"\n", np.uint8)
    counts = np.bincount(_KINDS[buffer[:-1]], minlength=10) / len(raw)
    begins, words = word_hashes(buffer)
    n = len(words)
    out[0] = np.log1p(n)
    out[1:11] = np.sqrt(counts)
    if n:
        lines = raw.split(b"\n")
        out[11] = np.log1p(len(raw) / n)
        out[12] = len(np.unique(words)) / n
        if n > 2:
            runs = mix64(words[:-2] ^ mix64(words[1:-1] ^ mix64(words[2:])))
            out[13] = 1 - len(np.unique(runs)) / len(runs)
        out[14] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, FEATURES x FOURIER
    phases: np.ndarray
    ridge: np.ndarray  # the last is the constant
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores there

    def fourier(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.centre) / self.scale, self.weights, self.phases)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fourier(x) @ self.ridge, self.knots, self.values), 0.0, 1.0)


def _fourier(z: np.ndarray, weights: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    out = np.sqrt(2.0 / len(phases)) * np.cos(z @ weights + phases)
    return np.concatenate((out, np.ones((len(z), 1))), axis=1)


def _array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, FEATURES)


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x) of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the non-decreasing curve of least squares."""
    blocks: list[list[float]] = []  # value, weight, sum of x * weight
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        blocks.append([b, c, a * c])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, c2, s = blocks.pop()
            u = blocks[-1]
            u[0] = (u[0] * u[1] + v * c2) / (u[1] + c2)
            u[1] += c2
            u[2] += s
    return np.array([s / c for _, c, s in blocks]), np.array([v for v, _, _ in blocks])


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def training_labels(labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(id, label) to learn from, about ``max_rows`` at most: never those held out, never null labels, one row an id.

    Of more, those of least hash, the same ones in every run. At 12 bytes a row the
    table's bound allows to broadcast it.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    n = own.count()
    if n > max_rows:
        own = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return own


def _saved(train: DataFrame) -> DataFrame:
    """Training rows, one an id, few and read several times: written once, in few files."""
    one = train.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).select("doc_id", "r.*")
    return common.save(train.sparkSession, one.repartition(PARTS, "doc_id"), "training")


def fit(train: DataFrame, fourier: int = FOURIER, ridge: float = RIDGE) -> Model:
    """A model of ``train`` (doc_id, x, label), a small table. Without rows, or with one label only, its scores are constant."""
    moments = [f for k in range(FEATURES) for f in (F.avg(F.get("x", F.lit(k))), F.stddev_pop(F.get("x", F.lit(k))))]
    found = train.agg(*moments, F.avg("label")).first()
    rng = np.random.default_rng(SEED)
    weights = rng.standard_normal((FEATURES, fourier)) / np.sqrt(FEATURES / 2)
    phases = rng.uniform(0, 2 * np.pi, fourier)
    if found[-1] is None:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), weights, phases, np.zeros(fourier + 1), np.zeros(1), np.full(1, 0.5))
    centre, scale = (np.array(found[k : 2 * FEATURES : 2], float) for k in (0, 1))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((fourier + 1, fourier + 2)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _fourier((_array(batch.column(0)) - centre) / scale, weights, phases)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.concatenate((z, y[:, None]), axis=1)
            size += len(y)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    # One row of some 300 kB a part.
    rows = train.select("x", F.col("label").cast("int")).coalesce(PARTS)
    total = sum(np.frombuffer(r[0]).reshape(fourier + 1, fourier + 2) for r in rows.mapInArrow(sums, "part binary").collect())
    a, b = total[:, :-1], total[:, -1]
    solved = np.linalg.solve(a + ridge * len(a) * np.eye(len(a)), b)
    raw = Model(centre, scale, weights, phases, solved, np.array([-1e3, 1e3]), np.array([0.0, 1.0]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = raw.fourier(_array(batch.column(0))) @ solved
                bins = np.clip(np.floor(s * BINS / 2), -BINS, 2 * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(s), batch.column(1)], ["bin", "s", "label"])

    bins = rows.mapInArrow(binned, "bin long, s double, label int").groupBy("bin")
    curve = sorted(tuple(r) for r in bins.agg(F.avg("s"), F.avg("label"), F.count("*")).collect())
    _, x, y, w = (np.array(c, float) for c in zip(*curve))
    knots, values = isotonic(x, y, w)
    return Model(centre, scale, weights, phases, solved, knots, values)


def scores(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have zero statistics and a score like any other. A null
    id is scored, never learned from, and not held out. Repeated rows get equal
    scores. Without usable labels every score is 0.5. An empty table gives no
    rows. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    common.tune(spark)
    features = common.save(spark, feature_table(docs, id_col, text_col), "statistics")
    own = F.broadcast(training_labels(labels))
    model = fit(_saved(features.join(own, features["doc_id"] == own["id"]).select("doc_id", "x", "label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            s = model.score(_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = features.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; columns as they were, no text shuffled.

    The model's rows are read first, by a broadcast of their ids; then one pass scores and filters.
    """
    common.tune(docs.sparkSession)
    own = F.broadcast(training_labels(labels).withColumnRenamed("id", "its_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = feature_table(rows.join(own, F.col("id") == F.col("its_id"), "left_semi"), "id", "text")
    model = fit(_saved(known.join(own, F.col("doc_id") == F.col("its_id")).select("doc_id", "x", "label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(text_col).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
