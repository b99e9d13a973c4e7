"""Whitening of embeddings: streamed covariance, symmetric QR, projections.

Tasks stream distinct vectors through Welford's update: the mean moves by the deviation over the count,
and the sum of centred products gets the rank-one product of the deviations before and after the move.
States of tasks are merged by the parallel form of the same update, in a tree, so that no task and not
the driver ever holds more than some of them.  The d x d covariance is diagonalised by Householder
reflections and implicit QR steps; rows are projected by tasks that hold the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Entries are counted in steps of 1 / SCALE from -SHIFT / SCALE; those beyond LIMIT steps lie at the limit.
SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 52
COMPONENTS = 16
#: States that a task merges.
FAN_IN = 16
#: An eigenvalue below this share of the largest one, for each dimension, is zero but for rounding.
RANK_SHARE = 1e-14


@dataclass
class Moments:
    """Count, exact sums, mean and sum of centred products of vectors."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.zeros((width, width)))

    def add(self, rows: np.ndarray) -> None:
        """Welford's update, a rank-one product a row."""
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            self.products += np.outer(before, x - self.mean)

    def merge(self, other: Moments) -> None:
        """The parallel form of the update for two sets of rows."""
        if not other.n:
            return
        n, apart = self.n + other.n, other.mean - self.mean
        self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n, self.total = n, self.total + other.total

    @property
    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * max(1, self.n))

    def pack(self) -> bytes:
        return np.int64(self.n).tobytes() + self.total.tobytes() + self.mean.tobytes() + self.products.tobytes()

    @classmethod
    def unpack(cls, blob: bytes, width: int) -> Moments:
        n, total, rest = np.frombuffer(blob, np.int64, 1)[0], np.frombuffer(blob, np.int64, width, 8), np.frombuffer(blob, np.float64, -1, 8 + 8 * width)
        return cls(int(n), total.copy(), rest[:width].copy(), rest[width:].reshape(width, width).copy())


def merged(states: list[bytes], width: int) -> Moments:
    out = Moments.none(width)
    for blob in sorted(states):
        out.merge(Moments.unpack(blob, width))
    return out


def moments(rows: DataFrame, width: int, kind: type = np.int64) -> Moments:
    """Moments of the vectors in column ``x`` (``width`` numbers of ``kind`` as bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.none(width)
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), kind).reshape(-1, width)
                if kind is np.int64:
                    own.total += x.sum(0)
                own.add(x.astype(np.float64))
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([own.pack()], pa.binary())], ["blob"])

    def meet(part: pa.Table) -> pa.Table:
        return pa.table({"part": part["part"][:1], "blob": pa.array([merged(part["blob"].to_pylist(), width).pack()], pa.binary())})

    n = rows.rdd.getNumPartitions()
    states = rows.select("x").mapInArrow(task, "blob binary").withColumn("part", F.spark_partition_id())
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        states = states.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(meet, "part long, blob binary")
    return merged([bytes(r.blob) for r in states.select("blob").collect()], width)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal matrix Q of a symmetric A = Q T Q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by implicit QR steps.

    Each step chases a bulge down the unreduced block at the end, shifted by Wilkinson's rule; an
    off-diagonal entry that is small against its neighbours is set to zero and splits the block.
    """
    d, e, q = tridiagonal(np.asarray(a, np.float64))
    n, eps, v = len(d), np.finfo(float).eps, q.T.copy()  # rows of v are the vectors, so that a rotation is of whole rows
    high = n - 1
    for _ in range(sweeps * max(1, n)):
        small = np.abs(e) <= eps * (np.abs(d[:-1]) + np.abs(d[1:]))
        e[small] = 0.0
        while high > 0 and e[high - 1] == 0:
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + np.copysign(np.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            p, m, w = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * w + s * s * m, s * s * p - 2 * c * s * w + c * c * m
            e[k] = c * s * (m - p) + (c * c - s * s) * w
            x = e[k]
            if k < high - 1:
                z = s * e[k + 1]
                e[k + 1] *= c
            v[[k, k + 1]] = c * v[k] + s * v[k + 1], c * v[k + 1] - s * v[k]
    else:
        raise RuntimeError("the QR steps didn't settle")
    order = np.argsort(-d, kind="stable")
    return d[order], (v[order] / np.linalg.norm(v[order], axis=1, keepdims=True)).T


def steps(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, x, width`` of the rows whose vector and all entries of it are numbers; x as 64-bit integers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)  # a null entry becomes NaN
            stop = np.cumsum(sizes)
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            good = np.flatnonzero((sizes > 0) & (bad[stop] == bad[stop - sizes]))
            with np.errstate(invalid="ignore", over="ignore"):
                x = (np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT)).astype(np.int64) + SHIFT
            made = [x[stop[k] - sizes[k] : stop[k]].tobytes() for k in good]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(made, pa.binary()), pa.array(sizes[good])], ["vec_id", "x", "width"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(task, "vec_id long, x binary, width long")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Moments are of distinct vectors, so repeats weigh once; every row has its result, also rows with equal or
    null ids.  Vectors that are null or hold null or non-finite entries are left out, and so are those of
    another length than most rows have (of equally frequent ones the longer).  A component without variance
    (fewer distinct vectors than dimensions) has null in ``whitened`` and takes no part in
    ``identity_error``; ``explained`` is null if nothing varies; a ``deviation`` beyond a long is null.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = cut(steps(vectors, vec_id, vector), "steps")
    most = rows.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if most is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    width = int(most.width)
    rows = rows.where(F.col("width") == width)
    fit = cut(rows.select("x").distinct(), "distinct")
    found = moments(fit, width)
    covariance = found.covariance
    values, axes = eigen(covariance)
    k, trace = min(components, width), float(np.trace(covariance))
    real = values[:k] > RANK_SHARE * width * max(values[0], 0.0)
    share = values[:k] / trace if trace > 0 else np.full(k, np.nan)
    scaled = axes[:, :k] / np.sqrt(np.where(real, values[:k], 1.0))
    model = spark.sparkContext.broadcast((found.n, found.total - found.n * SHIFT, scaled))

    def project(x: np.ndarray) -> np.ndarray:
        n, total, own = model.value
        return ((x - SHIFT) - total / n) @ own

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = project(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64).reshape(-1, width))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in np.ascontiguousarray(w[:, real])], pa.binary())], ["x"])

    spread = moments(fit.mapInArrow(fitted, "x binary"), int(real.sum()), np.float64) if real.any() else Moments.none(0)
    error = float(np.abs(spread.covariance - np.eye(int(real.sum()))).max()) if real.any() else 0.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, _ = model.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                m = part.num_rows
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(-1, width)
                w = project(x)
                exact = n * (x - SHIFT).astype(object) - total.astype(object) if _wide(n, x, total, width) else n * (x - SHIFT) - total
                squares = [int(s) if s < 1 << 63 else None for s in (exact * exact).sum(1)]
                owner = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array(squares, pa.int64()).take(pa.array(owner)), pa.array(w.ravel(), mask=~np.tile(real, m)), pa.array(np.tile(share, m), from_pandas=True), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _wide(n: int, x: np.ndarray, total: np.ndarray, width: int) -> bool:
    """Whether sums of squared deviations may need more than 63 bits."""
    return (n * float(np.abs(x - SHIFT).max(initial=0)) + float(np.abs(total).max(initial=0))) ** 2 * width >= 2.0**62


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
