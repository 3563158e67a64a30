"""Embedding whitening: principal components by a randomised range finder with Rayleigh-Ritz, over all rows.

Entries c become integers floor(64 * c) + 1000000, so sums over rows are exact. A pass multiplies the
covariance of all rows, centred first, with a block of vectors: each task adds up its rows'
products, and the partial sums of a dimension meet in one of several tasks that hold a running sum.
The driver sees a matrix of dimensions by block width and nothing that grows with the rows. It starts
from random vectors, ``OVERSAMPLING`` more than components; every power pass gives a Rayleigh-Ritz
solution for the span and the residuals of its components. When they fall below ``TOLERANCE`` of the
largest eigenvalue the components are taken; when they do not (or will not, at the rate seen) the block
expands to the full dimension, whose one pass gives the covariance itself.

Defined results: rows whose vector is null or holds null or non-finite entries are left out; of vectors
of different lengths the shorter ones count as followed by zeros; components without variance are left
out, as nothing can scale them; ``deviation`` is null where it exceeds a long; entries beyond a long's
range after scaling are held to +-2^53; repeated rows and rows without ``vec_id`` each get their rows;
an empty table, or one without a usable vector, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.session import small_batches, table

COMPONENTS = 32
OVERSAMPLING = 10
POWER_PASSES = 6
TOLERANCE = 1e-13
SEED = 20
ROWS = 4096  # rows that a task holds at a time
SUMMING_TASKS = 16  # most tasks that add up the partial sums of a pass
_MOST = 2.0**53
_EPSILON = 1e-12  # of the largest eigenvalue: less is no variance


@dataclass(frozen=True)
class Spectrum:
    """Components (columns of ``vectors``) of the covariance of ``n`` rows with exact ``sums``, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    expanded: bool


def usable(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is a vector of finite entries only."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col(column).isNotNull() & finite)


def quantised(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, integers) of slices of an array of vectors, zeros after vectors shorter than ``width``."""
    for a in range(0, len(column), ROWS):
        part = column.slice(a, ROWS)
        lengths = np.diff(part.offsets.to_numpy())
        at = np.arange(width) < lengths[:, None]
        x = np.zeros(at.shape)
        x[at] = part.flatten().to_numpy(zero_copy_only=False)
        yield a, a + len(part), np.clip(np.floor(64 * x), -_MOST, _MOST).astype(np.int64) + 1_000_000


def mean_of(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and fractions: whole numbers are taken off in integers, so that no digit of a fraction is lost."""
    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - mean[0]).astype(np.float64) - mean[1]


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return usable(rows, column).select(F.col(column).cast("array<double>").alias("v"))


def exact_sums(rows: DataFrame, column: str, width: int) -> tuple[int, list[int]]:
    """The number of usable rows and the exact sum of each dimension's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for a, b, x in quantised(batch.column("v"), width):
                n += b - a  # halves are added apart, so that no sum leaves a long
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            sums = [(int(h) << 32) + int(v) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array([str(n), *map(str, sums)])], ["dim", "sum"])

    found = _vectors(rows, column).mapInArrow(run, "dim long, sum string")
    by = {r.dim: int(r["sum"]) for r in found.groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()}
    return by.get(-1, 0), [by.get(k, 0) for k in range(width)]


def covariance_times(rows: DataFrame, column: str, mean: tuple[np.ndarray, np.ndarray], block: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The covariance of all usable rows times ``block``, and its trace; rows are centred before anything is multiplied."""
    width, k = block.shape
    task_data = rows.sparkSession.sparkContext.broadcast((mean, block))  # dimensions by block width

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean_, block_ = task_data.value
        total, squares = np.zeros((width, k)), 0.0
        for batch in batches:
            for _, _, x in quantised(batch.column("v"), width):
                c = centred(x, mean_)
                total += c.T @ (c @ block_)
                squares += float((c * c).sum())
        out = [*(row.tobytes() for row in total), np.array([squares]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(out, pa.binary())], ["dim", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist(), strict=True):
                held[dim] = held.get(dim, 0.0) + np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["dim", "part"])

    schema = "dim long, part binary"
    parts = _vectors(rows, column).mapInArrow(partial, schema)
    found = {r.dim: np.frombuffer(r.part) for r in parts.repartition(min(SUMMING_TASKS, -(-width // 64)), "dim").mapInArrow(add, schema).collect()}
    return np.array([found[d] for d in range(width)]) / n, float(found[width][0]) / n


def rayleigh_ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenpairs of the covariance within the span of the orthonormal ``basis``, and the largest residual; ``image`` is its product with ``basis``."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    vectors = basis @ turn
    return values, vectors, float(np.linalg.norm(image @ turn - vectors * values, axis=0).max(initial=0))


def principal_components(rows: DataFrame, column: str = "embedding", k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = POWER_PASSES, tolerance: float = TOLERANCE) -> Spectrum | None:
    """The spectrum of all usable rows of ``rows``; None where there is none."""
    width = _vectors(rows, column).agg(F.max(F.size("v")).alias("w")).first().w or 0
    n, sums = exact_sums(rows, column, width) if width else (0, [])
    if not n:
        return None
    mean = mean_of(n, sums)
    k = min(k, width)
    block = min(width, k + oversampling)
    basis = np.eye(width)
    if block < width:
        basis = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, block)))[0]
    done, expanded, before = 0, block == width, None
    while True:
        image, trace = covariance_times(rows, column, mean, basis, n)
        values, vectors, residual = rayleigh_ritz(basis, image, k)
        done += 1
        least = tolerance * max(float(values[0]), 0.0)
        if expanded or residual <= least:
            break
        rate = residual / before if before else 0.0
        if done >= passes or (rate and residual * rate ** (passes - done) > least):
            basis, expanded = np.eye(width), True
        else:
            basis, before = np.linalg.qr(image)[0], residual if done > 1 else None
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    able = values > _EPSILON * max(float(values[0]), 0.0)
    return Spectrum(n, sums, values[able], vectors[:, able], trace, done, expanded)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sum over dimensions of (n * x - S)^2 for each row; null beyond a long."""
    rough = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(1)
    out: list[int | None]
    if rough.max(initial=0) < 2.0**60 and n * float(np.abs(x).max(initial=0)) < 2.0**62 and max(map(abs, sums), default=0) < 2**62:
        out = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    else:
        out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in out], pa.int64())


def whitened(rows: DataFrame, spectrum: Spectrum, column: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """(vec_id, n, deviation, whitened): for each usable row its coordinates of unit variance, an array over the components."""
    width = len(spectrum.sums)
    task_data = rows.sparkSession.sparkContext.broadcast((mean_of(spectrum.n, spectrum.sums), spectrum.vectors / np.sqrt(spectrum.values), spectrum.n, spectrum.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean_, axes, n, sums = task_data.value
        k = axes.shape[1]
        for batch in batches:
            for a, b, x in quantised(batch.column("v"), width):
                w = centred(x, mean_) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * k + 1, k) if k else np.zeros(b - a + 1), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([n] * (b - a), pa.int64()), deviations(x, n, sums), lists], [id_, "n", "deviation", "whitened"])

    picked = usable(rows, column).select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, f"{id_} long, n long, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, spectrum: Spectrum, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, from all rows."""
    k = len(spectrum.values)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            w = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            sums[:k] += w.T @ w
            sums[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["at", "v"])

    found = whitened(rows.withColumn("vec_id", F.lit(0)), spectrum, column).select("whitened").mapInArrow(moments, "at long, v double")
    flat = np.zeros((k + 1) * k)
    for r in found.groupBy("at").agg(F.sum("v").alias("v")).collect():
        flat[r["at"]] = r.v
    sums = flat.reshape(k + 1, k) / spectrum.n
    # whitened rows are centred already; what rounding left of their mean is taken off
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, ROWS)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spectrum = principal_components(rows)
    if spectrum is None:
        return spark.createDataFrame([], schema)
    error = identity_error(rows, spectrum)
    explained = F.lit(spectrum.values / spectrum.trace if spectrum.trace else spectrum.values)
    out = whitened(rows, spectrum).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
