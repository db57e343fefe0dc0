"""Embedding whitening: principal components of unit variance.

Entries become integers on a fixed grid, so the scatter matrix is summed
exactly whatever the partitioning: every partition multiplies its rows, moved
to an integer near the mean, and ``groupBy(i, j)`` adds the partial products as
decimals.  The centred scatter of d x d entries (d is the vector width) is the
only thing that reaches the driver.  There a Cholesky factorisation with
diagonal pivoting gives a triangular factor L, and one-sided Jacobi rotations
make the columns of L orthogonal: their squared norms are the eigenvalues,
the normalised columns the components.

Nulls and oddities: a null vector, or one with a null or non-finite entry, is
dropped, as is one whose width is not the most frequent one (ties: the wider).
Grid values saturate at 2**40.  Repeated rows and null ids count and are
returned each.  Directions without variance are no components, so constant
vectors give no rows, and a table of rank r at most r components.  An empty
table gives an empty result.  ``deviation`` is null where it exceeds a long.
Columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import prepare, table

SCALE, SHIFT = 1024, 100000  # grid: floor(SCALE * c) + SHIFT
LIMIT = 1 << 40
COMPONENTS = 8
ROWS = 4096  # rows multiplied at a time
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Fit:
    """Count, sums per dimension, components (one per column) and eigenvalues of a table."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id, v): the rows with a vector of finite entries of the most frequent width."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.select(F.col(ident).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)) & (F.size("v") > 0))
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.where(F.size("v") == (width["w"] if width else 0))


def grid(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * float(SCALE)), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def matrices(batch: pa.RecordBatch, at: int = 1):
    """(first, grid values) of the batch's rows, ROWS at a time."""
    for first in range(0, batch.num_rows, ROWS):
        part = batch.column(at).slice(first, ROWS)
        flat = part.flatten().to_numpy(zero_copy_only=False)
        yield first, grid(flat.reshape(len(part), -1))


def product(rows: np.ndarray) -> np.ndarray:
    """rows.T @ rows, exactly, for integers."""
    top = float(np.abs(rows).max(initial=0))
    if top * top * len(rows) < EXACT:
        wide = rows.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    exact = rows.astype(object)
    return exact.T @ exact


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""
    def run(batches):
        n, s = 0, None
        for b in batches:
            for _, x in matrices(b):
                part = x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > LIMIT >> 8 else x.sum(axis=0)
                n, s = n + len(x), part.astype(object) + (0 if s is None else s)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, len(s)), pa.int32()), "s": pa.array([str(x) for x in (n, *s)], pa.string())})

    found = rows.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in found}
    return by.get(-1, 0), [by[i] for i in range(len(by) - 1)]


def scatter(rows: DataFrame, n: int, sums: list[int]) -> list[list[int]]:
    """n times the centred scatter, exact integers: sum of (n*x-S)(n*x-S)' over n."""
    mid = np.array([s // n for s in sums], dtype=np.int64)
    d = len(sums)

    def run(batches):
        total = None
        for b in batches:
            for _, x in matrices(b):
                part = product(x - mid)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                                              "s": pa.array([str(x) for x in total[i, j]], pa.string())})

    found = rows.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    rest = [s - n * int(m) for s, m in zip(sums, mid)]  # of the moved rows
    out = [[0] * d for _ in range(d)]
    for r in found:
        i, j = r["i"], r["j"]
        out[i][j] = out[j][i] = n * int(r["s"]) - rest[i] * rest[j]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, rows in the order of ``a``; one column per pivot, the largest
    remaining diagonal entry first, until what remains is rounding."""
    d = len(a)
    left, factor = a.diagonal().copy(), np.zeros((d, d))
    floor = left.max(initial=0.0) * d * np.finfo(float).eps
    for k in range(d):
        p = int(np.argmax(left))
        if left[p] <= floor:
            return factor[:, :k]
        column = (a[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        column[left == -np.inf] = 0.0
        factor[:, k] = column
        left -= column * column
        left[p] = -np.inf
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components, eigenvalues) of factor @ factor.T by rotating pairs of columns
    until all are orthogonal.  The pairs of a sweep are dealt like a tournament:
    each round holds every column once, so its rotations are one array operation."""
    work = factor.copy()
    r = work.shape[1]
    if r == 0:
        return work, np.zeros(0)
    order = np.arange(r + r % 2)
    half = len(order) // 2
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[:half], order[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = work[:, p], work[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            go = np.abs(c) > eps * np.sqrt(a * b)
            if go.any():
                turned = True
                p, q, x, y, a, b, c = p[go], q[go], x[:, go], y[:, go], a[go], b[go], c[go]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                work[:, p], work[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not turned:
            break
    norms = np.sqrt((work * work).sum(0))
    by = np.argsort(-norms, kind="stable")
    work, norms = work[:, by] / norms[by], norms[by]
    sign = np.sign(work[np.abs(work).argmax(0), np.arange(r)])
    return work * sign, norms * norms


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of the usable rows; None where there are none."""
    n, sums = totals(rows)
    if not n:
        return None
    exact = scatter(rows, n, sums)
    cov = np.array([[x / (n * n) for x in row] for row in exact])  # of integers: rounded once
    vectors, values = jacobi(pivoted_cholesky(cov))
    return Fit(n, sums, vectors[:, :components], values[:components], float(sum(exact[i][i] for i in range(len(sums))) / (n * n)))


def centred(x: np.ndarray, model: Fit) -> np.ndarray:
    """x - S/n without rounding the large parts first."""
    whole = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([s % model.n / model.n for s in model.sums])
    return (x - whole).astype(np.float64) - rest


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sum over dimensions of (n*x-S)**2 of each row; None beyond a long."""
    near = np.abs(centred(x, model)).max(initial=0.0) * model.n
    if near < 2.0 ** 61 and near * near * x.shape[1] < 2.0 ** 62:
        diff = model.n * (x - np.array([s // model.n for s in model.sums])) - np.array([s % model.n for s in model.sums], dtype=np.int64)
        return (diff * diff).sum(axis=1).tolist()
    diff = model.n * x.astype(object) - np.array(model.sums, dtype=object)
    return [int(v) if v < 1 << 63 else None for v in (diff * diff).sum(axis=1)]


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k, turn = len(model.values), model.vectors / np.sqrt(model.values)

    def run(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            for _, x in matrices(b):
                w = centred(x, model) @ turn
                total[:k] += w.T @ w
                total[k] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": total.ravel()})

    total = np.zeros((k + 1, k))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per
    usable vector and component."""
    kind = vectors.schema[ident].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = usable(vectors, ident, vector)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, turn, error = len(model.values), model.vectors / np.sqrt(model.values), identity_error(rows, model)

    def run(batches):
        for b in batches:
            for first, x in matrices(b):
                m = len(x)
                ids = b.column(0).slice(first, m)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()), pa.array([v for v in deviations(x, model) for _ in range(k)], pa.int64()),
                    pa.array((centred(x, model) @ turn).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
