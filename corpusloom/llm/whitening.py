"""Whitening of embeddings by their leading covariance eigenvectors, found by LOBPCG.

The covariance matrix V is never formed.  A step is one pass over the rows, which multiplies V by a block of directions: the iterate, its
residuals and the previous step's directions.  A Rayleigh-Ritz problem on their span, which is as small as the block, gives the next iterate.
Steps go on until the residuals are certified by a product of their own.

Entries are fixed-point numbers, x = floor(1024 c) + 100000.  Rows are centred before they are multiplied, as (n x - S) / n with an exact
integer n x - S, so the offset costs no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import tidy
from ._spark import load, ship

COMPONENTS = 8
#: Directions beyond the wanted ones; more of them make a pass dearer and passes fewer.
GUARD = 16
#: A residual is certified at so much of the largest eigenvalue.
TOLERANCE = 1e-14
MOST_STEPS = 1000
SCALE, OFFSET = 1024, 100_000


@dataclass
class Whitening:
    """What is known of the vectors of one width: ``basis`` has a unit eigenvector in each column, ``values`` their eigenvalues, falling."""

    n: int
    sums: np.ndarray
    trace: float = 0.0
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    residual: float = 0.0
    identity_error: float = 0.0
    steps: int = 0


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of each width in a batch of usable vectors; x is an integer a row and dimension."""
    width = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > 2**52:
        raise OverflowError("an entry is too large for fixed-point numbers")
    x, start = flat.astype(np.int64) + OFFSET, np.cumsum(width) - width
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        yield rows, x[start[rows][:, None] + np.arange(w)]


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if float(np.abs(x).max(initial=0)) * n > 2**62:
        raise OverflowError("too many vectors for integers of 64 bits")
    return n * x - sums


def _totals(rows: DataFrame, per_block, columns: int, kind: str = "double") -> dict[int, np.ndarray]:
    """Sums over all rows, by width: ``per_block(x)`` gives a small matrix with so many columns, added up in the task and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                part = per_block(x)
                w = x.shape[1]
                sums[w] = sums[w] + part if w in sums else part
        for w, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), w)), pa.array(np.arange(len(s))), *(pa.array(np.ascontiguousarray(s[:, j])) for j in range(columns))], names)

    names = ["width", "r", *(f"v{j}" for j in range(columns))]
    found = rows.mapInArrow(tidy(run), "width long, r long, " + ", ".join(f"v{j} {kind}" for j in range(columns)))
    table = found.groupBy("width", "r").agg(*(F.sum(c).alias(c) for c in names[2:])).toArrow().sort_by([("width", "ascending"), ("r", "ascending")])
    width = table.column("width").to_numpy()
    values = np.stack([table.column(c).to_numpy() for c in names[2:]], axis=1) if len(width) else np.zeros((0, columns))
    return {int(w): values[width == w] for w in np.unique(width)}


def _products(rows: DataFrame, models: Mapping[int, Whitening], blocks: Mapping[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """V times each width's block, and V's trace; one pass.  What a task sends is a row for each dimension."""
    columns = max(b.shape[1] for b in blocks.values())
    known = {w: (models[w].n, models[w].sums, b) for w, b in blocks.items()}

    def per_block(x: np.ndarray) -> np.ndarray:
        w = x.shape[1]
        out = np.zeros((w + 1, columns))
        if w in known:
            n, sums, block = known[w]
            c = _deviations(x, n, sums) / n
            out[:w, : block.shape[1]] = c.T @ (c @ block)
            out[w, 0] = (c * c).sum()
        return out

    found = _totals(rows, per_block, columns)
    return {w: (found[w][:w, : b.shape[1]] / models[w].n, float(found[w][w, 0]) / models[w].n) for w, b in blocks.items()}


def _certificate(rows: DataFrame, models: Mapping[int, Whitening], blocks: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, float]]:
    """V times each basis, and how far the covariance of the whitened rows is from the identity; one pass."""
    columns = max(b.shape[1] for b, _ in blocks.values())
    known = {w: (models[w].n, models[w].sums, b, e) for w, (b, e) in blocks.items()}

    def per_block(x: np.ndarray) -> np.ndarray:
        w = x.shape[1]
        out = np.zeros((w + columns + 1, columns))
        if w in known:
            n, sums, basis, values = known[w]
            k = basis.shape[1]
            c = _deviations(x, n, sums) / n
            y = (c @ basis) / np.sqrt(values)
            out[:w, :k], out[w : w + k, :k], out[-1, :k] = c.T @ (c @ basis), y.T @ y, y.sum(axis=0)
        return out

    out = {}
    for w, found in _totals(rows, per_block, columns).items():
        if w in blocks:
            k, n = blocks[w][0].shape[1], models[w].n
            mean = found[-1, :k] / n
            out[w] = found[:w, :k] / n, float(np.abs(found[w : w + k, :k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def _directions(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``more`` adds to the orthonormal ``x``."""
    more = more / np.maximum(np.sqrt((more * more).sum(axis=0)), 1e-300)
    for _ in range(2):
        more = more - x @ (x.T @ more)
    u, s, _ = np.linalg.svd(more, full_matrices=False)
    u = u[:, s > 1e-10][:, : x.shape[0] - x.shape[1]]
    u = u - x @ (x.T @ u)
    return np.linalg.qr(u)[0]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, tolerance: float = TOLERANCE) -> dict[int, Whitening]:
    """A model for each width of the usable vectors.  Directions of no variance are left out, so there may be fewer components.

    Every step is one pass for all widths.  The driver holds a few columns a width, never rows.  Vectors that residuals can't be certified for
    within MOST_STEPS are an error.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(usable(vector)).select(F.col(vector).cast("array<double>").alias("vector"))

    def count(x: np.ndarray) -> np.ndarray:
        return np.stack([x.sum(axis=0), np.full(x.shape[1], len(x))], axis=1)

    models = {w: Whitening(int(s[0, 1]), s[:, 0].astype(np.int64)) for w, s in _totals(rows, count, 2, "long").items()}
    rng = np.random.default_rng(11)
    x = {w: np.linalg.qr(rng.standard_normal((w, min(w, components + GUARD))))[0] for w in models}
    span, open_ = dict(x), set(models)
    for step in range(MOST_STEPS):
        if not open_:
            return models
        done = {}
        for w, (av, trace) in _products(rows, models, {w: span[w] for w in open_}).items():
            models[w].trace, models[w].steps = trace, step + 1
            basis, had = span[w], x[w].shape[1]
            small = basis.T @ av
            values, c = np.linalg.eigh((small + small.T) / 2)
            c, values = c[:, ::-1][:, :had], values[::-1][:had]
            x[w] = basis @ c
            rest = av @ c - x[w] * values
            x[w], t = np.linalg.qr(x[w])  # rounding
            x[w] *= np.sign(np.diag(t))
            left = np.sqrt((rest * rest).sum(axis=0))
            real = int((values[:components] > w * 1e-15 * trace).sum())
            if trace == 0 or real == 0:
                open_.discard(w)
                models[w].basis = np.zeros((w, 0))
            elif left[:real].max() <= tolerance * values[0]:
                done[w] = x[w][:, :real], values[:real]
            span[w] = np.concatenate([x[w], _directions(x[w], np.concatenate([rest, basis[:, had:] @ c[had:]], axis=1))], axis=1)
        for w, (av, error) in (_certificate(rows, models, done) if done else {}).items():
            basis, values = done[w]
            left = float(np.sqrt(((av - basis * values) ** 2).sum(axis=0)).max())
            if left <= 2 * tolerance * values[0]:
                sign = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
                m = models[w]
                m.basis, m.values, m.residual, m.identity_error = basis * sign, values, left, error
                open_.discard(w)
    raise ArithmeticError(f"residuals not certified within {MOST_STEPS} steps")


def whiten(vectors: DataFrame, models: Mapping[int, Whitening], vector: str = "embedding", into: str = "whitened", deviation: str | None = "deviation") -> DataFrame:
    """The usable rows with ``into``, an array of an entry for each component, and ``deviation``, the sum of (n x - S)^2, exact.

    Columns of these names are replaced.  A deviation that a long can't hold is an error; with ``deviation=None`` there is none.
    A width that the models don't have, and an empty vector, get an empty array.
    """
    spark = vectors.sparkSession
    ship(spark)
    added = [into] + ([deviation] if deviation else [])
    others = [c for c in vectors.columns if c not in added]
    rows = vectors.where(usable(vector)).select(*others, F.col(vector).cast("array<double>").alias("__vector"))
    sent = spark.sparkContext.broadcast({w: (m.n, m.sums, m.basis, m.values) for w, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(others))
            sizes, moved = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            found: dict[int, np.ndarray] = {}
            for at, x in _blocks(column):
                if (model := sent.value.get(x.shape[1])) is None:
                    continue
                n, sums, basis, values = model
                d = _deviations(x, n, sums)
                if deviation:
                    f = d.astype(np.float64)
                    if (f * f).sum(axis=1).max(initial=0) >= 9.2e18:
                        raise OverflowError("a deviation doesn't fit a long")
                    moved[at] = (d * d).sum(axis=1)
                sizes[at] = basis.shape[1]
                found[x.shape[1]] = at, (d / n @ basis) / np.sqrt(values)
            start = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.zeros(start[-1])
            for at, y in found.values():
                flat[start[at][:, None] + np.arange(y.shape[1])] = y
            arrays = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(flat))] + ([pa.array(moved)] if deviation else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *arrays], [*others, *added])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*others).schema]
    return rows.mapInArrow(tidy(run), ", ".join([*kinds, f"`{into}` array<double>", *([f"`{deviation}` long"] if deviation else [])]))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of another width are a fit list of their own; components of no variance are not returned."""
    vectors = load(spark, folder, "embeddings").select("vec_id", "embedding")
    models = fit(vectors)
    about = spark.createDataFrame(
        [(w, i + 1, m.n, float(m.values[i] / m.trace), m.identity_error) for w, m in models.items() for i in range(len(m.values))], "width int, component int, n long, explained double, identity_error double"
    )
    out = whiten(vectors, models).select("vec_id", F.size("embedding").alias("width"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    told = out.withColumn("component", F.col("place") + 1).join(F.broadcast(about), ["width", "component"])  # a row for each width and component
    return told.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
