"""Embedding near-dedup on a pivot-permutation index.

Each vector is described by its nearest pivots, in order.  A pivot's inverted list has the vectors that it
describes; two vectors of a list that share enough pivots are compared exactly.  A pair meets in the list of
its first shared pivot only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import grouped, mix, signed, tidy
from ._components import components
from ._spark import cut, load, ship

#: The index is fitted on so many vectors at most, chosen by a hash of the id; every vector is indexed.
FIT_VECTORS = 20_000
PIVOTS = (32, 2048)
VECTORS_A_PIVOT = 100
#: Pivots are so many times the angle of a link apart.
APART = 1.25
DESCRIBED_BY = 8
SHARED = 2
#: Vectors of one block of an inverted list; longer lists are compared block by block.
BLOCK_VECTORS = 1024
_TILE = 256


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors in double precision; a zero row for what is linked with nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width))
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fits = size == width
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    run, _ = grouped(size)
    out[fits] = flat[fits[run]].reshape(-1, width)
    out[~np.isfinite(out).all(axis=1)] = 0
    out /= np.maximum(np.abs(out).max(axis=1, initial=0), 1e-300)[:, None]  # no overflow in the squares
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def choose_pivots(rows: DataFrame, width: int, count: int, threshold: float = 0.9) -> np.ndarray:
    """Up to ``count`` vectors of a bounded sample, each the farthest of a few from those before, and no two of them nearly linked.

    In a tight cluster pivots that are near each other would be told apart by noise alone, so that linked vectors seldom share any.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, FIT_VECTORS / max(count * VECTORS_A_PIVOT, FIT_VECTORS))) + 1
    found = rows.where(share).orderBy(F.xxhash64("id"), "id").limit(FIT_VECTORS).select("vector").toArrow()
    x = _matrix(found.column("vector"), width)
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.zeros((0, width))
    rng = np.random.default_rng(5)
    x = x[rng.permutation(len(x))]
    chosen = [0]
    near = x @ x[0]
    apart = np.cos(APART * np.arccos(np.clip(threshold, -1, 1)))
    for _ in range(4 * count):
        some = rng.integers(0, len(x), 8)
        i = int(some[near[some].argmin()])
        if len(chosen) == min(count, len(x)):
            break
        if near[i] < apart:
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
    return x[chosen]


def _describe(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    k = min(DESCRIBED_BY, len(pivots))
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ pivots.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(top, order, 1)
    return out


def index(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(pivot, id, copies, unit, near): each vector (id, copies, vector) under each of its pivots."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")), width)
            ids, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "copies"))
            near = _describe(x, sent.value)
            unit, codes = [r.tobytes() for r in x], [r.astype(np.int32).tobytes() for r in near]
            for a in range(0, len(x), 1000):
                r, place = grouped(np.full(len(x[a : a + 1000]), near.shape[1]))
                r += a
                yield pa.RecordBatch.from_arrays(
                    [signed(near[r, place]), signed(ids[r]), signed(copies[r]), pa.array([unit[i] for i in r], pa.binary()), pa.array([codes[i] for i in r], pa.binary())], ["pivot", "id", "copies", "unit", "near"]
                )

    return rows.mapInArrow(tidy(run), "pivot long, id long, copies long, unit binary, near binary")


def _compare(table: pa.Table, width: int, threshold: float) -> pa.Table:
    """Verified links of one block (or pair of blocks) of a list: their number for each vector, and a forest that joins what they join."""
    rows = table.sort_by("id")
    ids = rows.column("id").to_numpy()
    x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(ids), width)
    near = np.frombuffer(b"".join(rows.column("near").to_pylist()), np.int32).reshape(len(ids), -1).astype(np.int64)
    pivot, right = rows.column("pivot")[0].as_py(), rows.column("right").to_numpy()
    names = np.unique(near)
    has = np.zeros((len(ids), len(names)), np.float32)
    has[np.arange(len(ids))[:, None], np.searchsorted(names, near)] = 1
    before = has[:, : np.searchsorted(names, pivot)]
    a_side, b_side = (np.flatnonzero(~right), np.flatnonzero(right)) if right.any() else (np.arange(len(ids)),) * 2
    weight = rows.column("copies").to_numpy()
    counts = np.zeros(len(ids), np.int64)
    top = np.arange(len(ids))  # of what is joined already, the least
    within = not right.any()
    for s in range(0, len(a_side), _TILE):
        a = a_side[s : s + _TILE]
        b = b_side[s:] if within else b_side
        if not len(b):
            continue
        shared = has[a] @ has[b].T
        ours = (shared >= min(SHARED, near.shape[1])) & ((before[a] @ before[b].T) == 0) & (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        if within:
            ours &= b[None, :] > a[:, None]
        counts[a] += ours @ weight[b]
        counts[b] += weight[a] @ ours
        while True:  # join each vector with one of those that it is linked with and not joined yet
            open_ = ours & (top[a][:, None] != top[b][None, :])
            i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(i):
                break
            _join(top, np.concatenate((a[i], a[open_[:, j].argmax(axis=0)])), np.concatenate((b[open_[i].argmax(axis=1)], b[j])))
    some = np.flatnonzero(counts)
    return pa.table({"id": signed(ids[some]), "n": signed(counts[some]), "to": signed(ids[top[some]])})


def _join(top: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins u[i] and v[i]: ``top`` then has the least of all that each is joined with."""
    while (top[u] != top[v]).any():
        high, low = np.maximum(top[u], top[v]), np.minimum(top[u], top[v])
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top[:] = top[top]


def _found(rows: DataFrame, width: int, count: int, threshold: float, vectors_a_pivot: int) -> DataFrame | None:
    """(id, n, to): verified links among ``rows`` (id, copies, vector), all of one width; None where nothing can be linked."""
    pivots = choose_pivots(rows, width, int(min(max(count // vectors_a_pivot, PIVOTS[0]), PIVOTS[1])), threshold)
    if not len(pivots):
        return None
    lists = index(rows, pivots, width)
    sizes = lists.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    dealt = (
        lists.join(F.broadcast(sizes), "pivot").withColumn("own", own)  # a row for each pivot
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"), "id", "copies", "unit", "near")
    )

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, width, threshold)

    return dealt.groupBy("pivot", "lo", "hi").applyInArrow(compare, "id long, n long, to long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, vectors_a_pivot: int = VECTORS_A_PIVOT) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component, kept.

    Links are the pairs of vectors of one width with cosine >= ``threshold`` (double precision) that the index finds: those that
    share SHARED of their DESCRIBED_BY nearest pivots.  Each width has an index of its own.  Equal vectors are indexed once, with the least of
    their keys, and are all linked with each other.  A null or zero vector and one that holds a null or a non-finite component
    is linked with nothing.  Rows that repeat a key are one vector, the least; a null key is linked with nothing (component null, kept).
    ``component`` is the least key reachable over links.  Keys are numbers.  Other columns are not read.
    """
    ship(vectors.sparkSession)
    raw = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = raw.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).groupBy("id").agg(F.min("vector").alias("vector"))
    fit = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.where(fit).select("id", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"), "vector")
    equal = cut(rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    widths = equal.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).where("n > 1").orderBy("width").collect()  # a row for each width
    found = [f for w in widths if (f := _found(equal.where(F.size("vector") == w["width"]).select("id", "copies", "vector"), w["width"], w["n"], threshold, vectors_a_pivot)) is not None]
    nothing = vectors.sparkSession.createDataFrame([], "id long, n long, to long")
    links = cut(functools.reduce(DataFrame.unionByName, found, nothing))
    others = links.groupBy("id").agg(F.sum("n").alias("others"))
    groups = components(links.select(F.col("id").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "id")
    told = equal.join(others, "id", "left").join(groups, "id", "left").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    told = rows.select("id", "k1", "k2").join(told.where("n_links > 0"), ["k1", "k2"]).drop("k1", "k2")
    out = raw.select("id").join(told, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(load(spark, folder, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT a AS vec_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
