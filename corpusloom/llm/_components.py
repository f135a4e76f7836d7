"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut


#: Up to so many edges, the rounds run in one partition and need no shuffle; a task can always hold as many.
ONE_PARTITION = 50_000


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _two(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) twice from each row; unlike a union this stays in the row's partition."""
    return rows.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the least of its neighbourhood."""
    both = _two(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return _ordered(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _ordered(_two(edges.join(least, "u"), ("v", "m"), ("u", "m")))


def _state(edges: DataFrame) -> tuple:
    """Tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (u, v) the least node reachable from it, itself included.

    Edges may come in either direction, repeated, or as loops; nodes must not be null.  Each round is written to the shared
    checkpoint folder, and the rounds end when the edges no longer change: every node then hangs on its least one.
    A node that has only loops is not returned, an empty table gives an empty one.
    """
    now = cut(_ordered(edges))
    state, before = _state(now), None
    small = state[0] <= ONE_PARTITION
    while state != before:
        now = now.coalesce(1) if small else now
        before, now = state, cut(_small_star(_large_star(now)))
        state = _state(now)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
