"""The tables that the queries read, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean
from ..operators import mentions
from ..session import stored

LETTERS = "[^a-z]"
#: Lines of orders that a task pairs.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, author, volume, text, title, c): c is the text's letters a to z, title its first line."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("author"), F.col("lang").alias("volume"), text.alias("text"), F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), clean(F.lower(text), LETTERS).alias("c")
    )


def supplier_orders(spark: SparkSession, folder: str) -> DataFrame:
    """(order, person): who delivers to an order, once."""
    return _lines(spark, folder).repartition(_tasks(spark, folder), "order").distinct()


def supplier_sets(spark: SparkSession, folder: str) -> DataFrame:
    """(order, persons): each order once, with all who deliver to it, stored: lines are dealt and told apart once for what is counted from them."""
    return stored(mentions.together(_lines(spark, folder), "order", tasks=_tasks(spark, folder)))[0]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("person"))


def _tasks(spark: SparkSession, folder: str) -> int:
    """How many tasks lines are dealt to: as many as run at a time, or more where there are many lines (their number is in the files' footers)."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "lineitem").count() // TASK_ROWS))


def supplier_pairs(spark: SparkSession, folder: str, sets: DataFrame | None = None) -> DataFrame:
    tasks, lines = _tasks(spark, folder), _lines(spark, folder)
    if sets is None:
        span = lines.agg(F.min("person"), F.max("person")).first()
        return mentions.met_counts(mentions.together(lines, "order", tasks=tasks), "order", tasks, tuple(span))
    span = sets.agg(F.min(F.array_min("persons")), F.max(F.array_max("persons"))).first()
    return mentions.met_counts(sets.repartition(tasks, "order"), "order", tasks, tuple(span))


def supplier_graph(spark: SparkSession, folder: str, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and the pairs that meet more than a standard deviation above the mean (src, dst, weight)."""
    pairs, _ = stored(supplier_pairs(spark, folder, sets))  # read several times
    mean, spread = pairs.agg(F.avg("weight"), F.stddev_pop("weight")).first()
    strong = pairs.where(F.col("weight") > F.lit((mean or 0.0) + (spread or 0.0)))
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id")), strong.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), "weight")


def supplier_nodes(spark: SparkSession, folder: str, sets: DataFrame | None = None) -> DataFrame:
    """(id, weight, size): in how many orders a supplier is."""
    counts = mentions.mention_counts(supplier_orders(spark, folder) if sets is None else sets.select(F.explode("persons").alias("person")))
    return counts.select(F.col("person").alias("id"), F.col("mentions").alias("weight"), mentions.node_size(F.col("mentions")).alias("size"))


def edges_only(spark: SparkSession, folder: str, sets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Suppliers, and the pairs alone (src < dst, each once)."""
    vertices, edges = supplier_graph(spark, folder, sets)
    return vertices, edges.select("src", "dst")
