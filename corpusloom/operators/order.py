"""Total orders in which no task holds all rows, or all of a group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_WITHIN = (1 << 33) - 1
#: Rows of one task where wide rows are put in order.
BLOCK = 25_000
#: Bytes of text that a task puts in order, about.
TASK_BYTES = 64 << 20
#: Blocks of a span.
FAN = 512


def tasks_for(df: DataFrame, text: str) -> int:
    """How many tasks rows are dealt to: as many as the session has, or more where their text is long, so that a task's share doesn't grow with the input."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def numbered(df: DataFrame, *order: Column | str, into: str = "rank", group: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """``df`` with positions 1, 2, ... in ``order``, within each ``group`` if there is one; the order must tell rows apart.

    The rows are range partitioned by group and order and sorted in each partition.  They are written as such, because the bounds of the ranges
    come from a sample, and read again with their place in the partition.  The position is that place and the number of rows in the
    partitions before, which is counted for each partition, or each partition and group.  Rows of one group lie in as many partitions as they fill.  ``tasks`` is the number of
    partitions, the session's unless given.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    dealt = df.repartitionByRange(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows, _ = stored(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND(F.lit(_WITHIN)).alias("__place")
    rows = rows.select(*df.columns, part, place)
    if not group:
        sizes = sorted(tuple(r) for r in rows.groupBy("__part").count().collect())  # a row for each partition
        starts = [0, *accumulate(n for _, n in sizes)]
        before = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "__part long, __before long")
        told = rows.join(F.broadcast(before), "__part")
        return told.select(*df.columns, (F.col("__before") + F.col("__place") + 1).alias(into))
    sizes = rows.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    earlier = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition that the group is in
    starts = sizes.select(*(F.col(g).alias(f"__of_{g}") for g in group), F.col("__part").alias("__of"), (F.coalesce(earlier, F.lit(0)) - F.col("__first")).alias("__start"))
    same = F.col("__part") == F.col("__of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return rows.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__place") + 1).alias(into))


def arranged(df: DataFrame, order: str, group: str, into: str = "number", block: int = BLOCK) -> DataFrame:
    """``df`` as ``numbered`` by one column within each value of another, dealt by ranges and sorted in that order, so that it can be written in it.

    For wide rows: only their keys are numbered first.  Every ``block`` of numbers has its first key in a table of that many rows less, which
    is broadcast; a row finds a span of ``FAN`` blocks and its block in that, travels once, and is counted within its block.
    """
    keys = numbered(df.select(F.col(group).alias("__g"), F.col(order).alias("__lo")), "__lo", into="__n", group=["__g"])
    starts, _ = stored(keys.where((F.col("__n") - 1) % block == 0).select("__g", F.struct("__lo").alias("__lo"), "__n", F.floor((F.col("__n") - 1) / (block * FAN)).alias("__of")))
    w = Window.partitionBy("__g").orderBy("__n")  # a row for each block
    blocks = starts.select(F.col("__g").alias("__h"), F.col("__of").alias("__in"), "__lo", "__n", F.lead("__lo").over(w).alias("__hi"))
    spans = starts.where((F.col("__n") - 1) % (block * FAN) == 0).select("__g", "__of", F.col("__lo").alias("__from"), F.lead("__lo").over(w).alias("__to"))
    at = F.struct(F.col(order).alias("__lo"))
    within = lambda lo, hi: (at >= F.col(lo)) & (F.col(hi).isNull() | (at < F.col(hi)))
    found = df.join(F.broadcast(spans), F.col(group).eqNullSafe(F.col("__g")) & within("__from", "__to"))
    found = found.join(F.broadcast(blocks), F.col(group).eqNullSafe(F.col("__h")) & (F.col("__of") == F.col("__in")) & within("__lo", "__hi"))
    dealt = found.select(*df.columns, "__n").repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group, "__n")
    w = Window.partitionBy(group, "__n").orderBy(order)
    return dealt.withColumn(into, F.col("__n") + F.row_number().over(w) - 1).select(*df.columns, into).sortWithinPartitions(group, into)
