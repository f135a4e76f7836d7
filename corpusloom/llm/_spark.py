"""Helpers on the Spark side."""

from __future__ import annotations

import operator
import typing
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship
from ._bytes import tidy

__all__ = ["column_udf", "cut", "labelled_sample", "load", "ship", "shuffle_partitions", "with_place"]


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_udf(kind: str, run: Callable[[Iterator], Iterator]) -> Callable[..., Column]:
    """A pandas function over batches of columns, run once for a row.

    It counts as nondeterministic so that a filter on its result is not pushed below it, which would run it twice.
    """
    hints = typing.get_type_hints(run, globals() | {"Iterator": Iterator, "pd": pd})
    wrapped = tidy(run)
    wrapped.__annotations__ = hints
    return F.pandas_udf(kind)(wrapped).asNondeterministic()


def with_place(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with what ``labelled_sample`` chooses by: a hash of key and text, and the text's bytes.  Before a join with labels, so that it needs no texts to choose."""
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), text), 1)
    return docs.withColumns({"__place": place, "__bytes": F.octet_length(text)})


def labelled_sample(rows: DataFrame, kind: str, most: int, most_bytes: int) -> tuple[list, dict]:
    """A bounded sample of each class of ``rows`` (k, t and ``kind``: key, text and class, none null, ``with_place``), sorted by key and text, and how many rows each class has in all.

    Rows are taken in the order of a hash of key and text, whatever their length, until a class has ``most`` rows or ``most_bytes`` bytes of
    text; a text that is longer than ``most_bytes`` by itself is passed over.  Rows repeated in full are counted each and taken once.
    """
    sizes = {r[kind]: r["n"] for r in rows.groupBy(kind).agg(F.count("*").alias("n")).collect()}
    # the first by hash: a share of the hash's range that holds about ``most`` rows, of which only places and lengths are looked at
    shares = {c: min(1.0, (most + 4 * most**0.5) / n) for c, n in sizes.items()}
    # as alternatives, so that the places' part of it passes below a join with the labels and only texts that may be chosen travel
    within = lambda ends: reduce(operator.or_, ((F.col(kind) == c) & (F.col("__place") <= end) for c, end in ends.items()), F.lit(False))
    first = rows.where(within({c: min((1 << 63) - 1, int(share * 2.0**63)) for c, share in shares.items()}))
    seen = first.groupBy(kind, "__place").agg(F.max("__bytes").alias("bytes")).collect()
    ends = dict.fromkeys(sizes, -1)
    for c in sizes:
        total = 0
        for n, r in enumerate(sorted((r for r in seen if r[kind] == c and r["bytes"] <= most_bytes), key=lambda r: r["__place"])):
            total += r["bytes"]
            if n >= most or total > most_bytes:
                break
            ends[c] = r["__place"]
    found = rows.where(within(ends) & (F.col("__bytes") <= most_bytes)).select("k", "t", kind).dropDuplicates().collect()
    return sorted(found, key=lambda r: (r["k"], r["t"])), sizes
