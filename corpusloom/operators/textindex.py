"""Substring search by an inverted index of trigrams, and look-ups in a table that is laid out by a column.

An index is written once to a folder and has three tables: the trigrams with the number of texts that have them, their posting lists, and the rows in
blocks of keys.  A query reads the lists of its rarest trigrams alone, intersects them, and verifies the rows of that intersection, of which it
reads only the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

LIST_FOLDERS = 64
BLOCKS = 64
#: Lists that are intersected; more of them read more and exclude little.
LISTS = 4
#: Rows that one round of a search verifies at most.
MOST_ROUND = 4096


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _codes(text: str) -> np.ndarray:
    """The trigrams of a text, each as a number of 63 bits, sorted, once; the last ones are filled up with zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whole = np.concatenate((points, [0, 0]))
    return np.unique((whole[:-2] << 42) | (whole[1:-1] << 21) | whole[2:])


def _folder(gram: Column) -> Column:
    """Lists lie by their first character, so what begins alike lies together."""
    return F.pmod(F.xxhash64(F.shiftright(gram, 42)), F.lit(LIST_FOLDERS)).cast("int")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, base, n, at): of each batch of (key, text, ...) the keys of every trigram, as offsets from a base."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        texts = zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)), strict=True)
        found = [np.unique(np.concatenate([_codes(t) for t in own if t] or [np.zeros(0, np.int64)])) for own in texts]
        if not sum(map(len, found)):
            continue
        gram, key = np.concatenate(found), np.repeat(keys, [len(f) for f in found])
        base = key >> 31 << 31  # offsets fit an int
        order = np.lexsort((key, base, gram))
        gram, base, at = gram[order], base[order], (key - base)[order].astype(np.int32)
        new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (base[1:] != base[:-1]))))
        ends = np.concatenate((new, [len(gram)]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at))
        yield pa.RecordBatch.from_arrays([pa.array(gram[new]), pa.array(base[new]), pa.array(np.diff(ends)), lists], ["gram", "base", "n", "at"])


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """An index in a folder over the text of some columns; ``key`` tells rows apart and is their load order."""

    folder: str
    key: str
    columns: tuple[str, ...]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def grams_of(self, spark: SparkSession, query: str) -> list[int]:
        """Those of a query, lower-cased as the texts were, without what ends a text."""
        lowered = spark.range(1).select(F.lower(F.lit(query))).first()[0]
        return [g for g in _codes(lowered).tolist() if g & (1 << 21) - 1] if len(lowered) >= 3 else []

    def candidates(self, spark: SparkSession, query: str) -> DataFrame:
        """(key): rows that have the query's rarest trigrams, and so all that contain it."""
        lists, wanted = self.table(spark, "postings"), self.grams_of(spark, query)
        key = lambda rows: rows.select("gram", F.explode("at").alias("o"), "base").select("gram", (F.col("base") + F.col("o")).alias("key"))
        if not wanted:  # one or two characters: the trigrams that begin with them
            points = [ord(c) for c in spark.range(1).select(F.lower(F.lit(query))).first()[0]]
            low, width = sum(p << 21 * (2 - i) for i, p in enumerate(points)), 1 << 21 * (3 - len(points))
            place = spark.range(1).select(_folder(F.lit(low))).first()[0]
            return key(lists.where((F.col("folder") == place) & (F.col("gram") >= low) & (F.col("gram") < low + width))).select("key").distinct()
        places = {r[0]: r[1] for r in spark.createDataFrame([(g,) for g in wanted], "gram long").select("gram", _folder(F.col("gram"))).collect()}
        among = lambda grams: F.col("folder").isin(sorted({places[g] for g in grams})) & F.col("gram").isin(grams)
        sizes = self.table(spark, "grams").where(among(wanted)).select("n", "gram")
        found = sorted(tuple(r) for r in sizes.collect())  # as many as the query has
        if len(found) < len(wanted):
            return spark.createDataFrame([], "key long")
        rare = [g for _, g in found[:LISTS]]
        hits = key(lists.where(among(rare)))
        return hits.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("key")

    def search(self, spark: SparkSession, query: str, limit: int = 10) -> DataFrame:
        """The first rows, by key, with the query in one of the columns, regardless of case; a limit below one gives one row.

        Candidates are verified in rounds, in the order of their keys, until there are enough; a round's keys are literals, so the rows'
        scan reads their blocks only.
        """
        if not query:
            raise ValueError("the query is empty")
        limit = max(1, limit)
        rows, keys = self.table(spark, "rows"), self.candidates(spark, query).where("key IS NOT NULL")
        found, count, size = [], 0, 4 * limit
        while True:
            some = [tuple(r) for r in keys.orderBy("key").limit(size).select("key", _block(F.col("key"))).collect()]
            if some:
                ours, blocks = [k for k, _ in some], sorted({b for _, b in some})
                hits = self._verified(rows.where(F.col("block").isin(blocks) & F.col(self.key).isin(ours)), query).orderBy(self.key).limit(limit)
                found += [r[self.key] for r in hits.select(self.key).collect()]
            if len(found) >= limit or len(some) < size:
                break
            keys, size = keys.where(F.col("key") > F.lit(some[-1][0])), min(4 * size, MOST_ROUND)
        first = sorted(found)[:limit]
        blocks = [r[0] for r in spark.createDataFrame([(k,) for k in first], rows.select(self.key).schema).select(_block(F.col(self.key))).distinct().collect()] if first else []
        return rows.where(F.col("block").isin(blocks) & F.col(self.key).isin(first)).drop("block") if first else rows.drop("block").limit(0)

    def search_all(self, spark: SparkSession, query: str) -> DataFrame:
        """All rows with the query; blocks are pruned by the candidates at run time."""
        keys = self.candidates(spark, query).select(F.col("key").alias("__key"), _block(F.col("key")).alias("__block"))
        rows = self.table(spark, "rows")
        return self._verified(rows.join(keys, (F.col("block") == F.col("__block")) & (F.col(self.key) == F.col("__key"))).drop("__key", "__block"), query).drop("block")

    def _verified(self, rows: DataFrame, query: str) -> DataFrame:
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(query))), F.lit(False))
        return rows.where(hit)


def write_index(docs: DataFrame, folder: str, columns: Sequence[str], key: str = "doc_id") -> TextIndex:
    """Write the index of ``docs``, whose keys are integers; rows without one are not found.

    A batch of rows gives one list for each trigram, so the keys are sorted and put together before they travel.  Lists lie by the first character and
    a hash of their content, sorted by trigram, so the many lists of a very common trigram fill many files.
    """
    spark = docs.sparkSession
    ship(spark)
    n = _partitions(spark)
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), *(F.lower(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    lists = texts.mapInArrow(_lists, "gram long, base long, n long, at array<int>").withColumn("folder", _folder(F.col("gram")))
    dealt = lists.repartition(n, "folder", F.pmod(F.xxhash64("gram", "at"), F.lit(max(1, n // LIST_FOLDERS)))).sortWithinPartitions("folder", "gram", "base")
    dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/postings")
    sizes = spark.read.parquet(f"{folder}/postings").groupBy("folder", "gram").agg(F.sum("n").alias("n"))
    sizes.repartitionByRange(n, "folder", "gram").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{folder}/grams")
    rows = docs.withColumn("block", _block(F.col(key)))
    rows.repartitionByRange(n, "block", key).sortWithinPartitions("block", key).write.mode("overwrite").partitionBy("block").parquet(f"{folder}/rows")
    return TextIndex(folder, key, tuple(columns))


def write_laid_out(docs: DataFrame, folder: str, column: str = "volume", key: str = "doc_id") -> None:
    """A table with a folder for each value of a column; a value with very many rows has many files, each with a range of keys."""
    docs.repartitionByRange(_partitions(docs.sparkSession), column, key).sortWithinPartitions(column, key).write.mode("overwrite").partitionBy(column).parquet(folder)


def rows_of_values(laid_out: DataFrame, values: DataFrame, column: str = "volume") -> DataFrame:
    """Rows of a laid-out table whose value is among ``values``, a small selection; the other folders are left out when it runs."""
    return laid_out.join(F.broadcast(values.select(column).distinct()), column, "left_semi")
