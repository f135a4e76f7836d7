"""Look-ups in a corpus, as a read API would serve them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(found: DataFrame, limit: int, order: str) -> DataFrame:
    """The first rows in load order; a limit below one still gives one row."""
    return found.orderBy(order).limit(max(1, limit))


def search(docs: DataFrame, query: str, columns: Sequence[str], limit: int = 10, order: str = "doc_id") -> DataFrame:
    """Rows with the query, regardless of case, in one of the columns; % and _ mean themselves.  An empty query is an error."""
    if not query:
        raise ValueError("the query is empty")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return _first(docs.where(hit), limit, order)


def by_author(docs: DataFrame, author: str, column: str = "author", limit: int = 10, order: str = "doc_id") -> DataFrame:
    return _first(docs.where(F.lower(F.col(column)) == author.lower()), limit, order)


def by_volume(docs: DataFrame, volume: object, column: str = "volume", limit: int = 10, order: str = "doc_id") -> DataFrame:
    return _first(docs.where(F.col(column) == F.lit(volume)), limit, order)


def authors(docs: DataFrame, column: str = "author", limit: int = 50) -> DataFrame:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return docs.select(F.col(column).alias("author")).distinct().orderBy("author").limit(limit)


def corpus_stats(docs: DataFrame, author: str = "author", volume: str = "volume") -> DataFrame:
    n = F.count_distinct(author)
    return docs.agg(F.count("*").alias("docs"), n.alias("authors"), F.count_distinct(volume).alias("volumes"), F.round(F.count("*") / F.nullif(n, F.lit(0)), 6).alias("mean_docs"))


def random_row(docs: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, the same one for a seed."""
    return docs.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}"))), key).limit(1)
