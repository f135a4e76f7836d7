"""Counts, rankings and length statistics of texts by author and volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def ranked(df: DataFrame, by: str, *ties: str, into: str = "rank") -> DataFrame:
    """Positions 1, 2, ... by ``by`` descending; ties get positions of their own, in the order of ``ties``, which must tell them apart."""
    return numbered(df, F.desc(by), *ties, into=into)


def author_counts(docs: DataFrame, author: Column | str, into: str = "author") -> DataFrame:
    return docs.groupBy((F.col(author) if isinstance(author, str) else author).alias(into)).agg(F.count("*").alias("docs"))


def author_overview(counts: DataFrame) -> DataFrame:
    """One row: texts, authors, mean texts an author, authors with one text."""
    return counts.agg(
        F.sum("docs").alias("docs"), F.count("*").alias("authors"), F.round(F.sum("docs") / F.count("*"), 6).alias("mean_docs"), F.count_if(F.col("docs") == 1).alias("singletons")
    )


def top_shares(counts: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, docs, share): what the first ``k`` authors hold, in per cent.  Only the first ones of the largest ``k`` are put in order."""
    first = counts.orderBy(F.desc("docs"), "author").limit(max(ks)).agg(F.transform(F.array_sort(F.collect_list(-F.col("docs"))), lambda n: -n).alias("best"))
    whole = counts.agg(F.sum("docs").alias("all")).join(first)  # one row each
    held = lambda k: F.when(F.size("best") > 0, F.aggregate(F.slice("best", 1, k), F.lit(0).cast("long"), lambda a, n: a + n))
    shares = F.array(*(F.struct(F.lit(k).alias("k"), held(k).alias("docs")) for k in ks))
    return whole.select("all", F.explode(shares).alias("s")).select("s.k", "s.docs", F.round(100 * F.col("s.docs") / F.col("all"), 6).alias("share"))


def volume_counts(docs: DataFrame, volume: str) -> DataFrame:
    return docs.groupBy(F.col(volume).alias("volume")).agg(F.count("*").alias("docs"))


def by_volume(counts: DataFrame) -> DataFrame:
    """Counts with their place in the order of volumes."""
    return numbered(counts, "volume", into="place")


def length_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row over the raw texts: total, mean, longest and shortest; of equally long ones the last by key."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return docs.agg(
        F.sum(n).alias("total_chars"), F.round(F.avg(n), 6).alias("mean_chars"), F.max(n).alias("max_chars"), F.max_by(key, F.struct(n, F.col(key))).alias("longest"),
        F.min(n).alias("min_chars"), F.max_by(key, F.struct(-n, F.col(key))).alias("shortest"),
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal bins from the least to the largest value, the last one closed; empty bins are left out."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    place = F.floor((F.col(value) - F.lit(lo)) * bins / F.lit(max(hi - lo, 1)))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def author_chars(docs: DataFrame, author: str, cleaned: str) -> DataFrame:
    """(author, docs, chars, mean_chars, rank) over the texts that are not empty."""
    n = F.length(cleaned)
    counts = docs.where(n > 0).groupBy(F.col(author).alias("author")).agg(F.count("*").alias("docs"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean_chars"))
    return ranked(counts, "chars", "author")


def title_comparison(docs: DataFrame, author: str, title: str, cleaned: str) -> DataFrame:
    """Each author's characters with and without titles, the ranks by either, and their difference as text (+ if it rose)."""
    n, t = F.length(cleaned), F.length(title)
    sums = docs.groupBy(F.col(author).alias("author")).agg(F.sum(n).alias("without_title"), F.sum(n + t).alias("with_title"), F.sum(t).alias("title_chars"))
    both = ranked(ranked(sums, "without_title", "author", into="rank_without"), "with_title", "author", into="rank_with")
    delta = F.col("rank_with") - F.col("rank_without")
    return both.withColumn("title_share", F.when(F.col("with_title") > 0, F.round(100 * F.col("title_chars") / F.col("with_title"), 6))).withColumn(
        "change", F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
    )


def author_summary(docs: DataFrame, author: str, cleaned: str, grams: DataFrame, sizes: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """(author, docs, chars, mean, unique_<n>gram, total_<n>gram); ``grams`` is (author, n, gram, cnt)."""
    base = docs.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("docs"), F.sum(F.length(cleaned)).alias("chars"))
    wide = grams.groupBy(F.col(author).alias("author")).agg(
        *(F.count_if(F.col("n") == n).alias(f"unique_{n}gram") for n in sizes), *(F.coalesce(F.sum(F.when(F.col("n") == n, F.col("cnt"))), F.lit(0)).alias(f"total_{n}gram") for n in sizes)
    )
    out = base.join(wide, "author", "left").na.fill(0)
    return out.withColumn("mean_chars", F.round(F.col("chars") / F.col("docs"), 6))
