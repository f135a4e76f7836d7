"""Character and n-gram counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import characters, ngrams
from ..session import stored
from .order import numbered

#: Texts of one task where characters are carried from text to text.
RUN = 200_000


def char_frequency(texts: DataFrame, text: str) -> DataFrame:
    """(ch, n): how often each character but white space occurs."""
    return texts.select(F.explode(characters(F.col(text))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def _summed(texts: DataFrame, text: str, sizes: Sequence[int], by: Sequence[str], more: DataFrame | None = None) -> DataFrame:
    """(by..., gram, cnt) of all sizes, and those of ``more`` (by..., gram).

    Only the longest grams are taken apart place by place; shorter ones begin them, but for those within the last few characters
    of a text.  So each place gives one row to the first sum, and what is left of that gives the other sizes.
    """
    most = max(sizes)
    last = [ngrams(F.right(F.col(text), F.lit(most - 1)), n) for n in sizes if n < most]
    longest = texts.select(*by, F.explode(F.concat(ngrams(F.col(text), most), *last)).alias("gram")).groupBy(*by, "gram").agg(F.count("*").alias("cnt"))
    if last:
        begun = F.when(F.length("gram") == most, F.array(*(F.left("gram", F.lit(n)) for n in sizes))).otherwise(F.array("gram"))
        longest = longest.select(*by, F.explode(begun).alias("gram"), "cnt")
    if more is not None:
        longest = longest.unionByName(more.groupBy(*by, "gram").agg(F.count("*").alias("cnt")))
    return longest.groupBy(*by, "gram").agg(F.sum("cnt").alias("cnt")) if last or more is not None else longest


def ngram_counts(texts: DataFrame, text: str, sizes: Sequence[int] = (1, 2, 3, 4), by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, gram, cnt): n-grams within each text, all sizes in one pass; summed on the map side before the shuffle."""
    return _summed(texts, text, sizes, by).select(*by, F.length("gram").alias("n"), "gram", "cnt")


def ngram_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "n").agg(F.count("*").alias("unique_grams"), F.sum("cnt").alias("total_grams"))


def top(counts: DataFrame, k: int, *ties: str, by: str = "cnt") -> DataFrame:
    """The ``k`` largest, ties in the order of ``ties``."""
    return counts.orderBy(F.desc(by), *ties).limit(k)


def top_each(counts: DataFrame, k: int, group: Sequence[str], *ties: str, by: str = "cnt") -> DataFrame:
    """The ``k`` largest of each group with their rank (1, 2, ...)."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def char_weights(counts: DataFrame, k: int = 50, most: int = 20) -> DataFrame:
    """(ch, weight): characters of the ``k`` commonest grams, weighted by the grams' counts."""
    return top(top(counts, k, "gram").select(F.explode(F.split("gram", "")).alias("ch"), "cnt").groupBy("ch").agg(F.sum("cnt").alias("weight")), most, "ch", by="weight")


def joined_ngram_counts(texts: DataFrame, author: str, order: str, text: str, sizes: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """(author, n, gram, cnt) over each author's texts joined end to end in ``order``, without joining them.

    A gram of the joined text lies within one text, or it ends within the first n - 1 characters of a text and begins in the n - 1
    characters before it.  The latter come from short heads and tails alone, so no text is shuffled and no author's texts meet in a task.
    """
    reach = max(sizes) - 1
    if not reach:
        return ngram_counts(texts, text, sizes, (author,))
    ends = texts.where(F.length(text) > 0).select(author, F.col(order).alias("__order"), F.left(text, F.lit(reach)).alias("head"), F.right(text, F.lit(reach)).alias("tail"))
    more = carried(ends, author, "__order", reach).select(author, "head", "before")
    across = F.concat(*(ngrams(F.concat(F.right("before", F.lit(n - 1)), F.left("head", F.lit(n - 1))), n) for n in sizes if n > 1))
    more = more.where("before <> ''").select(author, F.explode(across).alias("gram"))
    return _summed(texts, text, sizes, (author,), more).select(author, F.length("gram").alias("n"), "gram", "cnt")


def carried(ends: DataFrame, author: str, order: str, reach: int, run: int = RUN) -> DataFrame:
    """``ends`` (author, order, tail, ...) with ``before``: the ``reach`` characters that come before a text in its author's texts.

    Texts are numbered by author and order without bringing them together, and runs of ``run`` numbers are a task's work.  A run's last texts, as many as can
    matter, are also given to the next one, so what is carried crosses runs, and one author's texts may fill any number of them.
    """
    at = numbered(stored(ends)[0], author, order, into="__at").withColumn("__run", F.floor((F.col("__at") - 1) / run))
    last = (F.col("__at") - 1) % run >= run - reach
    dealt = at.select("*", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__next"))
    w = Window.partitionBy(F.col("__run") + F.col("__next")).orderBy("__at")
    tails = [F.when(F.lag(author, i).over(w).eqNullSafe(F.col(author)), F.lag("tail", i).over(w)) for i in range(reach, 0, -1)]
    told = dealt.withColumn("before", F.right(F.concat(*(F.coalesce(t, F.lit("")) for t in tails)), F.lit(reach)))
    return told.where("__next = 0").select(*ends.columns, "before")
