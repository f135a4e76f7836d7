"""The commonest n-grams with bounded state: a mergeable summary proposes them, a recount makes them exact, and the summary's error proves them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..session import ship, stored

#: Grams that a task's summary holds at first.
CAPACITY = 1 << 16
#: Candidates that are broadcast for the recount.
MOST_CANDIDATES = 1 << 18


def _packed(column: pa.Array, n: int) -> np.ndarray:
    """The n-grams of a batch of texts as numbers of 64 bits, or as bytes where these don't hold ``n`` characters."""
    joined = "\x00".join(t for t in column.to_pylist() if t)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < n:
        return np.zeros(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(points == 0)))
    whole = ends[n:] == ends[: len(ends) - n]  # none of its characters stands between two texts
    bits = 64 // n
    if n <= 3 or points.max() < 1 << bits:
        out = np.zeros(len(points) - n + 1, np.uint64)
        for i in range(n):
            out = (out << np.uint64(bits)) | points[i : len(points) - n + 1 + i]
        return out[whole]
    rows = np.lib.stride_tricks.sliding_window_view(points, n)[whole].astype(">u4")
    return np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * n))).ravel()


def _text(gram: object, n: int) -> str:
    if isinstance(gram, np.void):
        return "".join(map(chr, np.frombuffer(bytes(gram), ">u4")))
    bits = 64 // n
    return "".join(chr(int(gram) >> bits * (n - 1 - i) & (1 << bits) - 1) for i in range(n))


def _summary(texts: DataFrame, text: str, n: int, capacity: int) -> DataFrame:
    """(gram, cnt, lost) of each task: counts that are at most ``lost`` too low, of no more than ``capacity`` grams.

    Where there are more, the count of the first that has no place is taken from all, and those that have nothing left go; what is taken adds up
    to the loss.  A gram that a task doesn't tell occurs no oftener in it than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        lost = 0
        for batch in batches:
            grams, counts = np.unique(_packed(batch.column(0), n), return_counts=True)
            if len(grams) > 4 * capacity:  # the batch's own summary first, so that few grams become strings
                top = int(np.partition(counts, -capacity - 1)[-capacity - 1])
                lost += top
                keep = counts > top
                grams, counts = grams[keep], counts[keep] - top
            for g, c in zip(grams, counts.tolist(), strict=True):
                g = _text(g, n)
                held[g] = held.get(g, 0) + c
            if len(held) > capacity:
                top = int(np.partition(np.fromiter(held.values(), np.int64), -capacity - 1)[-capacity - 1])
                lost += top
                held = {g: c - top for g, c in held.items() if c > top}
        if held or lost:
            names = [*held, None]  # the last row tells the loss alone
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*held.values(), 0]), pa.array([0] * len(held) + [lost])], ["gram", "cnt", "lost"])

    return texts.select(text).mapInArrow(run, "gram string, cnt long, lost long")


def top_ngrams(texts: DataFrame, text: str, n: int, k: int, capacity: int = CAPACITY) -> DataFrame:
    """(n, gram, cnt): the ``k`` commonest n-grams within texts, ties by gram, exactly.

    What is shuffled is a summary for each task and then the counts of candidates, however many distinct grams there are.  A gram's count lies
    between what the summaries tell and that plus all they have lost.  If the k-th largest is told more than was lost, all of the first k are
    told; candidates are those that can reach it.  Otherwise, or with more candidates than are broadcast, the summaries have been too small for these
    texts, and they are taken again, four times as large; in the end they lose nothing.  Characters are code points; a text has no U+0000.
    """
    ship(texts.sparkSession)
    while True:
        found, _ = stored(_summary(texts, text, n, capacity))
        lost = found.agg(F.sum("lost")).first()[0] or 0
        told = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("cnt").alias("cnt"))
        best = [r["cnt"] for r in told.orderBy(F.desc("cnt"), "gram").limit(k).collect()]
        if lost == 0:
            counts = told
            break
        if len(best) == k and best[-1] > lost:
            names, _ = stored(told.where(F.col("cnt") >= best[-1] - lost).select("gram"))
            if names.count() <= MOST_CANDIDATES:
                grams = texts.select(F.explode(ngrams(F.col(text), n)).alias("gram"))
                counts = grams.join(F.broadcast(names), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("cnt"))
                break
        capacity *= 4
    return counts.orderBy(F.desc("cnt"), "gram").limit(k).select(F.lit(n).alias("n"), "gram", "cnt")
