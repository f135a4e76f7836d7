"""What each of several filters removes alone, together and in every order: a Walsh-Hadamard audit.

A document's mask has a bit for each filter that it fails.  For every part and label, and for every set S of filters, the documents are summed
with sign (-1) ** |mask & S|.  These parity sums are the Walsh-Hadamard transform of the numbers of documents by mask, so the transform
again gives those numbers exactly, and from them follow all orders and the Shapley values: a document that fails k filters is removed by each of
them in one order of k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import tidy
from ._spark import load, ship

#: Orders are written out, so filters must be few.
MOST_FILTERS = 6
#: Parts whose orders are written out at once.
_PARTS = 50


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Failure conditions on a text; E is told by ``repeats``.
FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 50,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 65 * F.size(_words(t)),
    "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 5 * F.length(t),
    "D": lambda t: F.rlike(t, F.lit("[#$%&*|]")),
}
REPEATS = "E"


def failures(docs: DataFrame, filters: Mapping[str, Callable[[Column], Column]] = FILTERS, repeats: str | None = REPEATS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, k, known, mask, n): rows of one key, text and part together; bit i of the mask is the i-th filter, ``repeats`` the last.

    A row fails ``repeats`` if its text is that of a row with a smaller key.  A null text is empty, a null part too.  A row without a key (known
    is false) repeats nothing and is repeated by nothing; rows that share key and text fail alike.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.coalesce(F.unhex(F.sha2(t, 256)), F.lit(b""))  # never null, which the planner doesn't know
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(key).cast("long").alias("key"), digest.alias("digest"), t.alias("t"))
    mask = sum((F.when(fails(F.col("t")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    k = F.coalesce("key", F.xxhash64("digest"))  # rows without a key don't meet in one task
    rows = rows.select("part", k.alias("k"), F.col("key").isNotNull().alias("known"), "digest", mask.alias("mask"))
    cells = rows.groupBy("part", "k", "known", "digest", "mask").agg(F.count("*").alias("n"))
    if repeats is None:
        return cells.drop("digest")
    # the first row of a text is found by key and text, so a text that very many rows share is no hot key; both branches read one exchange
    first = cells.groupBy("digest").agg(F.min(F.when(F.col("known"), F.col("k"))).alias("k"), F.sum("n").alias("copies"))
    both = F.struct("digest", "k").alias("both")  # one key, else the planner may deal rows by the text alone
    told = cells.select("*", both).join(first.where("k IS NOT NULL").select(both, "copies"), "both", "left")
    again = F.when(F.col("known") & F.col("copies").isNull(), 1 << len(filters)).otherwise(0)
    return told.select("part", "k", "known", (F.col("mask") + again).alias("mask"), "n")


def parity_sums(cells: DataFrame, bits: int, labels: DataFrame | None = None, key: str = "doc_id", wanted: Mapping[str, Column] | None = None) -> DataFrame:
    """(part, all, <label>...): for each the 2 ** bits signed sums as an array; null where a part has no row of that label.

    A row has a label if one row of ``labels`` with its key meets the label's condition.
    """
    wanted = wanted or {}
    tags = [F.lit("all")]
    if labels is not None and wanted:
        met = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("k")).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in wanted.items()))
        cells = cells.join(met.withColumn("known", F.lit(True)), ["k", "known"], "left")
        tags += [F.when(F.col(name), F.lit(name)) for name in wanted]
    sums = cells.select("part", "mask", "n", F.explode(F.array_compact(F.array(*tags))).alias("label")).groupBy("part", "label").agg(
        *(F.sum(F.col("n") * (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2))).alias(f"w{s}") for s in range(1 << bits))
    )
    signed = F.array(*(F.col(f"w{s}") for s in range(1 << bits)))
    return sums.groupBy("part").agg(*(F.max(F.when(F.col("label") == name, signed)).alias(name) for name in ["all", *wanted]))  # a row each


def transform(bits: int) -> np.ndarray:
    """The Walsh-Hadamard matrix, its own inverse but for the factor 2 ** bits."""
    m = np.arange(1 << bits)
    return 1 - 2 * (np.bitwise_count(m[:, None] & m[None, :]).astype(np.int64) % 2)


def cells_of(sums: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of documents by mask, exactly, of rows of signed sums."""
    found, rest = np.divmod(sums @ transform(bits), 1 << bits)
    if rest.any() or (found < 0).any():
        raise ArithmeticError("these are no parity sums of counts")
    return found


def orders(sums: DataFrame, names: str, lost: Mapping[str, str]) -> DataFrame:
    """For every part, order and step: kept, removed, redundant, unique_fails, the labels removed (``lost``: column by label) and shapley."""
    bits = len(names)
    if bits > MOST_FILTERS:
        raise ValueError(f"{bits} filters have too many orders")
    m = np.arange(1 << bits)
    steps = []  # (order, step, filter, the filters before)
    for order in permutations(range(bits)):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(names[x] for x in order), i + 1, f, before))
            before |= 1 << f
    own, before = (np.array([s[i] for s in steps]) for i in (2, 3))
    fails, earlier = (m[:, None] >> own & 1) == 1, (m[:, None] & before) != 0
    removed = (fails & ~earlier).astype(np.int64)
    share = factorial(bits) // np.maximum(np.bitwise_count(m).astype(np.int64), 1)
    of = {
        "kept": (~fails & ~earlier).astype(np.int64), "removed": removed, "redundant": (fails & earlier).astype(np.int64),
        "unique_fails": (m[:, None] == 1 << own).astype(np.int64), "shapley": fails * share[:, None],
    }
    order, step = [s[0] for s in steps], np.array([s[1] for s in steps], np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), _PARTS):
                some = batch.iloc[a : a + _PARTS]
                zero = np.zeros(1 << bits, np.int64)
                counts = {c: cells_of(np.array([zero if w is None else w for w in some[c]], np.int64), bits) for c in ["all", *lost]}
                out = {"part": np.repeat(some["part"].to_numpy(), len(steps)), "filter_order": order * len(some), "step": np.tile(step, len(some))}
                out |= {c: (counts["all"] @ w).ravel() for c, w in of.items()} | {c: (counts[label] @ removed).ravel() for label, c in lost.items()}
                yield pd.DataFrame(out)

    ship(sums.sparkSession)
    longs = ", ".join(f"{c} long" for c in (*of, *lost.values()))
    return sums.mapInPandas(tidy(run), f"part string, filter_order string, step int, {longs}")


def audit(
    docs: DataFrame, labels: DataFrame | None = None, wanted: Mapping[str, tuple[Column, str]] | None = None, filters: Mapping[str, Callable[[Column], Column]] = FILTERS, repeats: str | None = REPEATS,
    key: str = "doc_id", text: str = "text", part: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step; ``wanted`` has a condition on ``labels`` and the column of what is lost of it by label.

    Null texts and parts are empty; rows without a key have no label and are no repeats; repeated rows count each.  Without documents there is no row.
    Filters have names of one letter.
    """
    wanted = wanted or {}
    names = "".join(filters) + (repeats or "")
    sums = parity_sums(failures(docs, filters, repeats, key, text, part), len(names), labels, key, {n: c for n, (c, _) in wanted.items()})
    return orders(sums, names, {n: c for n, (_, c) in wanted.items()})


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    wanted = {"good": (F.col("quality") == 1, "good_lost"), "toxic": (F.col("toxic") == 1, "toxic_lost")}
    out = audit(load(spark, folder, "documents"), load(spark, folder, "labels"), wanted)
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
b AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} AS f FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM b GROUP BY part, f),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [p.c, q.c, r.c, y.c, z.c] AS o FROM s p, s q, s r, s y, s z WHERE len(list_distinct([p.c, q.c, r.c, y.c, z.c])) = 5),
k AS (SELECT array_to_string(o, '') AS filter_order, unnest(range(1, 6)) AS step, o FROM o),
e AS (SELECT part, filter_order, step::INTEGER AS step, n, g, x,
  list_contains(fs, o[step]) AS fails, len(list_filter(o[1:step - 1], lambda c: list_contains(fs, c))) > 0 AS earlier, len(fs) AS many
  FROM (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: CASE c WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fs FROM m) q, k)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND many = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(many, 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM e GROUP BY part, filter_order, step
"""
