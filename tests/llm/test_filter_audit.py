"""The filter audit against plain counting, in every order."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import filter_audit

LONG = " ".join(f"w{i % 700}" for i in range(200_000))
GOOD = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, GOOD, "a"), (2, GOOD, "b"), (2, GOOD, "b"), (3, GOOD + " $", "a"), (3, GOOD + " $", "b"), (4, None, None), (5, "", ""), (6, LONG, "a"), (7, LONG, "c"), (None, GOOD, "a"), (None, None, "a"), (None, "ABC", None),
    (8, "WORD " * 60, "c"), (9, "é " * 60, "c"), (10, "ÀÉÎ" * 20 + " A", "c"), (1, "other", "a"), (11, GOOD.replace(" ", "\x0b\t"), "a"), (12, "\x1c".join(f"x{i}" for i in range(60)), "d"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (6, 1, None), (8, 1, 1), (99, 1, 1)]


def brute_force(rows, labels):
    """Each order applied to each row in turn."""
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    failed = []
    for k, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": k is not None and any(o is not None and o < k and (x or "") == t for o, x, _ in rows),
        }
        failed.append((part or "", {c for c in fails if fails[c]}, k in good, k in toxic))
    out, shapley = Counter(), Counter()
    for order in map("".join, permutations("ABCDE")):
        for part, fails, is_good, is_toxic in failed:
            done = False
            for step, c in enumerate(order, 1):
                at = (part, order, step)
                removed = c in fails and not done
                for name, hit in (("kept", not done and c not in fails), ("removed", removed), ("redundant", done and c in fails), ("unique_fails", fails == {c}), ("good_lost", removed and is_good), ("toxic_lost", removed and is_toxic)):
                    out[at, name] += hit
                shapley[part, c] += removed
                done = done or removed
    return out, shapley


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("part", F.lit("x")).withColumn("n", F.lit(3)).withColumn("mask", F.lit(1)).repartition(4)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")).withColumn("good", F.lit(True))
    out, shapley = brute_force(ROWS, LABELS)
    wanted = {"good": (F.col("quality") == 1, "good_lost"), "toxic": (F.col("toxic") == 1, "toxic_lost")}
    found = filter_audit.audit(docs, labels, wanted).collect()
    assert len(found) == 600 * 5 == len({(r["part"], r["filter_order"], r["step"]) for r in found})
    for r in found:
        at = r["part"], r["filter_order"], r["step"]
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == out[at, c], (at, c)
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]


def test_empty_and_fewer_filters(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert filter_audit.audit(docs.limit(0)).count() == 0
    out = filter_audit.audit(docs, filters={"A": filter_audit.FILTERS["A"]}, repeats=None)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"]
    assert {(r["part"], r["kept"], r["removed"]) for r in out.collect()} >= {("", 0, 3), ("c", 3, 1)}
    with pytest.raises(ValueError):
        filter_audit.orders(out, "ABCDEFG", {})


def test_transform():
    h = filter_audit.transform(5)
    assert (h @ h == 32 * np.eye(32)).all()
    counts = np.random.default_rng(1).integers(0, 1 << 40, (7, 32))
    assert (filter_audit.cells_of(counts @ h, 5) == counts).all()
    with pytest.raises(ArithmeticError):
        filter_audit.cells_of(np.arange(32)[None, :], 5)
