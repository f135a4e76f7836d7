from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ngrams, rankings
from corpusloom.operators.order import numbered

from .conftest import rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers(spark):
    rng = random.Random(8)
    some = [(f"n{i:05}", rng.choice([1, 1, 1, 2, 3, None])) for i in range(4000)]
    df = spark.createDataFrame(some, "name string, n int").repartition(7).withColumn("__x", F.lit(1))
    found = rankings.ranked(df, "n", "name")
    wanted = sorted(some, key=lambda r: (-(r[1] or 0), r[0]))
    assert [(r["name"], r["rank"]) for r in found.orderBy("rank").collect()] == [(r[0], i) for i, r in enumerate(wanted, 1)]
    assert "Window" not in plan(found)
    groups = numbered(df, F.desc("name"), into="k", group=["n"])
    got = {(r["n"], r["name"]): r["k"] for r in groups.collect()}
    for n in (1, 2, 3, None):
        names = sorted((a for a, b in some if b == n), reverse=True)
        assert [got[n, a] for a in names] == list(range(1, len(names) + 1))
    assert numbered(df.limit(0), "name").count() == 0 and numbered(df.limit(0), "name", group=["n"]).count() == 0


def test_shares(spark):
    counts = spark.createDataFrame([(f"a{i}", i) for i in range(1, 41)], "author string, docs long")
    assert rows(rankings.top_shares(counts, (1, 3, 100))) == [(1, 40, round(4000 / 820, 6)), (100, 820, 100.0), (3, 117, round(11700 / 820, 6))]
    assert "Window" not in plan(rankings.top_shares(counts, (1, 3)))
    assert rows(rankings.top_shares(counts.limit(0), (2,))) == [(2, None, None)]


@pytest.mark.parametrize("run", [3, 4, 50, 100_000])
def test_grams_of_one_author(spark, run, monkeypatch):
    """One author with very many short texts, some of one character, and others; carried over every border of runs and partitions."""
    rng = random.Random(run)
    texts = [(("one" if i % 9 else rng.choice("xyz")), i, "".join(rng.choices("abc", k=rng.choice([0, 1, 1, 2, 7])))) for i in range(600)] + [(None, 1, "ab"), (None, 2, "a")]
    df = spark.createDataFrame(texts, "author string, k int, c string").repartition(5)
    monkeypatch.setattr(ngrams.carried, "__defaults__", (run,))
    got = {(r["author"], r["gram"]): r["cnt"] for r in ngrams.joined_ngram_counts(df, "author", "k", "c").collect()}
    wanted = Counter()
    for author in {a for a, _, _ in texts}:
        whole = "".join(c for a, _, c in sorted(texts, key=lambda r: r[1]) if a == author)
        for n in (1, 2, 4):
            wanted.update((author, whole[i : i + n]) for i in range(len(whole) - n + 1))
    assert got == wanted
