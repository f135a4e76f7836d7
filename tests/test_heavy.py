from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import heavy, linkpred


@pytest.mark.parametrize(("n", "alphabet", "capacity"), [(1, "abc", 2), (2, "abcdefghij", 20), (3, "ab李白\U0001f600", 40), (4, "ab\U0001f600李", 60), (4, "abc", 1 << 16), (2, [chr(0x4E00 + i) for i in range(300)], 30)])
def test_exact(spark, n, alphabet, capacity):
    rng = random.Random(n)
    weights = [1 / (i + 1) ** 1.5 for i in range(len(alphabet))]
    texts = ["".join(rng.choices(alphabet, weights, k=rng.choice([0, 1, 3, 40, 400]))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(5)
    counts = Counter(t[i : i + n] for t in texts if t for i in range(len(t) - n + 1))
    wanted = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]
    assert [(r["gram"], r["cnt"]) for r in heavy.top_ngrams(df, "c", n, 12, capacity).collect()] == wanted


def test_summary_is_bounded(spark):
    """Counts are never too high, and too low by no more than is told as lost; a task tells no more grams than it may hold."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", [1 / (i + 1) for i in range(26)], k=500)) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "c string").repartition(3)
    counts = Counter(t[i : i + 3] for t in texts for i in range(len(t) - 2))
    found = heavy._summary(df, "c", 3, 50).withColumn("task", F.spark_partition_id()).collect()
    lost = sum(r["lost"] for r in found)
    assert 0 < lost < 3 * 200 * 500 / 50 and max(Counter(r["task"] for r in found).values()) <= 51
    told = Counter()
    for r in found:
        if r["gram"]:
            told[r["gram"]] += r["cnt"]
    assert all(told[g] <= counts[g] <= told[g] + lost for g in counts)
    assert heavy.top_ngrams(df.limit(0), "c", 3, 5).count() == 0 and heavy.top_ngrams(df.limit(1), "c", 600, 5).count() == 0


def test_radial_kernel(spark):
    """Inner products are near the kernel, and a ring about a disc, which no line tells apart, is told."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(4)
    angle, near = rng.uniform(0, 2 * np.pi, 300), rng.uniform(0, 1, 300)
    label = (np.arange(300) % 2).astype(float)
    far = np.where(label == 1, 2 + near, near)
    x = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), y) for i, (v, y) in enumerate(zip(x, label.tolist(), strict=True))], "i long, a array<double>, label double").withColumn("features", array_to_vector("a"))
    seen = linkpred.radial_features(df, "features", "radial", 0.5, width=4096)
    z = np.array([r[0] for r in seen.orderBy("i").select(vector_to_array("radial")).collect()])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.1
    right = lambda c: (lambda t: t.where("prediction = label").count() / 300)(LinearSVC(featuresCol=c, maxIter=30, regParam=0.001).fit(seen).transform(seen))
    seen = linkpred.radial_features(df, "features", "radial", 0.5, width=128).cache()
    assert right("radial") > 0.97 > 0.75 > right("features")
