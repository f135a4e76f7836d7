"""Recall of the embedding index on tables of few, tight clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import embedding_dedup


def clusters(n, sizes, spread, seed=7):
    """``n`` vectors of 64 dimensions: clusters of these sizes about random directions, the rest on its own."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    at = 0
    for size in sizes:
        base = x[at].copy()
        x[at : at + size] = base + spread * rng.standard_normal((size, 64))
        at += size
    return x


@pytest.mark.parametrize(
    ("n", "sizes", "spread"), [(4000, [4000], 0.02), (4000, [4000], 0.04), (8000, [8000], 0.04), (4000, [3900], 0.04), (8100, [2700] * 3, 0.03), (6000, [30] * 200, 0.03), (3000, [900, 300, 20], 0.035)]
)
def test_recall(spark, n, sizes, spread):
    x = clusters(n, sizes, spread)
    ids, vectors = pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * 64 + 1, 64), pa.int32()), pa.array(x.ravel()))
    df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": vectors}))
    got = embedding_dedup.near_duplicates(df).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = sum(((unit[a : a + 1000] @ unit.T) >= 0.9).sum(axis=1).sum() for a in range(0, n, 1000)) - n
    assert links > n
    found = got["n_links"].sum()
    assert 0.95 * links <= found <= links, found / links
