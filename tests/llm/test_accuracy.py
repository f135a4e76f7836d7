"""Learned operators on whole tables, against their labels and against plain versions of what they compute."""

from __future__ import annotations

import math
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language_id, mixing, toxicity

from ..conftest import DATA

SMALL = str(DATA / "sf0.01")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def area(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    positive = label == 1
    return (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_toxicity_query(spark):
    """Every document has a score; on held-out labels it ranks and decides well."""
    rows = toxicity.op6_toxicity(spark, SMALL).toPandas()
    docs = documents(spark).toPandas()
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    assert (rows.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows.doc_id]).all()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert len(held) > 40 and area(held.score.to_numpy(), held.toxic.to_numpy()) > 0.9
    assert (held.predicted == held.toxic).mean() > 0.9


def plain_score(model, text):
    """Words first, then the longest n-grams that are known, one text at a time."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return "und", 0.0
    total = [0.0] * len(model["langs"])
    for w in words:
        if w in model["words"]:
            add = model["word_logs"][model["words"][w]]
        else:
            add = [0.0] * len(total)
            for order in language_id.ORDERS:
                marked = f"^{w}$"
                found = [model["grams"][g] for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) in model["grams"]]
                if found:
                    add = [sum(float(model["gram_logs"][g][k]) for g in found) / len(found) * order / max(language_id.ORDERS) for k in range(len(total))]
                    break
        total = [t + float(a) for t, a in zip(total, add, strict=True)]
    best = max(range(len(total)), key=lambda k: total[k])
    return model["langs"][best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_language_query(spark):
    """Every prediction and score of the whole table is that of the plain version."""
    docs = documents(spark)
    model = language_id.fit(docs.where(~language_id.held_out("doc_id", 3, 1)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = language_id.op9_language_id(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = plain_score(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_mixing_query(spark):
    """The rates of the whole table are the nearest to one that meet the targets: no others with the same token totals are nearer."""
    rows = mixing.op1_mixing(spark, SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert sorted(rows.doc_id) == sorted(texts)
    assert (rows.n_tokens == [len((texts[k] or "").encode().split()) for k in rows.doc_id]).all()
    names = sorted(mixing.TARGETS)
    p, n, rate = rows[[f"p_{d}" for d in names]].to_numpy(), rows.n_tokens.to_numpy(float), rows.rate.to_numpy()
    target = np.array([mixing.TARGETS[d] for d in names])
    assert p.sum(axis=1) == pytest.approx(np.ones(len(p)), abs=1e-6)
    assert (n * rate) @ p / n.sum() == pytest.approx(target, rel=1e-4)
    # projected gradient steps with a state for each document, in numpy, end at the same rates
    weight = n / n.sum()
    gram = (p * weight[:, None]).T @ p
    length = 1 / np.linalg.eigvalsh(gram)[-1]
    total = np.zeros(len(names))
    for _ in range(200_000):
        r = np.maximum(0, 1 + p @ total)
        miss = target - (weight * r) @ p
        if np.abs(miss).max() < 1e-9:
            break
        total += length * miss
    some = n > 0
    assert rate[some] == pytest.approx(r[some], abs=2e-3)
    assert rows.where(rows.n_tokens == 0).dropna().rate.eq(1).all()


def test_fits_ignore_what_they_must(spark):
    """Held-out labels change nothing in the models."""
    docs = documents(spark)
    other = docs.withColumn("lang", F.when(language_id.held_out("doc_id", 3, 1), F.lit("xx")).otherwise(F.col("lang")))
    first, second = (language_id.fit(d.where(~language_id.held_out("doc_id", 3, 1))) for d in (docs, other))
    assert first["langs"] == second["langs"] and first["words"] == second["words"] and np.array_equal(first["gram_logs"], second["gram_logs"])
