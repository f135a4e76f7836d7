"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, embedding_dedup, language_id, minhash, mixing, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter

LONG = " ".join(f"word{i % 977} thing" for i in range(120_000))
ROWS = [
    (1, "the cat sat on the mat and the dog sat on the cat", "en"), (1, "the cat sat on the mat and the dog sat on the cat", "en"), (2, "", "en"), (3, None, "en"),
    (None, "le chat est sur la table avec un chien", "fr"), (4, "le chat est sur la table avec un chien", None), (5, LONG, "en"), (6, LONG + " end", "en"), (7, "   \n\t ", None), (8, "!!! ??? 123", "fr"), (9, "é" * 400, "fr"),
]
CLASH = ("id", "row", "k", "n", "spans", "kind", "words", "rate", "score", "lang_pred", "held_out", "p", "tokens", "component", "group", "norm", "w")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH)).persist()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "The cat sat"), (2, None), (None, "on the mat"), (3, ""), (1, "The cat sat")], "item_id long, text string")


def ids(df, key="doc_id"):
    return sorted((r[0] is None, r[0] or 0) for r in df.select(key).collect())


ALL = sorted((r[0] is None, r[0] or 0) for r in ROWS)


def operators(spark, items):
    def labelled(docs):
        return docs.select("doc_id", "text", F.when(F.col("lang") == "en", "good").otherwise("plain").alias("domain"))

    return {
        "tokens": (lambda d: token_counts.count_tokens(d, token_counts.default_model()), ALL),
        "languages": (lambda d: language_id.identify(d, language_id.fit(d)), ALL),
        "substrings": (substring_dedup.deduplicated, ALL),
        "strings": (suffix_dedup.deduplicated, ALL),
        "minhash": (minhash.near_duplicates, ALL),
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d.withColumn("toxic", (F.col("lang") == "fr").cast("int")))), ALL),
        "mixing": (lambda d: mixing.mix(d, labelled(d)), ALL),
        "hits": (lambda d: decontaminate.find_hits(d, items), ALL),
    }


@pytest.mark.parametrize("name", ["tokens", "languages", "substrings", "strings", "minhash", "toxicity", "mixing", "hits"])
def test_documents(spark, docs, items, name):
    run, wanted = operators(spark, items)[name]
    out = run(docs)
    assert ids(out) == wanted
    assert run(docs.limit(0)).count() == 0
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert ids(run(none)) == wanted


def test_columns_pass(spark, docs, items):
    for out in (
        token_counts.count_tokens(docs, token_counts.default_model(), into="n"), language_id.identify(docs, language_id.fit(docs)), decontaminate.decontaminate(docs, items),
        toxicity.score(docs, toxicity.fit_texts([], [])), mixing.mix(docs, docs.withColumn("domain", F.lit("good"))),
    ):
        assert set(docs.columns) <= set(out.columns)
        assert len(out.columns) == len(set(out.columns))


def test_results(spark, docs, items):
    tokens = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, token_counts.default_model()).collect()}
    assert tokens[2] == tokens[3] == 0 and tokens[5] > 200_000
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert all(langs[k] == ("und", 0.0) for k in (2, 3, 7, 8))
    near = {r["doc_id"]: tuple(r)[2:] for r in minhash.near_duplicates(docs).collect()}
    assert near[5][1:] == (5, True) and near[6][1:] == (5, False) and near[2] == (0, 2, True) and near[None][1] is None and near[4][1] == 4
    words = {r["doc_id"]: r for r in substring_dedup.deduplicated(docs).collect()}
    assert words[5]["n_removed"] == words[5]["n_words"] == 240_000 and words[6]["n_words"] - words[6]["n_removed"] == 1 and bytes(words[6]["kept"]) == b"end"
    assert bytes(words[None]["kept"]).decode() == ROWS[4][1] and words[2]["n_words"] == words[3]["n_words"] == words[7]["n_words"] == 0
    cut = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert cut[6]["n_removed"] >= len(LONG) - 1 and cut[1]["n_removed"] == 0 and cut[None]["n_removed"] == 0
    assert cut[9]["n_removed"] == 800 - 2  # its first window of 100 bytes comes again two bytes on
    hits = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.find_hits(docs, items)).collect()}
    assert hits[1]["items"] == ["1"] and hits[1]["contaminated"] and hits[5]["n_hit"] == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Net/x?y"), (5, "http://net/" + "a" * 100_000), (5, "http://net/"), (None, "://h#f")], "page_id long, url string")
    pages = pages.select("*", *(F.lit("x").alias(c) for c in ("host", "path", "rule", "verdict", "score")))
    out = url_filter.filter_urls(pages)
    got = sorted(((r["page_id"] or 0, r["host"], r["path"][:3], r["rule"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, "", "", None), (2, "", "", None), (3, "", "", None), (4, "a.net", "/x", "net/"), (5, "net", "/aa", "net/"), (5, "net", "/", "net/"), (0, "h", "", None)], key=repr)
    assert len(out.columns) == 7 and url_filter.filter_urls(pages.limit(0)).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (7, [None, 1.0]), (1, [1.0, 0.0]), (8, [1e300, 1e298]), (9, [inf, 1.0]), (10, [0.0, 2.0]), (11, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("pivot", F.lit(1))
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df).collect()}
    alone = {k: (0, k, True) for k in (3, 4, 5, 7, 9, 10)} | {6: (1, 6, True), 11: (1, 6, False)}
    assert got == alone | {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False), None: (0, None, True)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id = 4")).count() == 1


def twisted(n):
    """Two texts whose difference divides every power of two times any odd polynomial's step: sums modulo 2**64 can't tell them apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11, 13])
def test_twisted_words(spark, n):
    a, b = twisted(n)
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {tuple(r)[3:] for r in minhash.near_duplicates(df).collect()} == {(1, True), (2, True)}
    rest = " " + " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, a + rest), (2, b + rest)], "doc_id long, text string")
    assert [r["n_removed"] for r in substring_dedup.deduplicated(df).collect()] == [0, 0]


def test_twisted_sequences(spark):
    a, b = twisted(5)
    rows = [(1, " ".join(a) + " end of it"), (2, " ".join(b) + " end of it"), (3, a * 4 + b * 4), (4, b * 4 + a * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(df).collect()}
    assert got == {k: v[:2] for k, v in substring_dedup.brute_force(rows).items()}
    got = {r["doc_id"]: tuple(r)[2:5] for r in suffix_dedup.deduplicated(df).collect()}
    assert got == {k: v[:3] for k, v in suffix_dedup.brute_force(rows).items()}


def test_rows_of_one_id(spark):
    """They are documents of their own: nothing of them is lost, and they are compared with each other."""
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(1, "alph1 " + long), (1, "beta2 " + long), (1, "beta2 " + long), (1, "gamma"), (2, "delt3 " + long), (2, "delt3"), (3, None), (3, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substring_dedup.deduplicated(df).collect())
    assert got == sorted([(1, 61, 60, "alph1"), (1, 61, 61, ""), (1, 61, 61, ""), (1, 1, 0, "gamma"), (2, 61, 60, "delt3"), (2, 1, 0, "delt3"), (3, 0, 0, ""), (3, 0, 0, "")])
    got = sorted((r["row"], bytes(r["kept"]).decode()) for r in suffix_dedup.deduplicated(df, keep=["row"]).collect())
    assert got == [(0, rows[0][1]), (1, "beta2"), (2, ""), (3, "gamma"), (4, "delt3"), (5, "delt3"), (6, ""), (7, "")]


def test_letters():
    scorer = language_id.Scorer({"langs": ["a", "b"], "words": {}, "grams": {}, "word_logs": None, "gram_logs": np.zeros((0, 2))})
    for c in map(chr, range(0x30000)):
        assert (scorer.score(c)[0] != "und") == any(unicodedata.category(x)[0] == "L" for x in c.lower()), c
    assert scorer.score("½ ² ① Ⅷ") == ("und", 0.0)


def test_ties(spark):
    """Of languages that are as likely the first by name is told; equal vectors are all linked."""
    model = {"langs": ["b", "c"], "words": {"x": 0}, "grams": {}, "word_logs": np.array([[-1.0, -1.0]]), "gram_logs": np.zeros((0, 2))}
    assert language_id.Scorer(model).score("x") == ("b", 0.5)
    df = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(40, 0, -1)], "vec_id long, embedding array<double>")
    assert {tuple(r)[1:3] for r in embedding_dedup.near_duplicates(df).collect()} == {(39, 1)}
