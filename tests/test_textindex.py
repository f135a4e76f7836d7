from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, textindex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    words = ["license", "Licence", "a", "李白", "白居易", "x%y", "under_score", "\U0001f600b", "ß", "lice", "nse", "I", "zz\nq"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 60]))) for _ in range(900)]
    rows = [(i, rng.choice(["ann", "Bo", None]), t if i % 50 else None, i % 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, author string, text string, volume int").repartition(6)


@pytest.mark.parametrize("query", ["LICENSE", "e lic", "白", "李白 白", "%y", "_", "\U0001f600", "nn", "q", "zz\nq", "absent", "license license lice", "ß", "白居易 a x%y"])
def test_same_rows_as_a_scan(spark, docs, index, query):
    columns = ("author", "text")
    wanted = sorted(r["doc_id"] for r in search.search(docs, query, columns, 100_000).collect())
    assert sorted(r["doc_id"] for r in index.search_all(spark, query).collect()) == wanted
    assert sorted(r["doc_id"] for r in index.search(spark, query, 100_000).collect()) == wanted
    for limit in (0, 3):
        assert sorted(r["doc_id"] for r in index.search(spark, query, limit).collect()) == wanted[: max(limit, 1)]
    assert index.search(spark, query).columns == ["doc_id", "author", "text", "volume"]


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return textindex.write_index(docs, str(tmp_path_factory.mktemp("index")), ("author", "text"))


def test_reads_only_its_lists(spark, index):
    lists = index.candidates(spark, "license")
    text = plan(lists)
    assert "BatchScan" not in text and re.search(r"PartitionFilters: \[.*folder", text) and re.search(r"PushedFilters: \[.*In\(gram", text)
    found = index.search(spark, "license lice", 1)
    assert re.search(r"PartitionFilters: \[.*block.* IN \(\d+\)|PartitionFilters: \[.*block#\d+ = \d+", plan(found)) and "PushedFilters: [In(doc_id" in plan(found).replace("EqualTo(doc_id", "In(doc_id").replace("IsNotNull(doc_id), ", "")
    assert "dynamicpruning" in plan(index.search_all(spark, "license"))
    assert index.candidates(spark, "qqqq").isEmpty()
    with pytest.raises(ValueError):
        index.search(spark, "")


def test_laid_out(spark, docs, tmp_path):
    textindex.write_laid_out(docs, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    found = search.by_volume(table, 3, limit=1000)
    assert re.search(r"PartitionFilters: \[.*volume", plan(found))
    assert {r["doc_id"] % 5 for r in found.collect()} == {3} and found.count() == 180
    some = docs.where("doc_id in (1, 6, 2)").select("volume")
    joined = textindex.rows_of_values(table, some)
    assert "dynamicpruning" in plan(joined)
    assert {r["doc_id"] % 5 for r in joined.collect()} == {1, 2} and joined.count() == 360
    many = spark.createDataFrame([(i, 1) for i in range(3000)], "doc_id long, volume int")
    textindex.write_laid_out(many.withColumn("x", F.lit(0)), str(tmp_path / "hot"))
    assert len(list((tmp_path / "hot/volume=1").glob("*.parquet"))) > 4
