"""The pipeline and the registry of this package."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpusloom.llm.queries import QUERIES, SQL

from ..conftest import DATA
from ..test_queries import TABLES, values

SMALL = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    wanted, found = con.sql(SQL[name]).df(), QUERIES[name](spark, SMALL).toPandas()
    assert sorted(found.columns) == sorted(wanted.columns) and values(found) == values(wanted)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash", "suffix_dedup", "decontaminate", "mixing"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "12 34 !!", None, "x", 8), (10**6 + 1, None, None, None, None)], docs.schema)
    columns, before = docs.columns, docs.unionByName(junk)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SMALL)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == columns
        assert 0 < out.count() <= before.count()
        if name == "language_id":
            assert out.where("doc_id >= 1000000").count() == 0 and out.count() >= docs.count() * 0.99
        before = out
    assert out.where("rate > 0").count() == out.count()


def test_run_scores_each_document_once(spark, monkeypatch, tmp_path):
    """What a stage keeps is written, so that later stages don't work it out again."""
    scored = spark.sparkContext.accumulator(0)
    identify = corpus_pipeline.language_id.identify

    def counted(docs, *args, **names):
        def tick(batches):
            for b in batches:
                scored.add(b.num_rows)
                yield b

        return identify(docs.mapInArrow(tick, docs.schema), *args, **names)

    monkeypatch.setattr(corpus_pipeline.language_id, "identify", counted)
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert scored.value == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert len(out) == len({r["doc_id"] for r in out}) > 0


def test_stages_keep_rows_of_one_id(spark):
    """Rows that share an id are judged by their own texts; very long ones and columns with other operators' names pass."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(3).select("text").collect()
    long = " ".join(f"{t}{i}" for i in range(3000) for t in ("alpha", "beta"))
    rows = [(1, docs[0]["text"], "en"), (1, docs[1]["text"], "en"), (1, long, "en"), (2, docs[0]["text"] + " x", "en"), (2, "Zürich � ist eine Stadt " * 9, "de"), (None, docs[2]["text"], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: corpus_pipeline.F.lit("v") for c in ("row", "id", "dup", "component", "spans", "score", "kept", "k1", "w")})
    near = corpus_pipeline.drop_near_duplicates(spark, df, SMALL)
    assert near.columns == df.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in near.collect()) == sorted((k or 0, t) for k, t, _ in rows if t != rows[3][1])
    cut = corpus_pipeline.cut_repeated_strings(spark, near, SMALL)
    assert cut.columns == df.columns and cut.count() == 5
    kept = next(r["text"] for r in cut.collect() if r["doc_id"] == 2)
    assert "�" in kept and kept.startswith("Zürich � ist") and len(kept) < len(rows[4][1])
    clean = corpus_pipeline.decontaminated(spark, cut, SMALL)
    assert clean.columns == df.columns and clean.count() >= 4


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
