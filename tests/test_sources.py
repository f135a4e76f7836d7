from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog, ngrams, order, rankings
from corpusloom.plans import files  # noqa: F401  adds its queries
from corpusloom.plans.queries import QUERIES, SQL
from corpusloom.sources import readers, reports, writers

from .conftest import rows

RULE = "-" * 30


def volume(*poems, number=1):
    head = f"全唐詩 第{number}卷\n{'=' * 50}\n\n"
    return head + "".join(f"{i}. {t}\n   作者: {a}\n   內容:\n{c}\n{RULE}\n\n" for i, (t, a, c) in enumerate(poems, 1))


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_volumes(spark, tmp_path):
    write(tmp_path, "全唐詩_第007卷.txt", volume(("甲", "李白著", "一"), ("乙", "杜甫", "二\n內容: 三\n四"), ("丙", "", "五"), ("丁", "王維 作者: 孟", "𠮷　")))
    write(tmp_path, "全唐詩_第x.txt", volume(("子", "某", "a"), ("丑", "某", "b")) + "only\ntwo")
    write(tmp_path, "other.txt", volume(("寅", "某", "c"), ("卯", "某", "d")))
    found = readers.read_volumes(spark, str(tmp_path))
    assert rows(found.select("title", "volume", "content", "author")) == sorted([("2. 乙", 7, "二\n四\n", "杜甫"), ("4. 丁", 7, "𠮷\n", "王維"), ("2. 丑", 0, "b\n", "某")], key=repr)
    whole = readers.read_volumes(spark, str(tmp_path), drop_header_section=False)
    assert {r["title"] for r in whole.collect()} == {"1. 甲", "2. 乙", "4. 丁", "1. 子", "2. 丑"}
    names = readers.scan_authors(readers.volume_sections(spark, str(tmp_path)))
    assert ("李白著",) in rows(names) and ("內容:",) in rows(names)
    assert ("內容:",) not in rows(readers.scan_authors(readers.volume_sections(spark, str(tmp_path)), parity=False))


def test_volume_files_round_trip(spark, tmp_path):
    poems = spark.createDataFrame([(3, "t1", "a", "x\ny", 1), (3, "t2", "b", "z", 2), (4, "t3", None, "w", 1), (4, "t4", "c", None, 2)], "volume int, title string, author string, content string, seq int")
    writers.write_volumes(poems, str(tmp_path / "v"))
    back = readers.volume_folders(spark, str(tmp_path / "v"))
    assert rows(readers.parse_sections(back).select("title", "volume", "content")) == [("2. t2", 3, "z\n"), ("2. t4", 4, "無內容\n")]
    assert readers.parse_sections(back, drop_header_section=False).count() == 4
    whole = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "v/volume=3").glob("*.txt")))
    assert whole == volume(("t1", "a", "x\ny"), ("t2", "b", "z"), number=3)


def test_volume_queries_on_odd_texts(spark, tmp_path):
    """Blank texts, rules and marks within a text, and white space at its ends come back as SQL has them."""
    joiner = readers.JOINER
    texts = ["", None, " ", "\n\n", " lead\ntext ", "\n\nblank first", f"a\n{RULE}\nb", "-" * 95 + "\n" + "-" * 29, "-" * 29 + joiner + "-" + joiner + "-" * 40, "x\n   內容:\ny 內容: z\nq",
             "x 作者: y\n 作者: z\n", "tail　", "　head \nz \x0b", "crlf\r\nend\r\n", f"全唐詩 第1卷\n{'=' * 50}\n\nfoo", "tail \n\n\t"]
    docs = [(100 * k + i, t, lang, None if i == 5 else f"src{i % 5}") for k, lang in enumerate(("de", "en", "fr")) for i, t in enumerate(texts[k:] + texts[:k])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("volume_titles", "volume_roundtrip", "volume_roundtrip_whole"):
        found = QUERIES[name](spark, str(tmp_path))
        wanted = con.sql(SQL[name])
        assert rows(found) == sorted((tuple(r) for r in wanted.project(", ".join(found.columns)).fetchall()), key=repr), name


def test_large_volume(spark, tmp_path):
    """A volume of many splits, whose rules and characters lie on their borders, has the same poems as if read at once, in order."""
    poems = [(f"t{i}", f"作{i % 7}", "字é" * (i * 37 % 900) + f"\n{i}") for i in range(4000)]
    write(tmp_path, "全唐詩_第003卷.txt", volume(*poems, number=3))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("99991", "262147"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = readers.read_volumes(spark, str(tmp_path), drop_header_section=False)
        assert found.rdd.getNumPartitions() > 8
        got = [tuple(r) for r in found.orderBy("at").select("title", "author", "content").collect()]
        assert got == [(f"{i}. {t}", a, c + "\n") for i, (t, a, c) in enumerate(poems, 1)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("fan", [2, 512])
def test_volume_of_several_files(spark, tmp_path, monkeypatch, fan):
    """A volume with most of the poems is written by several tasks, numbered throughout."""
    monkeypatch.setattr(order, "FAN", fan)
    poems = [(1 if i % 10 else 2, f"t{i}", "a", f"c{i}", i) for i in range(900)]
    df = spark.createDataFrame(poems, "volume int, title string, author string, content string, seq int").repartition(5)
    writers.write_volumes(df, str(tmp_path / "v"), block=70)
    files = sorted((tmp_path / "v/volume=1").glob("*.txt"))
    assert len(files) > 4
    assert "".join(f.read_text(encoding="utf-8") for f in files) == volume(*((t, a, c) for v, t, a, c, _ in poems if v == 1), number=1)
    assert readers.parse_sections(readers.volume_folders(spark, str(tmp_path / "v"))).count() == 898


def test_names(spark, tmp_path):
    write(tmp_path, "names.txt", "全唐詩作者\n====\n總計 3\n\n   1. 李白\n   2. 杜甫\n   3. 一\n   4. 李白\n   5. 杜. 牧. 之\n")
    assert rows(readers.read_names(spark, str(tmp_path / "names.txt"))) == sorted([("李白",), ("杜甫",), ("杜. 牧. 之",)], key=repr)
    write(tmp_path, "names.py", "authors = [\n    '李白',\n    '杜甫',\n]")
    assert rows(readers.read_quoted_names(spark, str(tmp_path / "names.py"))) == sorted([("李白",), ("杜甫",)], key=repr)
    writers.write_names(spark.createDataFrame([("b",), ("a",), ("b",)], "author string"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out/txt")).collect()] == ["   1. a", "   2. b"]
    assert [r[0] for r in readers.read_quoted_names(spark, str(tmp_path / "out/py")).collect()] == ["a", "b"]


def test_json(spark, tmp_path):
    write(tmp_path, "corpus.json", json.dumps({"metadata": {}, "poems": [{"title": "t", "volume": 1, "content": "c", "author": "a"}]}))
    assert rows(readers.read_corpus(spark, str(tmp_path / "corpus.json"))) == [("t", 1, "c", "a")]
    folder = tmp_path / "volumes"
    folder.mkdir()
    write(folder, "全唐詩_第001卷.txt", volume(("甲", "x", "1"), ("乙", "y", "2")))
    assert readers.read_corpus(spark, str(tmp_path / "missing.json"), str(folder)).count() == 1
    graph = {"metadata": {}, "nodes": [{"id": "b", "weight": 3, "size": 5.6}, {"id": "a", "weight": 4, "size": 5.8}], "edges": [{"source": "b", "target": "a", "weight": 2}]}
    write(tmp_path, "graph.json", json.dumps(graph))
    nodes, edges = readers.read_graph(spark, str(tmp_path / "graph.json"))
    assert nodes.count() == 2 and rows(edges) == [("a", "b", 2)]
    writers.write_graph(nodes, edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"), str(tmp_path / "g"))
    again = readers.read_graph(spark, str(tmp_path / "g"))
    assert rows(again[1]) == rows(edges)
    assert readers.read_failures(spark, str(tmp_path / "none.json")).count() == 0
    failed = spark.createDataFrame([(3, "captcha", "d", "captcha")], "volume int, status string, description string, original_status string")
    writers.write_failures(failed, str(tmp_path / "failed"))
    assert rows(readers.read_failures(spark, str(tmp_path / "failed"))) == [(3, "captcha", "d", "captcha")]


def test_catalog(spark, tmp_path):
    write(tmp_path, "titles.json", json.dumps({"books": [{"title": "論語", "urn": "u1"}, {"title": "孟子", "urn": "u2"}]}))
    detail = {"author": "孔", "dynasty": {"from": {"name": "春秋"}}, "tags": ["x", "y"]}
    write(tmp_path, "details.json", json.dumps({"urn": "u1", "json": json.dumps(detail)}))
    books = readers.read_catalog(spark, str(tmp_path / "titles.json"), str(tmp_path / "details.json"))
    first = books.where("URN = 'u1'").first()
    assert (first["作者"], first["朝代_開始"], first["標籤"], first["版本"]) == ("孔", "春秋", "x, y", "")
    assert set(books.where("URN = 'u2'").first()[3:]) == {""}
    writers.write_csv(books, str(tmp_path / "csv"), bom=True)
    assert next((tmp_path / "csv").glob("part*")).read_bytes().startswith("﻿序號".encode())
    assert rows(catalog.distribution(books, "朝代_開始")) == [("春秋", 1)]


def test_lookup(spark):
    books = spark.createDataFrame([("论语",), ("論語注",), ("论语注",), ("Other",)], "title string")
    found = lambda name: rows(catalog.lookup(books, name).select("title", "tier"))
    assert found("论语") == [("论语", 1)]
    assert found("論語") == [("论语", 2)]
    assert found("語注") == [("論語注", 3)]
    assert found("OTHE") == [("Other", 3)]
    assert found("無") == []


def test_writers(spark, tmp_path):
    top = spark.createDataFrame([("a", 1, "x", 3, 1), ("a", 2, "xy", 2, 1)], "author string, n int, gram string, cnt long, rank int")
    writers.write_author_grams(top, str(tmp_path / "grams"))
    assert next((tmp_path / "grams/author=a/n=2").glob("*.csv")).read_text(encoding="utf-8") == "排名,詞彙,出現次數\n1,xy,2\n"
    ranking = spark.createDataFrame([("a", 5, 1)], "author string, docs long, rank int")
    writers.write_ranking(ranking, str(tmp_path / "rank"))
    assert spark.read.text(str(tmp_path / "rank/txt")).first()[0] == "   1. a: 5"
    md = writers.report(ranking, "Authors", F.format_string("%s: %d", "author", "docs"), "rank").first()[0]
    assert md == "# Authors\n\n- a: 5"
    books = spark.createDataFrame([("u", "T", None, "text")], "urn string, title string, author string, content string")
    assert books.select(writers.book_text(books, {"title": "書名", "author": "作者"})).first()[0] == "書名: T\n" + "=" * 50 + "\n\ntext"
    writers.write_books(books, str(tmp_path / "books"), "urn", {"title": "書名"})


@pytest.mark.parametrize("one_file", [True, False])
def test_corpus_object(spark, tmp_path, one_file):
    """It is valid JSON whatever is in it, and is read as it was written."""
    poems = [("t", 1, 'c "quoted"\n,{"title"', "a"), ("t", 1, 'c "quoted"\n,{"title"', "a"), ("u", 2, None, "b"), (None, 1, "d", None)]
    df = spark.createDataFrame(poems, "title string, volume int, content string, author string").repartition(3)
    reports.write_corpus(df, str(tmp_path / "corpus"), "now", one_file)
    files = sorted((tmp_path / "corpus").glob("part*"))
    found = json.loads("".join(f.read_text(encoding="utf-8") for f in files))
    assert sorted(map(repr, [(p["title"], p["volume"], p["content"], p["author"]) for p in found["poems"]])) == sorted(map(repr, poems))
    assert found["metadata"] == {"total_poems": 4, "total_authors": 2, "total_volumes": 2, "generated_at": "now"}
    assert found["authors"] == {"statistics": {"total_authors": 2, "avg_poems_per_author": 1.5, "single_poem_authors": 1}, "top_authors": {"a": 2, "b": 1}}
    assert found["volumes"] == {"statistics": {"total_volumes": 2, "avg_poems_per_volume": 2.0}, "volume_poem_counts": {"1": 3, "2": 1}}
    assert rows(readers.read_corpus(spark, str(tmp_path / "corpus"))) == sorted(poems, key=repr)
    reports.write_corpus(df.limit(0), str(tmp_path / "none"), "now", one_file)
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part*"))))["poems"] == []
    (tmp_path / "other.json").write_text('{"x": 1}')
    with pytest.raises(ValueError, match="no poems"):
        readers.read_corpus(spark, str(tmp_path / "other.json"))


def test_details_object(spark, tmp_path):
    df = spark.createDataFrame([("李 \"白\"", 1, "abab"), ("b", 2, "abc")], "author string, id int, t string")
    details = reports.author_details(rankings.author_counts(df, "author"), ngrams.joined_ngram_counts(df, "author", "id", "t"), k=1)
    reports.write_object(reports.detail_lines(details, "now"), str(tmp_path / "d"))
    found = json.loads("".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "d").glob("part*"))))
    assert found["metadata"] == {"total_authors": 2, "total_poems": 2, "generated_at": "now", "note": reports.DETAILS_NOTE}
    assert found["author_statistics"]["李 \"白\""] == {"poem_count": 1, "ngram_counts": {
        "1gram": {"unique_count": 2, "total_count": 4, "top_ngrams": [{"ngram": "a", "count": 2}]}, "2gram": {"unique_count": 2, "total_count": 3, "top_ngrams": [{"ngram": "ab", "count": 2}]},
        "4gram": {"unique_count": 1, "total_count": 1, "top_ngrams": [{"ngram": "abab", "count": 1}]}}}


def test_table_writers(spark, tmp_path):
    stats = spark.createDataFrame([(1, "李白", 5, 2)], "rank int, person string, mentions long, degree long")
    writers.write_person_stats(stats, str(tmp_path / "stats"))
    assert next((tmp_path / "stats").glob("part*")).read_text(encoding="utf-8") == "排名,人物,提及次數,相關詩歌數,關聯人物數\n1,李白,5,5,2\n"
    poems = spark.createDataFrame([("a_t", "a", "t", "李白", 5)], "poem string, author string, title string, person string, mentions long")
    writers.write_person_poems(poems, str(tmp_path / "poems"))
    assert next((tmp_path / "poems").glob("part*")).read_text(encoding="utf-8").startswith("詩歌ID,作者,標題,人物,提及次數\n")
    grams = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "ab", 1)], "n int, gram string, cnt long")
    writers.write_grams(grams, str(tmp_path / "grams"), 1)
    assert [r[0] for r in spark.read.text(str(tmp_path / "grams/txt")).collect()] == ["1-gram    1. a: 3", "2-gram    1. ab: 1"]
    assert spark.read.json(str(tmp_path / "grams/totals")).count() == 2
    writers.write_crawl_summary(spark.createDataFrame([("success", 3)], "outcome string, n long"), str(tmp_path / "crawl"))
    assert spark.read.json(str(tmp_path / "crawl")).first()["n"] == 3


def test_grams_are_counted_once(spark, tmp_path):
    """The three files of the grams come from one count."""
    from corpusloom.sources import writers

    made = spark.sparkContext.accumulator(0)
    given = [("ab", 3, 2), ("b", 5, 1), ("a", 4, 1)]

    def seen(r):
        made.add(1)
        return r

    counts = spark.createDataFrame(spark.sparkContext.parallelize(given, 1).map(seen), "gram string, cnt long, n int")
    writers.write_grams(counts, str(tmp_path / "grams"))
    assert made.value == len(given)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "grams/txt")).collect()] == ["1-gram    1. b: 5", "1-gram    2. a: 4", "2-gram    1. ab: 3"]
    assert spark.read.json(str(tmp_path / "grams/json")).count() == 3


def test_pages_as_lines(spark, tmp_path):
    """Many pages in few files, and whole: the same as from a file for each."""
    odd = ["<p>a</p>", None, "", "a\r\nb\n\nc\r", '{"html": "x"}\\ \u2028 \x00 \t 😀', "x" * 300_000]
    pages = spark.createDataFrame([(i, odd[i % 6]) for i in range(60)], "page_id long, html string").repartition(2)
    writers.write_page_lines(pages, str(tmp_path / "lines"), "page_id")
    assert len(list((tmp_path / "lines").rglob("part*"))) <= 2
    found = {r["page_id"]: r["html"] for r in readers.read_page_lines(spark, str(tmp_path / "lines"), "page_id").collect()}
    assert found == {i: (odd[i % 6] or "") + "\n" for i in range(60)}
    writers.write_pages(pages.where("page_id < 12"), str(tmp_path / "each"), "page_id")
    assert {r["page_id"]: r["html"] for r in readers.read_pages(spark, str(tmp_path / "each")).collect()} == {i: found[i] for i in range(12)}


def test_object_is_dealt_by_its_bytes(spark, tmp_path, monkeypatch):
    """A task's share of an object doesn't grow with it, and the lines stay in order."""
    from corpusloom.operators import order

    monkeypatch.setattr(order, "TASK_BYTES", 4096)
    df = spark.range(1000).selectExpr("'t' AS title", "CAST(id % 3 AS INT) AS volume", "repeat('x', 100) AS content", "concat('a', id) AS author")
    reports.write_corpus(df, str(tmp_path / "corpus"), "now")
    files = sorted((tmp_path / "corpus").glob("part*"))
    assert len(files) > 20 and max(f.stat().st_size for f in files) < 5 * 4096
    found = json.loads("".join(f.read_text(encoding="utf-8") for f in files))
    assert len(found["poems"]) == 1000 and {p["author"] for p in found["poems"]} == {f"a{i}" for i in range(1000)}
    assert [p["volume"] for p in found["poems"]] == sorted(p["volume"] for p in found["poems"])


def test_corpus_file_is_scanned_once_for_totals(spark):
    """No task reads a pair of the file's parts."""
    from corpusloom.plans import files

    df = files.corpus_file_totals(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("FileScan text") == 1
