from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import crawl, hierarchy, html, rankings, search
from corpusloom.session import Scratch

from .conftest import rows

HEAD = "<table width='100%'><tr><td><h2>《<a href='x'>{0}</a>》</h2><span class=\"etext opt\"><b> {1}</b></span></td></tr></table>"
BODY = '<table border="0"><tr><td class="ctext"><div id="comm1"></div>{0}<p class="ctext"></p></td></tr></table>'


def test_positional(spark):
    page = "<script>var t='</table>';</script>" + HEAD.format("甲", "李白著") + BODY.format("一") + HEAD.format("乙", "杜甫") + HEAD.format("丙", "王維") + BODY.format("三")
    df = spark.createDataFrame([(1, page), (2, ""), (3, None)], "k long, p string")
    # the missing block of the second poem shifts the third one's text
    assert rows(html.positional(df, "k", "p").select("k", "pos", "title", "author", "content")) == sorted([(1, 0, "甲", "李白", "一"), (1, 1, "乙", "杜甫", "三")], key=repr)


def test_tree(spark):
    page = HEAD.format("甲", "李白") + BODY.format("一 &amp; 二") + HEAD.format("乙", "電子圖書館") + BODY.format("x") + HEAD.format("丙", "杜甫") + BODY.format("打開字典")
    bare = "<table><tr><td><h2>《丁》</h2></td></tr></table>" + BODY.format("四") + "<h2>《no table》</h2>"
    listed = "<table><tr><td><a>A</a><a>B</a></td><td>text</td></tr><tr><td>only</td></tr></table>"
    links = "<p><a href='/v/1'>title</a> and more</p><i><a href='/v/2'>alone</a></i>"
    df = spark.createDataFrame([(1, page), (2, bare), (3, None), (4, "<td></table><<")], "k long, p string")
    assert rows(html.extract(df, "k", "p")) == sorted([(1, 0, "甲", "李白", "一 & 二"), (2, 0, "丁", "佚名", "四")], key=repr)
    df = spark.createDataFrame([(1, listed), (2, links)], "k long, p string")
    assert rows(html.extract(df, "k", "p", "rows", link="/v/")) == sorted([(1, 0, "A", "B", "text"), (2, 0, "title", "未知作者", "title and more")], key=repr)


def test_status(spark):
    df = spark.createDataFrame(
        [(1, "詩", 2, 200, None), (2, "詩", 0, 200, None), (3, "x", 1, 200, None), (4, "詩 CAPTCHA", 1, 200, None), (5, "詩", 1, 403, None), (6, None, 0, 200, "timeout")],
        "k long, p string, n long, http int, error string",
    )
    status = html.page_status(F.col("p"), F.col("n"), F.col("http"), F.col("error"))
    assert [r[0] for r in df.orderBy("k").select(status).collect()] == ["success", "no_poems_found", "invalid_page", "captcha", "http_error_403", "timeout"]


def test_crawl(spark):
    log = spark.createDataFrame([(1, "success"), (2, "captcha"), (3, "http_error_403"), (4, "timeout"), (5, "timeout")], "v long, s string")
    assert dict(rows(crawl.status_summary(log, "s"))) == {"success": 1, "captcha": 1, "403": 1, "other": 2}
    assert [r["v"] for r in crawl.retry_order(log, "v", "s").collect()] == [4, 5, 3, 2]
    assert rows(crawl.unprocessed(log.select("v"), log.where("s = 'success'"), "v")) == [(2,), (3,), (4,), (5,)]


def test_hierarchy(spark):
    tree = spark.createDataFrame([("r", None, 0, "top"), ("b", "r", 2, "B"), ("a", "r", 1, "A"), ("c", "a", 1, "C"), ("x", None, 0, "other")], "node string, parent string, ord int, t string")
    assert {r["node"]: r["depth"] for r in hierarchy.walk(tree, "r").collect()} == {"r": 0, "a": 1, "b": 1, "c": 2}
    assert hierarchy.subtree_text(tree, "r", "t").first()["content"] == "top\nA\nC\nB"


def test_deep_hierarchy(spark):
    """Deeper than the 100 levels of a recursive query."""
    tree = spark.createDataFrame([(i, i - 1 if i else None, 0, "ab"[i % 2]) for i in range(121)], "node long, parent long, ord int, t string")
    assert {r["node"]: (r["depth"], len(r["path"])) for r in hierarchy.walk(tree, 0).collect()} == {i: (i, i + 1) for i in range(121)}
    assert hierarchy.subtree_text(tree, 119, "t").first()["content"] == "b\na"
    assert hierarchy.walk(tree, 500).count() == 0


def test_very_deep_hierarchy(spark):
    """A chain of 100,000 takes seventeen rounds, and a circle beside it none."""
    rounds = []
    keep = Scratch.keep
    tree = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).alias("ord"))
    tree = tree.unionByName(spark.createDataFrame([(200_000, 200_001, 0), (200_001, 200_000, 0), (200_002, 300_000, 0)], "id long, parent long, ord int"))
    Scratch.keep = lambda self, df: rounds.append(1) or keep(self, df)
    try:
        found = hierarchy.walk(tree, 0, node="id", paths=False)
        assert found.where("depth = node").count() == found.count() == 100_000 and len(rounds) <= 19
    finally:
        Scratch.keep = keep


def test_subtree_lines(spark, tmp_path):
    rng = random.Random(2)
    parents = {i: rng.randrange(max(0, i - 4), i) for i in range(1, 300)}
    tree = [(i, parents.get(i), i, f"t{i}" if i % 7 else "") for i in range(300)]
    children = {}
    for i, p in parents.items():
        children.setdefault(p, []).append(i)

    def told(v):
        return ([f"t{v}"] if v % 7 else []) + [t for c in sorted(children.get(v, ())) for t in told(c)]

    df = spark.createDataFrame(tree, "node long, parent long, ord int, t string").repartition(5)
    for root in (0, 9, 299):
        assert [r["value"] for r in hierarchy.subtree_lines(df, root, "t").orderBy("number").collect()] == told(root)
    hierarchy.write_subtree(df, 0, "t", str(tmp_path / "s"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "s").glob("part*"))).splitlines() == told(0)


def test_wide_hierarchy(spark):
    """More rows than the 1,000,000 of a recursive query."""
    tree = spark.range(1_000_002).select("id", F.when(F.col("id") > 0, F.lit(0)).alias("parent"), F.col("id").alias("ord"))
    assert hierarchy.walk(tree, 0, node="id").count() == 1_000_002


def test_search(spark):
    docs = spark.createDataFrame([(i, f"A{i % 2}", f"50% of_{i}", i % 3) for i in range(6)], "doc_id long, author string, text string, volume int")
    assert [r["doc_id"] for r in search.search(docs, "50% OF_3", ("text",)).collect()] == [3]
    assert search.search(docs, "%%", ("text",)).count() == 0
    assert search.by_author(docs, "a1", limit=0).count() == 1  # a limit below one gives one
    assert search.by_volume(docs, 2).count() == 2
    assert search.random_row(docs, "doc_id", 3).collect() == search.random_row(docs, "doc_id", 3).collect()


def test_rankings(spark):
    docs = spark.createDataFrame([(1, "a", "xx"), (2, "b", "yyy"), (3, "b", "zz"), (4, "c", "www"), (5, "c", "")], "k long, author string, t string")
    s = rankings.length_stats(docs, "k", "t").first()
    assert (s["longest"], s["shortest"], s["max_chars"], s["min_chars"], s["total_chars"]) == (4, 5, 3, 0, 10)
    assert [(r["author"], r["rank"]) for r in rankings.author_chars(docs, "author", "t").orderBy("rank").collect()] == [("b", 1), ("c", 2), ("a", 3)]
    counts = rankings.author_counts(docs, "author")
    assert rows(rankings.top_shares(counts, (1, 9))) == [(1, 2, 40.0), (9, 5, 100.0)]
    assert rankings.author_overview(counts).first()["singletons"] == 1
    assert rows(rankings.histogram(docs.withColumn("n", F.length("t")), "n", 3)) == [(0, 1), (2, 4)]
    assert rankings.histogram(docs.limit(0).withColumn("n", F.length("t")), "n", 3).count() == 0


def test_tree_goes_with_its_root():
    """A page is freed at once, not when the garbage collector next runs."""
    import gc
    import weakref

    from corpusloom.operators import html

    gc.disable()
    try:
        root = html.parse("<table><tr><td><a>t</a><a>b</a></td><td>c</td></tr></table>")
        gone = [weakref.ref(n) for n in (root, *root.walk())]
        assert root.all("a")[0].up("table") is root.all("table")[0]
        del root
        assert len(gone) == 7 and not any(g() for g in gone)
    finally:
        gc.enable()
