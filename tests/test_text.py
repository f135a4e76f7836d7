from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ngrams

from .conftest import rows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_authors(spark):
    df = spark.createDataFrame([("李白著",), ("著著",), ("曹著 ",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(T.clean_author(F.col("a"))).collect()] == ["李白", "著", "曹著 ", "", None]
    assert [r[0] for r in df.select(T.drop_marker(F.col("a"))).collect()] == ["李白", "", "曹", "", None]


def test_clean_and_strip(spark):
    assert one(spark, T.clean(F.col("t")), t="床前，明月 abc 光。") == "床前明月光"
    assert one(spark, T.clean(F.col("t")), t=None) == ""
    assert one(spark, T.strip(F.col("t")), t="　 床前　月 \n") == "床前　月"
    assert one(spark, T.simplify(F.col("t")), t="學而時習之") == "学而时习之"
    assert one(spark, T.sanitize(F.col("t")), t=" a/b:c_d-é 中! ") == "abc_d-é 中"
    assert len(T.TRADITIONAL) == len(T.SIMPLIFIED) == len(set(T.TRADITIONAL))


def test_page_text(spark):
    page = "<html><style>x</style><script>var a='</p>';</script><p>one &amp; two</p>\n<p>English</p>\n<p>12-3</p><br/>ab<br>三</html>"
    assert one(spark, T.page_text(F.col("p"), collapse=False), p=page) == "one two\n12-3ab三"
    assert one(spark, T.page_text(F.col("p")), p=page) == ""  # one line holds a skipped word: the page is blank
    assert one(spark, T.rich_page_text(F.col("p"), collapse=False), p=page) == "one & two\n三"
    boxed = '<div class="maintext"> kept <b>text</b></div><p>dropped</p>'
    assert one(spark, T.rich_page_text(F.col("p")), p=boxed) == "kept text"


def test_node_size(spark):
    assert rows(spark.createDataFrame([(5,), (1000,)], "m long").select(T.node_size(F.col("m")))) == [(30.0,), (6.0,)]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="床前明月光ab", max_size=9), min_size=1, max_size=8))
def test_ngram_law(spark, texts):
    """From n to n + 1 the total falls by the number of texts with n characters or more."""
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    totals = {r["n"]: r["total_grams"] for r in ngrams.ngram_totals(ngrams.ngram_counts(df, "t")).collect()}
    for n in (1, 2, 3):
        assert totals.get(n, 0) - totals.get(n + 1, 0) == sum(len(t) >= n for t in texts)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("xy"), st.text(alphabet="abc", max_size=5)), min_size=1, max_size=9))
def test_joined_grams(spark, texts):
    """Grams of joined texts, texts shorter than a gram among them."""
    df = spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(texts)], "id long, author string, t string")
    found = {(r["author"], r["gram"]): r["cnt"] for r in ngrams.joined_ngram_counts(df, "author", "id", "t").collect()}
    wanted: dict = {}
    for a in "xy":
        whole = "".join(t for b, t in texts if a == b)
        for n in (1, 2, 4):
            for i in range(len(whole) - n + 1):
                wanted[a, whole[i : i + n]] = wanted.get((a, whole[i : i + n]), 0) + 1
    assert found == wanted


def test_characters(spark):
    df = spark.createDataFrame([("a 中。😀\n",), (None,), ("",)], "t string")
    assert {r["ch"] for r in ngrams.char_frequency(df, "t").collect()} == {"a", "中", "。", "😀"}
