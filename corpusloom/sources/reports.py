"""Exports in the published shapes: the corpus, statistics by author, and reports in text.

A JSON object with a member for every text or author would not fit in one row.  It is written line by line: the lines of the
files of a folder, in the order of the files' names, are the object.  ``one_file`` puts them into a single file, for small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import numbered, tasks_for
from ..session import dropped, stored

# Headings and labels of the published reports, here and in the lines of corpus_report, char_ranking_lines, comparison_report, network_report and grams_report.
CORPUS_TITLE, DETAILS_NOTE, WORDS_NOTE = "全唐詩數據分析報告", "不包含標題的n-gram分析", "只統計詩歌內容字符，不包含標題"
COMPARISON_TITLE, NETWORK_TITLE, GRAMS_TITLE = "全唐詩標題對比分析報告", "# 全唐詩人物關係網路分析報告 (改進版)", "# 全唐詩作者 N-gram 分析報告 (不包含標題)"
CHARS_TITLE = "全唐詩作者字符數排名 (不包含標題)"

Line = tuple[str, Sequence[Column]]


def listed(items: DataFrame, section: int) -> DataFrame:
    """(section, place, value): ``items`` (place, value) as members of a list or map, in order; every one but the first has a comma before it."""
    items, path = stored(items.select(F.struct("place", F.monotonically_increasing_id().alias("row")).alias("o"), "value"))  # read several times
    at = numbered(items, "o", into="place", tasks=tasks_for(items, "value"))  # rows that share a place don't meet in one task
    dropped(items.sparkSession, path)  # the numbered rows are stored, too
    return at.select(F.lit(section).alias("section"), "place", F.concat(F.when(F.col("place") > 1, ",").otherwise(""), "value").alias("value"))


def fixed_line(spark: SparkSession, section: int, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(section).alias("section"), F.lit(None).cast("long").alias("place"), F.lit(text).alias("value"))


def object_lines(items: DataFrame, head: str, tail: str) -> DataFrame:
    """(section, place, value): the lines of an object whose list or map has ``items`` (place, value) between ``head`` and ``tail``."""
    spark = items.sparkSession
    return fixed_line(spark, 0, head).unionByName(listed(items, 1)).unionByName(fixed_line(spark, 2, tail))


def write_object(lines: DataFrame, folder: str, one_file: bool = False) -> None:
    if one_file:
        ordered = lines.orderBy("section", "place").coalesce(1)
    else:
        ordered = lines.repartitionByRange(tasks_for(lines, "value"), "section", "place").sortWithinPartitions("section", "place")
    ordered.select("value").write.mode("overwrite").text(folder)


def _json(row: DataFrame) -> str:
    """The one row of a small table as JSON."""
    return row.select(F.to_json(F.struct("*"))).first()[0]


def _by_name(rows: DataFrame, name: str, count: str) -> str:
    """A JSON map of a few names and counts, the largest first."""
    pairs = rows.orderBy(F.desc(count), name).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(count)).alias("o"), F.col(name).cast("string").alias("k"), F.col(count).alias("v")))), lambda e: F.struct(e["k"], e["v"]))).alias("m"))
    return pairs.select(F.to_json("m")).first()[0]


def corpus_totals(poems: DataFrame) -> DataFrame:
    return poems.agg(F.count("*").alias("total_poems"), F.count_distinct("author").alias("total_authors"), F.count_distinct("volume").alias("total_volumes"))


def corpus_lines(poems: DataFrame, at: str, k: int = 20) -> DataFrame:
    """The lines of the published corpus object: metadata, poems, statistics of authors and volumes; ``at`` is when it was made."""
    authors = poems.where(F.col("author").isNotNull()).groupBy("author").agg(F.count("*").alias("n"))
    volumes = poems.where(F.col("volume").isNotNull()).groupBy("volume").agg(F.count("*").alias("n"))
    of_authors = authors.agg(F.count("*").alias("total_authors"), F.avg("n").alias("avg_poems_per_author"), F.count_if(F.col("n") == 1).alias("single_poem_authors"))
    of_volumes = volumes.agg(F.count("*").alias("total_volumes"), F.avg("n").alias("avg_poems_per_volume"))
    best = authors.orderBy(F.desc("n"), "author").limit(k)
    meta = _json(corpus_totals(poems).withColumn("generated_at", F.lit(at)))
    items = poems.select(F.struct("volume", F.xxhash64("title", "author", "content").alias("h")).alias("place"), F.to_json(F.struct("title", "volume", "content", "author"), {"ignoreNullFields": "false"}).alias("value"))
    tail = f'], "authors": {{"statistics": {_json(of_authors)}, "top_authors": {_by_name(best, "author", "n")}}}, "volumes": {{"statistics": {_json(of_volumes)}, "volume_poem_counts": {_by_name(volumes, "volume", "n")}}}}}'
    return object_lines(items, f'{{"metadata": {meta}, "poems": [', tail)


def write_corpus(poems: DataFrame, folder: str, at: str, one_file: bool = False) -> None:
    write_object(corpus_lines(poems, at), folder, one_file)


def _tops(counts: DataFrame, k: int, name: str) -> Column:
    """Of a group's grams (n, gram, cnt) the ``k`` commonest as a sorted list; the group is one author's ranked grams."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "gram", "cnt")))), lambda g: F.struct(g["gram"].alias(name), g["cnt"].alias("count")))


def author_details(authors: DataFrame, grams: DataFrame, sizes: Sequence[int] = (1, 2, 4), k: int = 50) -> DataFrame:
    """(author, docs, ngram_counts) from (author, docs) and (author, n, gram, cnt): for each size unique and total counts and the commonest grams."""
    from ..operators.ngrams import ngram_totals, top_each

    best = top_each(grams, k, ("author", "n"), "gram").groupBy("author", "n").agg(_tops(grams, k, "ngram").alias("top_ngrams"))
    each = ngram_totals(grams, ("author",)).join(best, ["author", "n"])
    stats = lambda n: F.max(F.when(F.col("n") == n, F.struct(F.col("unique_grams").alias("unique_count"), F.col("total_grams").alias("total_count"), "top_ngrams")))
    wide = each.groupBy("author").agg(F.struct(*(stats(n).alias(f"{n}gram") for n in sizes)).alias("ngram_counts"))
    return authors.select("author", "docs").join(wide, "author", "left")


def detail_lines(details: DataFrame, at: str) -> DataFrame:
    """The lines of the published n-gram statistics: a member for every author."""
    meta = _json(details.agg(F.count("*").alias("total_authors"), F.coalesce(F.sum("docs"), F.lit(0)).alias("total_poems")).select("*", F.lit(at).alias("generated_at"), F.lit(DETAILS_NOTE).alias("note")))
    return object_lines(_members(details.select("author", F.struct(F.col("docs").alias("poem_count"), "ngram_counts").alias("stats"))), f'{{"metadata": {meta}, "author_statistics": {{', "}}")


def _members(rows: DataFrame) -> DataFrame:
    """(place, value) of (author, stats): a named member each."""
    author = F.coalesce("author", F.lit(""))
    name = F.regexp_extract(F.to_json(F.array(author)), r"(?s)^\[(.*)\]$", 1)
    return rows.select(author.alias("place"), F.concat(name, F.lit(": "), F.to_json("stats")).alias("value"))


def word_frequency_lines(chars: DataFrame, grams: DataFrame, at: str, k: int = 50, best: int = 100) -> DataFrame:
    """The lines of the published word frequencies from (author, docs, chars, mean_chars, rank) and single characters (author, gram, cnt)."""
    from ..operators.ngrams import top_each

    words = top_each(grams, k, ("author",), "gram").groupBy("author").agg(_tops(grams, k, "word").alias("top_words"))
    stats = chars.join(words, "author", "left").select("author", F.struct(F.col("chars").alias("total_chars"), F.col("docs").alias("total_poems"), F.col("mean_chars").alias("avg_chars_per_poem"), "top_words").alias("stats"))
    meta = _json(chars.agg(F.count("*").alias("total_authors"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("docs"), F.lit(0)).alias("total_poems")).select("*", F.lit(at).alias("generated_at"), F.lit(WORDS_NOTE).alias("note")))
    row = F.struct(F.col("rank"), "author", F.col("chars").alias("char_count"), F.col("docs").alias("poem_count"), F.col("mean_chars").alias("avg_chars"))
    ranking = chars.where(F.col("rank") <= best).agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("rank"))).alias("j")).first()[0]
    return object_lines(_members(stats), f'{{"metadata": {meta}, "author_statistics": {{', f'}}, "top_authors_by_chars": {ranking}}}')


# --- reports in text -------------------------------------------------------------------------------------------------


def _numbered(rows: DataFrame, section: int, rank: str, line: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col(rank).cast("long").alias("place"), line.alias("value"))


def _fixed(df: DataFrame, section: int, lines: Sequence[Line]) -> DataFrame:
    """Lines with the values of a one-row table filled in."""
    made = [F.struct(F.lit(i).cast("long").alias("place"), (F.format_string(text, *values) if values else F.lit(text)).alias("value")) for i, (text, values) in enumerate(lines)]
    return df.select(F.lit(section).alias("section"), F.explode(F.array(*made)).alias("l")).select("section", "l.place", "l.value")


def corpus_report(poems: DataFrame, at: str, k: int = 20) -> DataFrame:
    """(section, place, value): the lines of the report on a corpus (title, volume, content, author)."""
    from ..operators.ngrams import char_frequency
    from ..operators.rankings import ranked

    authors = poems.groupBy("author").agg(F.count("*").alias("n"))
    n = F.length(F.coalesce("content", F.lit("")))
    named = F.struct("title", "author")
    totals = corpus_totals(poems).join(authors.agg(F.count_if(F.col("n") == 1).alias("single"))).join(
        poems.agg(F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.max_by(named, F.struct(n, "title")).alias("longest"), F.min_by(named, F.struct(n, "title")).alias("shortest"))
    )  # one row each
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    c = F.col
    head = [(CORPUS_TITLE, ()), ("=" * 50, ()), (f"生成時間: {at}", ()), ("", ()), ("📈 基本統計", ()), ("-" * 20, ()), ("總詩歌數: %d", (c("total_poems"),)), ("總作者數: %d", (c("total_authors"),)), ("總卷數: %d", (c("total_volumes"),)),
        ("平均每卷詩歌數: %.1f", (per("total_poems", "total_volumes"),)), ("平均每位作者詩歌數: %.1f", (per("total_poems", "total_authors"),)), ("只出現一次的作者: %d", (c("single"),)), ("", ()), ("🏆 最活躍的作者 (前20名)", ()), ("-" * 30, ())]
    middle = [("", ()), ("📝 內容統計", ()), ("-" * 15, ()), ("總字符數: %,d", (c("chars"),)), ("平均詩歌長度: %.1f 字符", (per("chars", "total_poems"),)), ("最長詩歌: %s (作者: %s)", (c("longest.title"), c("longest.author"))),
        ("最短詩歌: %s (作者: %s)", (c("shortest.title"), c("shortest.author"))), ("", ()), ("🔤 最常見字符 (前20個)", ()), ("-" * 25, ())]
    best = ranked(authors.orderBy(F.desc("n"), "author").limit(k), "n", "author")
    common = ranked(char_frequency(poems, "content").orderBy(F.desc("n"), "ch").limit(k), "n", "ch")
    return (
        _fixed(totals, 0, head).unionByName(_numbered(best, 1, "rank", F.format_string("%2d. %s: %d 首", c("rank"), c("author"), c("n"))))
        .unionByName(_fixed(totals, 2, middle)).unionByName(_numbered(common, 3, "rank", F.format_string("'%s': %,d 次", c("ch"), c("n"))))
    )


def char_ranking_lines(chars: DataFrame, at: str) -> DataFrame:
    """The lines of the ranking by characters, of (author, docs, chars, mean_chars, rank)."""
    one = chars.sparkSession.range(1)
    head = [(CHARS_TITLE, ()), ("=" * 50, ()), (f"生成時間: {at}", ()), ("注意: 只統計詩歌內容字符，不包含標題", ()), ("", ()), ("📊 作者排名 (按字符數降序)", ()), ("-" * 40, ())]
    line = F.format_string("%4d. %s: %,d 字符 (%,d 首詩, 平均 %.1f 字符/首)", "rank", "author", "chars", "docs", "mean_chars")
    return _fixed(one, 0, head).unionByName(_numbered(chars, 1, "rank", line))


def comparison_report(compared: DataFrame, at: str, k: int = 50) -> DataFrame:
    """The lines of the report on what titles add, of ``rankings.title_comparison``."""
    c = F.col
    totals = compared.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("with_title", "without_title", "title_chars")))
    head = [(COMPARISON_TITLE, ()), ("=" * 50, ()), (f"生成時間: {at}", ()), ("", ()), ("📊 總體統計", ()), ("-" * 20, ()), ("包含標題總字符數: %,d", (c("with_title"),)), ("不包含標題總字符數: %,d", (c("without_title"),)), ("標題字符數: %,d", (c("title_chars"),)),
        ("標題佔比: %.2f%%", (F.coalesce(c("title_chars") / F.nullif(c("with_title"), F.lit(0)) * 100, F.lit(0.0)),)), ("", ()), ("📈 前50名作者對比 (按不包含標題排名)", ()), ("-" * 50, ()), ("排名 | 作者 | 包含標題 | 不包含標題 | 標題字符 | 排名變化", ()),
        ("     |      | 排名/字符 | 排名/字符  |          |", ()), ("-" * 80, ())]
    line = F.format_string("%4d | %-8s | %3d/%6d | %3d/%6d | %8d | %6s", "rank_without", "author", "rank_with", "with_title", "rank_without", "without_title", "title_chars", "change")
    return _fixed(totals, 0, head).unionByName(_numbered(compared.where(c("rank_without") <= k), 1, "rank_without", line))


def network_report(stats: DataFrame, poems: int, named: int, listed: int, at: str, k: int = 20) -> DataFrame:
    """The lines of the report on mentioned persons, of (person, mentions, degree, rank); ``poems`` texts in all, ``named`` with a person, ``listed`` names."""
    c = F.col
    totals = stats.agg(F.count("*").alias("persons"), F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"))
    head = [(NETWORK_TITLE, ()), ("", ()), (f"生成時間: {at}", ()), ("", ()), ("## 統計摘要", ()), ("", ()), (f"- 總詩歌數: {poems:,} 首", ()), (f"- 提到人物的詩歌: {named:,} 首", ()), ("- 發現的人物: %,d 個", (c("persons"),)),
        ("- 人物提及總次數: %,d 次", (c("mentions"),)), (f"- 作者列表總數: {listed:,} 位", ()), ("", ()), ("## 提及次數最多的前20位人物", ()), ("", ()), ("| 排名 | 人物 | 提及次數 | 相關詩歌數 | 關聯人物數 |", ()), ("|------|------|----------|------------|------------|", ())]
    line = F.format_string("| %d | %s | %d | %d | %d |", "rank", "person", "mentions", "mentions", "degree")
    return _fixed(totals, 0, head).unionByName(_numbered(stats.where(c("rank") <= k), 1, "rank", line))


def grams_report(summary: DataFrame, at: str, sizes: Sequence[int] = (1, 2, 4)) -> DataFrame:
    """The lines of the report on n-grams by author, of ``rankings.author_summary``."""
    c = F.col
    totals = summary.agg(F.count("*").alias("authors"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("docs", "chars", *(f"unique_{n}gram" for n in sizes))))
    mean = F.coalesce(c("chars") / F.nullif(c("docs"), F.lit(0)), F.lit(0.0))
    lines = [(GRAMS_TITLE, ()), ("", ()), (f"生成時間: {at}", ()), ("", ()), ("## 總體統計", ()), ("", ()), ("- 總作者數: %,d", (c("authors"),)), ("- 總詩歌數: %,d", (c("docs"),)), ("- 總字符數: %,d (不包含標題)", (c("chars"),)), ("- 平均每首詩: %.1f 字符", (mean,)),
        ("", ()), ("## N-gram 統計", ()), ("", ()), *((f"- {n}-gram 總數: %,d", (c(f"unique_{n}gram"),)) for n in sizes)]
    return _fixed(totals, 0, lines)
