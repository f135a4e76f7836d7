"""Writing volumes, rankings, lists, tables and reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import BLOCK, arranged, numbered
from ..session import dropped, stored
from .readers import AUTHOR, CONTENT, RULE, TITLE, without_rules

# Fixed names: headers of the published tables.
GRAM_HEADER = ("排名", "詞彙", "出現次數")
PERSON_HEADER = ("排名", "人物", "提及次數", "相關詩歌數", "關聯人物數")
PERSON_POEM_HEADER = ("詩歌ID", "作者", "標題", "人物", "提及次數")


def volume_lines(poems: DataFrame, order: str = "seq", block: int = BLOCK) -> DataFrame:
    """(volume, value): each poem (volume, title, author, content) as it stands in its volume, in order and numbered, the first under the header.

    ``order`` must tell the poems of a volume apart.  The newline that ends a row is not part of it.  Dashes of a field that would be a rule are broken
    by a joiner, which the readers take out again.
    """
    at = arranged(poems, order, "volume", block=block)
    field = lambda c, none: without_rules(F.coalesce(F.col(c), F.lit(none)))
    entry = F.concat(F.col("number").cast("string"), F.lit(". "), field("title", "未知標題"), F.lit(f"\n   {AUTHOR} "), field("author", "未知作者"), F.lit(f"\n   {CONTENT}\n"), field("content", "無內容"), F.lit(f"\n{RULE}\n"))
    head = F.concat(F.lit(f"{TITLE} 第"), F.col("volume").cast("string"), F.lit("卷\n" + "=" * 50 + "\n\n"))
    return at.select("volume", F.concat(F.when(F.col("number") == 1, head).otherwise(""), entry).alias("value"))


def write_volumes(poems: DataFrame, folder: str, order: str = "seq", block: int = BLOCK) -> None:
    """A folder for each volume, <folder>/volume=<n>; its files, in the order of their names, are the volume.

    A poem is a row and ``block`` poems a task's work, so a volume may be larger than either; small volumes have one file.
    """
    volume_lines(poems, order, block).write.mode("overwrite").option("lineSep", "\n").partitionBy("volume").text(folder)


def write_lines(rows: DataFrame, line: Column, folder: str, order: str | None = None) -> None:
    """One column as text; in order, it is one file (for reports and rankings, which are small)."""
    out = rows.orderBy(order).coalesce(1) if order else rows
    out.select(line.alias("value")).write.mode("overwrite").text(folder)


def write_ranking(ranking: DataFrame, folder: str, name: str = "author", count: str = "docs", rank: str = "rank") -> None:
    """A ranking as text and as JSON: <folder>/txt, <folder>/json."""
    write_lines(ranking, F.format_string("%4d. %s: %d", F.col(rank).cast("int"), F.col(name), F.col(count).cast("long")), f"{folder}/txt", rank)
    ranking.write.mode("overwrite").json(f"{folder}/json")


def write_names(names: DataFrame, folder: str, column: str = "author") -> None:
    """A name list as numbered lines, and as a Python list: <folder>/txt, <folder>/py; the files of each, in the order of their names, are the list."""
    from .reports import fixed_line, write_object

    at = numbered(names.select(F.col(column).alias("name")).distinct(), "name", into="place")
    at.orderBy("place").select(F.format_string("%4d. %s", "place", "name").alias("value")).write.mode("overwrite").text(f"{folder}/txt")
    quoted = at.select(F.lit(1).alias("section"), "place", F.concat(F.lit("    '"), "name", F.lit("',")).alias("value"))
    spark = names.sparkSession
    write_object(fixed_line(spark, 0, "authors = [").unionByName(quoted).unionByName(fixed_line(spark, 2, "]")), f"{folder}/py")


def write_csv(rows: DataFrame, folder: str, header: Mapping[str, str] | None = None, partition: tuple[str, ...] = (), bom: bool = False) -> None:
    """CSV with a header; ``header`` names the columns to write and what to call them; ``bom`` puts a mark before the first name."""
    names = dict(header or {c: c for c in rows.columns if c not in partition})
    if bom:
        first = next(iter(names))
        names[first] = "﻿" + names[first]
    out = rows.select(*(F.col(c).alias(n) for c, n in names.items()), *partition)
    writer = out.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition) if partition else writer).csv(folder)


def write_author_grams(top: DataFrame, folder: str, author: str = "author") -> None:
    """The ranked grams of each author and size, a folder each: <folder>/author=<a>/n=<n>."""
    write_csv(top.withColumnRenamed(author, "author"), folder, dict(zip(("rank", "gram", "cnt"), GRAM_HEADER, strict=True)), ("author", "n"))


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, place, value): the lines of a graph object, a node (id, weight, size) or edge (source, target, weight) each, under its totals."""
    from .reports import fixed_line, listed

    spark = nodes.sparkSession
    n = nodes.select(F.col("id").alias("place"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), "weight", "size"), {"ignoreNullFields": "false"}).alias("value"))
    e = edges.select(F.struct("source", "target").alias("place"), F.to_json(F.struct(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "weight"), {"ignoreNullFields": "false"}).alias("value"))
    head = f'{{"metadata": {{"total_nodes": {nodes.count()}, "total_edges": {edges.count()}}}, "nodes": ['
    parts = (fixed_line(spark, 0, head), listed(n, 1), fixed_line(spark, 2, '], "edges": ['), listed(e, 3), fixed_line(spark, 4, "]}"))
    return reduce(DataFrame.unionByName, parts)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph object line by line; the files of the folder, in the order of their names, are the object."""
    from .reports import write_object

    write_object(graph_lines(nodes, edges), folder)


def report(rows: DataFrame, title: str, line: Column, order: str) -> DataFrame:
    """One row ``value``: a Markdown report with a line for each of a few rows."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(items, lambda r: F.concat(F.lit("- "), r["l"])), "\n")).alias("value"))


def book_text(books: DataFrame, fields: Mapping[str, str], content: str = "content") -> Column:
    """A book's text under a header of its fields, blank ones left out."""
    head = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in fields.items()]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n" + "=" * 50 + "\n\n"), F.coalesce(F.col(content), F.lit("")))


def write_books(books: DataFrame, folder: str, urn: str, fields: Mapping[str, str], content: str = "content") -> None:
    books.select(F.col(urn).alias("urn"), book_text(books, fields, content).alias("value")).write.mode("overwrite").partitionBy("urn").text(folder)


def write_page_lines(pages: DataFrame, folder: str, key: str, html: str = "html") -> None:
    """Pages as lines {key, html} of files that hold many, each as it would stand in a file of its own: with a newline at its end.

    For many pages: with ``write_pages`` the time goes to making, moving and listing a folder for each.
    """
    pages.select(key, F.concat(F.coalesce(F.col(html), F.lit("")), F.lit("\n")).alias("html")).write.mode("overwrite").json(folder)


def write_pages(pages: DataFrame, folder: str, key: str, html: str = "html") -> None:
    """A folder with a file for each page: <folder>/<key>=<value>."""
    pages.select(key, F.coalesce(F.col(html), F.lit("")).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def write_failures(failed: DataFrame, folder: str) -> None:
    """Failed volumes as one JSON object, line by line."""
    from .reports import object_lines, write_object

    fields = ("volume", "status", "description", "original_status")
    items = failed.select(F.struct(*fields).alias("place"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    write_object(object_lines(items, '{"failed_volumes": [', f'], "total_failed": {failed.count()}}}'), folder)


def write_grams(counts: DataFrame, folder: str, k: int = 100) -> None:
    """Grams (n, gram, cnt): the ``k`` commonest of each size as text, all as JSON, and the totals: <folder>/txt, <folder>/json, <folder>/totals."""
    from ..operators.ngrams import ngram_totals, top_each

    counts, path = stored(counts)  # counted once for the three
    best = top_each(counts, k, ("n",), "gram")
    line = F.format_string("%d-gram %4d. %s: %d", F.col("n"), F.col("rank"), F.col("gram"), F.col("cnt"))
    best.orderBy("n", "rank").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(f"{folder}/txt")
    counts.write.mode("overwrite").partitionBy("n").json(f"{folder}/json")
    ngram_totals(counts).write.mode("overwrite").json(f"{folder}/totals")
    dropped(counts.sparkSession, path)


def write_person_poems(rows: DataFrame, folder: str) -> None:
    """Mentions (poem, author, title, person, mentions) as CSV under the published header."""
    write_csv(rows, folder, dict(zip(("poem", "author", "title", "person", "mentions"), PERSON_POEM_HEADER, strict=True)))


def write_person_stats(stats: DataFrame, folder: str) -> None:
    """Persons (rank, person, mentions, degree) as CSV under the published header; related poems are the mentions, each once a poem."""
    rows = stats.orderBy("rank").select("rank", "person", "mentions", F.col("mentions").alias("poems"), "degree")
    write_csv(rows, folder, dict(zip(("rank", "person", "mentions", "poems", "degree"), PERSON_HEADER, strict=True)))


def write_crawl_summary(outcomes: DataFrame, folder: str) -> None:
    """Outcomes (outcome, n) as one JSON object each."""
    outcomes.coalesce(1).write.mode("overwrite").json(folder)
