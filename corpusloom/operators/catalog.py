"""Book catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simplify

# Fixed format: the columns of a catalog, and the detail record behind them.
COLUMNS = ("序號", "書名", "URN", "作者", "朝代_開始", "朝代_結束", "創作日期_開始", "創作日期_結束", "版本", "標籤", "最後修改", "頂層標題", "頂層URN", "作品URN")
DETAIL = "title string, author string, dynasty struct<from:struct<name:string>,to:struct<name:string>>, compositiondate struct<from:string,to:string>, edition struct<title:string>, tags array<string>, lastmodified string, toptitle string, topurn string, workurn string"


def rows(titles: DataFrame, details: DataFrame) -> DataFrame:
    """The catalog: ``titles`` (ord, title, urn) with what ``details`` (urn, json) tells; blank where it tells nothing."""
    d = F.from_json("json", DETAIL)
    joined = titles.join(details.select("urn", d.alias("d")), "urn", "left")
    fields = ("d.author", "d.dynasty.from.name", "d.dynasty.to.name", "d.compositiondate.from", "d.compositiondate.to", "d.edition.title", None, "d.lastmodified", "d.toptitle", "d.topurn", "d.workurn")
    values = [F.array_join("d.tags", ", ") if f is None else F.col(f) for f in fields]
    return joined.select(F.col("ord").alias(COLUMNS[0]), F.col("title").alias(COLUMNS[1]), F.col("urn").alias(COLUMNS[2]), *(F.coalesce(v, F.lit("")).alias(c) for v, c in zip(values, COLUMNS[3:], strict=True)))


def distribution(books: DataFrame, column: str) -> DataFrame:
    """(value, n), blanks left out."""
    return books.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def lookup(books: DataFrame, name: str, title: str = "title") -> DataFrame:
    """The books of the best tier with any: exact title, exact simplified, containing, containing simplified (regardless of case); all ties."""
    spark = books.sparkSession
    simple = spark.range(1).select(simplify(F.lit(name))).first()[0]
    t = F.col(title)
    tier = F.when(t == name, 1).when((t == simple) & F.lit(simple != name), 2).when(F.contains(F.lower(t), F.lit(name.lower())), 3).when(F.contains(F.lower(t), F.lit(simple.lower())) & F.lit(simple != name), 4)
    found = books.withColumn("tier", tier).where("tier IS NOT NULL")
    best = found.agg(F.min("tier")).first()[0]
    return found.where(F.col("tier") == F.lit(best)) if best is not None else found
