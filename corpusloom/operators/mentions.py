"""Who is mentioned where, and with whom."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_size
from ..session import ship

# Single characters that begin a name, that follow in one, and titles that stand before a name.
SURNAMES = "李王張劉陳楊黃趙吳周徐孫馬朱胡郭何高林羅鄭梁謝宋唐許韓馮鄧曹彭曾蕭田董袁潘於蔣蔡余杜葉程蘇魏呂丁任沈姚盧姜崔鍾譚陸汪范金石廖賈夏韋付方白鄒孟熊秦邱江尹薛閆段雷侯龍史陶黎賀顧毛郝龔邵萬錢嚴覃武戴莫孔向湯"
GIVEN = "白李杜王孟韓柳劉韋元張賈姚許渾羅隱皮日休陸龜蒙司空圖鄭穀崔塗吳融韓偓杜荀鶴韋莊黃滔徐夤翁承贊王貞白張蠙褚載鄭遨尚顏齊己貫休皎然靈一靈澈清江法振法照廣宣無可棲白棲一護國文益可止歸仁玄寶子蘭鸞棲鳳"
TITLES = "丞相 尚書 侍郎 御史 將軍 太守 刺史 縣令 主簿 司馬 參軍 校尉 都尉 中郎 郎中 員外 博士 學士 翰林 侍講 侍讀 太師 太傅 太保 少師 少傅 少保".split()
#: Names of a dictionary that is compared name by name; a longer one goes through the automaton.
FEW_NAMES = 64


def contained(text: Column, names: Sequence[str]) -> Column:
    """The names that occur in a text, as an array in the order given; overlapping names are all found."""
    return F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(text, n))


def _automaton(names: Sequence[str]):  # noqa: ANN202
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for n in names:
            found.add_word(n, n)
        found.make_automaton()
        for batch in batches:
            yield batch.map(lambda t: sorted({n for _, n in found.iter(t)}) if t else [])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf("array<string>")(find)


def mentions(docs: DataFrame, key: str, text: str, names: Sequence[str], automaton: bool | None = None) -> DataFrame:
    """(key, person): each name of the dictionary that a text has, once a text.

    A short dictionary is compared on the JVM side; for a longer one an Aho-Corasick automaton reads each text once.
    """
    names = sorted({n for n in names if n})
    if not names:
        return docs.select(key, F.lit("").alias("person")).limit(0)
    use = len(names) > FEW_NAMES if automaton is None else automaton
    if use:
        ship(docs.sparkSession)
    found = _automaton(names)(F.col(text)) if use else contained(F.col(text), names)
    return docs.select(key, F.explode(found).alias("person"))


def title_mentions(docs: DataFrame, key: str, text: str, names: Sequence[str] = (), surnames: str = SURNAMES, given: str = GIVEN, titles: Sequence[str] = TITLES) -> DataFrame:
    """(key, person): known names, surname and given character, and title and surname, each once a text."""
    pairs = F.regexp_extract_all(text, F.lit(f"[{surnames}][{given}]"), F.lit(0))
    titled = F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(titles)})[{surnames}]"), F.lit(0))
    known = [contained(F.col(text), names)] if names else []
    return docs.select(key, F.explode(F.array_distinct(F.concat(*known, pairs, titled))).alias("person"))


def mention_counts(found: DataFrame) -> DataFrame:
    """(person, mentions): in how many texts."""
    return found.groupBy("person").agg(F.count("*").alias("mentions"))


def together(found: DataFrame, key: str, person: str = "person", tasks: int | None = None) -> DataFrame:
    """(key, persons): each text once, with the different persons in it, null among them if it is there.

    With ``tasks``, texts are dealt to that many tasks, so that one task's memory doesn't grow with the input.
    """
    told = _by_text(found, key, tasks).groupBy(key).agg(F.collect_set(person).alias("persons"), F.bool_or(F.col(person).isNull()).alias("__null"))
    return told.select(key, F.when(F.col("__null"), F.array_append("persons", F.lit(None))).otherwise(F.col("persons")).alias("persons"))


def _by_text(found: DataFrame, key: str, tasks: int | None) -> DataFrame:
    return found.repartition(tasks, key) if tasks else found.repartition(key)  # dealt first, as lists gathered before that are slow to send


def met(sets: DataFrame, items: str, a: str, b: str) -> DataFrame:
    """(a, b): each two items of a row's array, a < b.  One item at a time is taken along all others, so no row holds its pairs."""
    return sets.select(F.explode(items).alias(a), items).select(a, F.explode(items).alias(b)).where(F.col(a) < F.col(b))


def met_counts(sets: DataFrame, key: str, tasks: int | None = None, span: tuple[int | None, int | None] | None = None) -> DataFrame:
    """(p1, p2, weight): in how many texts (key, persons) two persons meet, p1 < p2; with ``tasks``, pairs are dealt to that many.

    With ``span``, the least and the greatest of persons that are whole numbers, a pair travels and is counted as one number, if all pairs are numbers of 63 bits.
    """
    pairs = met(sets.where(F.col(key).isNotNull()), "persons", "p1", "p2")
    count = F.count("*").alias("weight")
    if span is None or span[0] is None or (wide := span[1] - span[0] + 1) ** 2 > 1 << 63:
        return (pairs.repartition(tasks, "p1", "p2") if tasks else pairs).groupBy("p1", "p2").agg(count)
    kind, least = sets.schema["persons"].dataType.elementType, F.lit(span[0]).cast("long")
    number = pairs.select(((F.col("p1").cast("long") - least) * F.lit(wide).cast("long") + (F.col("p2").cast("long") - least)).alias("pair"))
    told = (number.repartition(tasks, "pair") if tasks else number).groupBy("pair").agg(count)
    return told.select((F.expr(f"pair div {wide}L") + least).cast(kind).alias("p1"), (F.expr(f"pair % {wide}L") + least).cast(kind).alias("p2"), "weight")


def cooccurrence(found: DataFrame, key: str, person: str = "person", tasks: int | None = None) -> DataFrame:
    """(p1, p2, weight): in how many texts two persons meet, p1 < p2.

    With ``tasks``, texts and pairs are dealt to that many tasks, so that one task's memory doesn't grow with the input.
    """
    return met_counts(_by_text(found, key, tasks).groupBy(key).agg(F.collect_list(person).alias("persons")), key, tasks)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("p1").alias("person")).agg(F.count_distinct("p2").alias("degree"))


def mention_stats(found: DataFrame, key: str) -> DataFrame:
    """(person, mentions, degree, rank): with the number of persons met."""
    from .rankings import ranked

    return ranked(mention_counts(found).join(degrees(cooccurrence(found, key)), "person", "left").na.fill(0, ["degree"]), "mentions", "person")


def mention_rows(found: DataFrame, docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each mention with columns of its text and the person's number of mentions."""
    return found.join(docs.select(key, *columns), key).join(mention_counts(found), "person")


def mention_report(found: DataFrame, named: DataFrame, key: str, name: str) -> DataFrame:
    """One row of totals; texts are told by ``name``, so texts of one name count once, and also by key."""
    with_name = found.join(named.select(key, name), key)
    return with_name.agg(
        F.count_distinct(name).alias("named_texts"), F.count_distinct(key).alias("texts"), F.count_distinct("person").alias("persons"), F.count("*").alias("mentions")
    )


def labelled(nodes: DataFrame, least: int = 10) -> DataFrame:
    """The nodes that a drawing would name."""
    return nodes.where(F.col("weight") >= least)


def network(counts: DataFrame, edges: DataFrame, least_mentions: int = 3, least_degree: int = 1, divisor: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, weight, degree, size) with enough mentions and neighbours, and the edges (source, target, weight) between them."""
    important = counts.join(degrees(edges), "person").where((F.col("mentions") >= least_mentions) & (F.col("degree") >= least_degree))
    nodes = important.select(F.col("person").alias("id"), F.col("mentions").alias("weight"), "degree", node_size(F.col("mentions"), divisor).alias("size"))
    kept = edges.where("weight > 0")
    for end in ("p1", "p2"):
        kept = kept.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, kept.select(F.col("p1").alias("source"), F.col("p2").alias("target"), "weight")
