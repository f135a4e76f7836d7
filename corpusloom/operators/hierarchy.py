"""Trees given as (node, parent, ord, ...) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, dropped
from .order import numbered


def walk(tree: DataFrame, root: object, node: str = "node", parent: str = "parent", order: str = "ord", paths: bool = True) -> DataFrame:
    """(node, depth, path): what is below ``root``, itself included; ordering by path is document order.  The rows must form a tree.

    Pointer doubling: each node knows an ancestor, and the way from it; a round replaces that by the ancestor's own ancestor, twice as far, until
    it is the root.  So there are as many rounds as the depth has binary digits.  A path is as long as its node is deep; without
    ``paths`` the rows are of one size.  Rows that the root can't be reached from are left out, also those of a circle.
    """
    rows = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(order).cast("int").alias("ord"))
    top = rows.where(F.col("node") == F.lit(root)).select("node", F.lit(0).alias("depth"), *([F.array(F.lit(0)).alias("path")] if paths else []))
    scratch = Scratch(tree.sparkSession)
    way = [F.array("ord").alias("path")] if paths else []
    below = rows.where(F.col("parent").isNotNull() & (F.col("node") != F.lit(root)))
    at = scratch.keep(below.select("node", F.col("parent").alias("up"), F.lit(1).alias("depth"), *way))
    for _ in range(at.count().bit_length() + 1):  # after so many rounds only circles are left
        if at.where(F.col("up") != F.lit(root)).isEmpty():
            break
        further = at.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), *([F.col("path").alias("__path")] if paths else []))
        way = [F.concat("__path", "path").alias("path")] if paths else []
        moved = at.where(F.col("up") != F.lit(root)).join(further, "up").select("node", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), *way)
        at = scratch.keep(at.where(F.col("up") == F.lit(root)).unionByName(moved))
        for path in scratch.paths[:-1]:
            dropped(tree.sparkSession, path)
        scratch.paths = scratch.paths[-1:]
    under = at.where(F.col("up") == F.lit(root)).join(top.select(F.lit(True).alias("there")).limit(1))  # a root that isn't there has nothing below it
    return top.unionByName(under.select("node", "depth", *([F.concat(F.array(F.lit(0)), "path").alias("path")] if paths else [])))


def subtree_lines(tree: DataFrame, root: object, text: str, node: str = "node", parent: str = "parent", order: str = "ord") -> DataFrame:
    """(number, depth, value): the texts below ``root`` that are not empty, numbered in document order, a row each."""
    below = walk(tree, root, node, parent, order).join(tree.select(F.col(node).alias("node"), F.col(text).alias("value")).where(F.col(text) != ""), "node")
    return numbered(below.select("path", "depth", "value"), "path", into="number").select("number", "depth", "value")


def write_subtree(tree: DataFrame, root: object, text: str, folder: str, **columns: str) -> None:
    """The texts below ``root`` as lines; the files of the folder, in the order of their names, are the document."""
    subtree_lines(tree, root, text, **columns).orderBy("number").select("value").write.mode("overwrite").text(folder)


def section_text(sections: DataFrame, group: str, order: str, text: str, separator: str = "\n") -> DataFrame:
    """(group, sections, content): the texts of each group joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return sections.groupBy(group).agg(F.count("*").alias("sections"), F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias("content"))


def subtree_text(tree: DataFrame, root: object, text: str, node: str = "node", parent: str = "parent", order: str = "ord", separator: str = "\n") -> DataFrame:
    """One row: the texts below ``root`` in document order."""
    below = walk(tree, root, node, parent, order).join(tree.select(F.col(node).alias("node"), F.col(text).alias("t")), "node")
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("t"), F.lit("")) != "", F.struct("path", "t"))))
    return below.agg(F.count("*").alias("nodes"), F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias("content"))
