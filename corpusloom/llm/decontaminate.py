"""Benchmark decontamination, in DataFrame functions only.

The distinct word windows of the benchmark items are broadcast as a hash set of 64-bit hashes, and every window
of every document is looked up in it during one scan.  Hits are verified by comparing the windows themselves, which
are read from the texts that have hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, load

WINDOW = 13
#: Hashes of one broadcast, at about 64 bytes each in an executor; a larger set is looked up in several scans, each with a part of it.
HASHES_A_SCAN = 1_000_000
#: Up to so many documents with hits, their keys are broadcast to the second scan; beyond that they are joined by a shuffle.
BROADCAST_KEYS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def window_hashes(hashes: str, size: int) -> Column:
    """For each place in an array of word hashes the hash of the ``size`` words from there on; of those at the end that of fewer words, which no window has.

    Words are got one by one, as a slice of an array takes as long as the whole of it.
    """
    return F.transform(hashes, lambda _, i: F.xxhash64(F.lit(size), *(F.get(hashes, i + j) for j in range(size))))


def phrase(words: str, at: Column, size: Column) -> Column:
    return F.array_join(F.transform(F.sequence(at, at + size - 1), lambda j: F.get(words, j)), " ")


def benchmark_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(h, size, gram, item): the windows of every item; an item with fewer words is one window, one without words none."""
    split = items.select(F.col(item).cast("string").alias("item"), words(text).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    split = split.withColumn("size", F.least("n", F.lit(window))).withColumn("hashes", F.transform("w", lambda w: F.xxhash64(w)))
    h = lambda at: F.coalesce(*(F.when(F.col("size") == s, F.xxhash64(F.lit(s), *(F.get("hashes", at + j) for j in range(s)))) for s in range(1, window + 1)))
    grams = split.select("item", "size", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda at: F.struct(h(at).alias("h"), phrase("w", at, F.col("size")).alias("gram")))).alias("g"))
    return grams.select("g.h", "size", "g.gram", "item").distinct()


def find_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its key, row (a hash of the text), n_words, spans (start and size of each hit window, sorted) and items (as strings).

    A null or empty text has no words and no hit; null and empty items give no window.  Texts are read
    whole.  Rows that share a key and differ in text are judged apart; rows repeated in full come back as
    often as they came.  A null key is a key like any other.  Without items every document is clean.
    """
    grams = cut(benchmark_windows(items, item, item_text, window))
    hashes = grams.select("h").distinct()
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most ``window``
    parts = max(1, -(-hashes.count() // HASHES_A_SCAN))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    scanned = rows.select("k", "row", F.transform(words("text"), lambda w: F.xxhash64(w)).alias("w")).select("k", "row", F.size("w").alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), *(window_hashes("w", s) for s in sizes)).alias("w"))
    scanned = scanned.select("k", "row", "n_words", F.posexplode_outer("w").alias("at", "h"))
    # element 0 stands for the document itself; of the others those stay that are in the set
    # (the outer explode gets no inferred filter, which would work out the array in every step of itself)
    found = None
    for part in range(parts):
        seen = F.broadcast(hashes.where(F.pmod("h", F.lit(parts)) == part).withColumnRenamed("h", "hit"))
        hits = scanned.join(seen, F.col("h") == F.col("hit"), "left").where(F.col("hit").isNotNull() | ((F.col("at") == 0) if part == 0 else F.lit(False)))
        hits = cut(hits.select("k", "row", "n_words", "at"))
        found = hits if found is None else found.unionByName(hits)
    place = F.col("at") - 1
    size = F.element_at(F.array(*map(F.lit, sizes or [0])), (F.floor(place / F.col("n_words")) + 1).cast("int"))
    spots = found.where("at > 0").select("k", "row", F.struct(F.pmod(place, F.col("n_words")).alias("at"), size.alias("size")).alias("spot")).groupBy("k", "row").agg(F.collect_set("spot").alias("spots"))
    spans = _verified(rows, cut(spots), grams)
    base = found.where("at = 0").select("k", "row", F.col("n_words").cast("long").alias("n_words"))
    same = base["k"].eqNullSafe(spans["k"]) & (base["row"] == spans["row"])
    nothing = F.from_json(F.lit("[]"), "array<struct<at:int,size:int>>")
    return base.join(spans, same, "left").select(base["k"].alias(key), base["row"], "n_words", F.coalesce("spans", nothing).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _verified(rows: DataFrame, spots: DataFrame, grams: DataFrame) -> DataFrame:
    """(k, row, spans, items) of the spots whose words are those of a window; ``spots`` is written."""
    wanted = spots.select(F.col("k").alias("__k"), F.col("row").alias("__row"), "spots")
    keys = wanted.select("__k", "__row")
    if spots.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = F.col("k").eqNullSafe(F.col("__k")) & (F.col("row") == F.col("__row"))
    # rows repeated in full have the same hits
    texts = rows.join(keys, same, "left_semi").groupBy("k", "row").agg(F.min("text").alias("text"))
    split = texts.join(wanted, same).select("k", "row", "spots", words("text").alias("w"))
    told = split.where(F.size("w") > 0).select("k", "row", F.explode_outer(F.transform("spots", lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"), phrase("w", s["at"], s["size"]).alias("gram")))).alias("s")).select("k", "row", "s.*")
    return told.join(grams.select("size", "gram", "item"), ["size", "gram"]).groupBy("k", "row").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))


def covered(spans: str) -> Column:
    """How many words the sorted spans cover together."""
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["at"] + s["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(a["end"], s["at"]))).cast("long").alias("n"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def judged(hits: DataFrame) -> DataFrame:
    n_hit = hits.withColumn("n_hit", covered("spans"))
    return n_hit.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names: object) -> DataFrame:
    """``docs`` without its contaminated documents; the others keep every column.

    A document goes if at least a twentieth of its words lie in occurrences of benchmark windows.
    """
    bad = judged(find_hits(docs, items, key, text, **names)).where("contaminated").select(F.col(key).alias("__k"), F.col("row").alias("__row")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__k"]) & (F.xxhash64(docs[text]) == bad["__row"]), "left_anti")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    hits = judged(find_hits(load(spark, folder, "documents"), load(spark, folder, "benchmark")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP10_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS k FROM bw WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM bi)),
ks AS (SELECT DISTINCT k FROM bg),
dg AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
hit AS (SELECT dg.doc_id, dg.i, dg.k, bg.item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
