"""Language identification, words first.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to its longest character n-grams that the model
knows, and to shorter and shorter ones where it knows none.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import column_udf, load, ship

UNKNOWN = "und"
#: Bounds of the model: labelled documents a language, words and n-grams a language.
DOCS_A_LANGUAGE = 1500
WORDS_A_LANGUAGE = 15_000
GRAMS_A_LANGUAGE = 15_000
#: The fit takes n-grams from words of up to so many letters: longer runs are data rather than words, and one may be a whole text.  They count as words, and are scored whole.
GRAM_WORD_LETTERS = 60
ORDERS = (5, 4, 3, 2, 1)
MEMO_WORDS = 200_000
#: A word is a run of letters, characters of the categories L*; here and in the fit, which runs on the JVM.
_JAVA_WORD = r"\p{L}+"
_NEARLY = re.compile(r"[^\W\d_]+")


@functools.cache
def _letters() -> re.Pattern:
    """Runs of letters; Python's own word characters have numerals such as fractions and circled digits among them."""
    numerals = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return re.compile(f"[^\\W\\d_{re.escape(numerals)}]+")


def letter_runs(text: str) -> list[str]:
    found = _NEARLY.findall(text)
    return found if all(map(str.isalpha, found)) else _letters().findall(text)


def _top(counted: DataFrame, most: int) -> list[dict]:
    """The commonest items of each language, at most ``most``; ties by item."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "item"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank").toArrow().to_pylist()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_a_language: int = DOCS_A_LANGUAGE) -> dict:
    """A model from texts with known languages.

    Rows with a null text or language are left out.  Of a language with more than ``docs_a_language``
    documents a share chosen by a hash of ``key`` is used, so the fit stays bounded; whole texts are read.
    An empty table gives a model that answers ``und`` to everything.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"langs": [], "words": {}, "grams": {}, "word_logs": np.zeros((0, 0)), "gram_logs": np.zeros((0, 0))}
    langs = sorted(sizes)
    place = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1_000_000))
    chosen = F.lit(False)
    for name in langs:
        chosen = chosen | ((F.col("lang") == name) & (place < int(1_000_000 * min(1.0, docs_a_language / sizes[name])) + 1))
    counted = (
        rows.where(chosen)
        .select("lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(_JAVA_WORD), F.lit(0))).alias("item"))
        .groupBy("lang", "item").agg(F.count("*").alias("n"))
        .persist()
    )
    try:
        totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        words = _top(counted.where("n >= 2"), WORDS_A_LANGUAGE)
        bounded = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
        grams = (
            counted.where(F.length("item") <= GRAM_WORD_LETTERS)
            .select("lang", "n", bounded.alias("w"))
            .select("lang", "n", F.explode(F.concat(*(F.regexp_extract_all("w", F.lit("(?=(" + "." * o + "))"), F.lit(1)) for o in ORDERS))).alias("item"))
            .groupBy("lang", "item").agg(F.sum("n").alias("n"))
        )
        gram_rows = _top(grams.where("n >= 3"), GRAMS_A_LANGUAGE)
    finally:
        counted.unpersist()

    def table(found: list, mass: dict) -> tuple[dict, np.ndarray]:
        items = {w: i for i, w in enumerate(sorted({r["item"] for r in found}))}
        n = np.zeros((len(items), len(langs)))
        for r in found:
            n[items[r["item"]], langs.index(r["lang"])] = r["n"]
        return items, np.log((n + 0.1) / (np.array([mass.get(x, 0) for x in langs]) + 0.1 * (len(items) + 1))).astype(np.float32)

    word_index, word_logs = table(words, totals)
    mass: dict = {}
    for r in gram_rows:
        mass[r["lang"]] = mass.get(r["lang"], 0) + r["n"]
    gram_index, gram_logs = table(gram_rows, mass)
    return {"langs": langs, "words": word_index, "grams": gram_index, "word_logs": word_logs, "gram_logs": gram_logs}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.langs, self.words, self.grams, self.gram_logs = model["langs"], model["words"], model["grams"], model["gram_logs"]
        self.known = len(self.words)
        self.rows = np.zeros((self.known + 1024, max(1, len(self.langs))), np.float32)
        if self.known:
            self.rows[: self.known] = model["word_logs"]
        self.memo: dict[str, int] = {}

    def backoff(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's longest known n-grams; evidence grows with the order."""
        w = f"^{word}$"
        for order in ORDERS:
            found = [g for g in (self.grams.get(w[i : i + order]) for i in range(len(w) - order + 1)) if g is not None]
            if found:
                return self.gram_logs[found].mean(axis=0) * (order / max(ORDERS))
        return np.zeros(len(self.langs), np.float32)

    def _row(self, word: str) -> int:
        at = self.known + len(self.memo)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.backoff(word)
        self.memo[word] = at
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        found = letter_runs(text.lower()) if text else []
        if not found or not self.langs:
            return UNKNOWN, 0.0
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        known, memo = self.words, self.memo
        at = [i if (i := known.get(w)) is not None else j if (j := memo.get(w)) is not None else self._row(w) for w in found]
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        best = int(p.argmax())  # ties: the first by name
        return self.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: dict, text: str = "text", into: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with its predicted language and that language's posterior, row by row, without a shuffle.

    A null text, one without a letter, or an empty model gives ``und`` with score 0.  Very long texts are
    read whole, ties go to the first language by name, repeated rows are scored alike, other columns pass
    through and columns that are already called ``into`` or ``score`` are replaced.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS_A_LANGUAGE and GRAMS_A_LANGUAGE

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield pd.DataFrame([scorer.score(t) for t in batch], columns=["lang", "score"])

    kept = [c for c in docs.columns if c not in (into, score)]
    out = "__language"
    return docs.withColumn(out, column_udf("lang string, score double", scores)(F.col(text))).select(*kept, F.col(f"{out}.lang").alias(into), F.col(f"{out}.score").alias(score))


def held_out(key: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)) == part


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    out = F.coalesce(held_out("doc_id", 3, 1), F.lit(False))
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text", out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
