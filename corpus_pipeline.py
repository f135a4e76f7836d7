"""From raw documents to a weighted training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, minhash, mixing, suffix_dedup
from corpusloom.llm._spark import load
from corpusloom.session import dropped, stored

#: A document needs this posterior for its language; a text without letters has none.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; of the others ``lang`` is what was recognised.

    A null or empty text and one without letters goes.  Rows are judged one by one: repeated rows stay or go alike, a null or repeated id
    changes nothing, and texts are read whole.  Ties go to the first language by name.  Without any known language all documents go.
    """
    model = language_id.fit(docs.where(F.coalesce(~language_id.held_out("doc_id", 3, 1), F.lit(True))))
    seen = language_id.identify(docs, model, into="__lang_pred", score="__lang_score")
    kept = seen.where((F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("__lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays (five-word shingles, similarity 0.8).

    Texts without words and rows with a null id stay.  Rows that share an id are judged by their own texts: one goes if its text belongs
    to a group that has a lesser id, and no other text of that id goes with it; those of the least id stay together.
    """
    found = minhash.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__row"]), "left_anti").select(*docs.columns)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred before are cut out, with the rest of a character that loses some of its bytes; a document of which nothing is left goes.

    A null text comes back empty, texts under 100 bytes as they are.  Rows that share an id are documents of their own, the one with the
    least text first; a row with a null id stays as it is.  ``n_chars``, if there, is counted anew.
    """
    others = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # out of the way of the operator's own columns
    cut = suffix_dedup.deduplicated(docs.withColumnsRenamed(others), keep=list(others.values()), whole_characters=True)
    out = cut.withColumn("text", F.col("kept").cast("string")).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in others:
        out = out.withColumn(others["n_chars"], F.length("text").cast("long"))
    return out.select("doc_id", "text", *others.values()).withColumnsRenamed({v: c for c, v in others.items()}).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark passages go.

    Texts that are null or without words stay, and so does everything where there are no items.  Repeated rows stay or go alike; of rows
    that share an id, null too, each is judged by its own text.
    """
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its rate; those at rate zero are not part of the mix.

    A null or empty text has rate one and no tokens.  Repeated rows get the same rate; a null id is nobody's label.
    """
    return mixing.mix(docs, mixing.labelled_documents(spark, sf_dir, docs)).where("rate > 0")


STAGES = [
    ("language_id", identify_language),
    ("minhash", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
]

#: SQL can express neither the language model nor the mixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what each keeps is written to the shared folder, and dropped once the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
