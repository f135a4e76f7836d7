"""Substrings that occurred before are removed, by a depth-limited radix sort of all suffixes.

The suffixes of all texts are ordered through the threshold only, in most-significant-digit passes
(see ``_windows``); suffixes that are equal to that depth start repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import BYTE_VALUES, slices, texts, tidy
from ._spark import load, ship
from ._windows import Depth, cells, covered, frequent, map_runs, numbered, resolve, span_arrays, spans_by_row, take_apart

THRESHOLD = 100


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = texts(batch.column(batch.schema.get_field_index("text")))
    return BYTE_VALUES[data], at


def broken(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 texts belong to a character that loses a byte."""
    character = np.cumsum((data & 0xC0) != 0x80)
    lost = np.zeros(len(data) + 1, bool)
    lost[character[gone]] = True
    return lost[character]


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, keep: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, kept (binary), n_bytes, n_removed, n_spans, and the columns in ``keep``.

    Of a string of ``threshold`` bytes that occurs again, every occurrence but the first (by key, then by
    place) is removed, all its bytes.  Texts are taken whole as UTF-8; a null is empty; shorter
    texts stay as they are.  Rows that repeat a key are documents of their own, in the order of their texts; a row with a null key
    comes back unchanged and is compared with nothing.  Keys are numbers.  With ``whole_characters`` ``kept`` is without
    the rest of a character that loses some of its bytes, so it is text again; the counts stay.
    """
    ship(docs.sparkSession)
    depth = Depth(threshold, min(32, max(1, threshold // 3)), later=True)
    base = numbered(docs, key, text, keep)
    runs, cores = frequent(base, _symbols, depth)
    found = spans_by_row(resolve(map_runs(base, _symbols, depth), later=True, apart=True, hot=runs))
    joined = base.join(found, ["id", "dup"], "left")
    finer = spans_by_row(resolve(cells(joined, _symbols, depth), later=True, apart=True, hot=cores)).withColumnRenamed("spans", "finer")
    single = take_apart(base.join(finer, ["id", "dup"]), _symbols, depth, "finer")
    single = spans_by_row(resolve(single, later=True, apart=False)).withColumnRenamed("spans", "singles")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = texts(batch.column(batch.schema.get_field_index("text")))
                found = [span_arrays(batch, c) for c in ("spans", "finer", "singles")]
                kind, at, n, _, row = (np.concatenate(v) for v in zip(*found, strict=True))
                pick = kind == 1
                gone = covered(offs, row[pick], at[pick], n[pick], threshold)
                left = ~(broken(data, gone) if whole_characters else gone)
                kept, removed, spans = [], [], []
                for a, b in zip(offs[:-1], offs[1:], strict=True):
                    g = gone[a:b]
                    kept.append(data[a:b][left[a:b]].tobytes())
                    removed.append(int(g.sum()))
                    spans.append(int((g[1:] & ~g[:-1]).sum() + g[:1].sum()))
                size = np.diff(offs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(c)) for c in passed), pa.array(kept, pa.binary()), pa.array(size), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                    [*passed, "kept", "n_bytes", "n_removed", "n_spans"],
                )

    passed = ["id", *(f"keep_{c}" for c in keep)]
    schema = T.StructType([f for f in base.schema if f.name in passed] + [T.StructField("kept", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")])
    out = joined.join(finer, ["id", "dup"], "left").join(single, ["id", "dup"], "left").select(*passed, "text", "spans", "finer", "singles").mapInArrow(tidy(cut), schema)
    nameless = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), *(F.col(c).alias(f"keep_{c}") for c in keep), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("kept"))
    nameless = nameless.select(*passed, "kept", F.octet_length("kept").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    out = out.unionByName(nameless)
    return out.select(F.col("id").alias(key), "kept", "n_bytes", "n_removed", "n_spans", *(F.col(f"keep_{c}").alias(c) for c in keep))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = deduplicated(load(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], threshold: int = THRESHOLD) -> dict[int, tuple[int, int, int, str]]:
    """The same digest by a plain dictionary of all strings, for tests."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - threshold + 1):
            w = b[i : i + threshold]
            if w in seen:
                gone[i : i + threshold] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[key] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out
