"""Word passages that occur more than once are removed wherever they stand, by matching statistics on suffix automata.

The corpus is its own reference, so an automaton of all of it could not be broadcast: neither its size
nor the time to stream every document past every shard has a bound.  The reference is therefore cut into
shards by content.  Every window of ``window`` words goes to the shard of its minimizer (see ``_windows``), where a
suffix automaton with occurrence counts is built of the passages that share it; the passages are then streamed
through that automaton for matching statistics.  Equal windows always meet in one shard.
Passages that are equal as a whole are told as repeated before any automaton is built.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, grouped, mix, signed, slices, texts, tidy, words
from ._spark import load, ship, shuffle_partitions
from ._windows import RUN_SCHEMA, Depth, column, covered, frequent, grouped_here, map_runs, numbered, placed, resolve, span_arrays, spans_by_row, windows_of

WINDOW = 35
#: The most passages of one automaton; a shard with more is told by sorting its windows, with the same result.
SHARD_PASSAGES = 400


class SuffixAutomaton:
    """A suffix automaton of several passages with the number of places at which each state's strings end."""

    def __init__(self, passages: list[list[int]]) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]
        for p in passages:
            last = 0
            for c in p:
                last = self._extend(last, c)
                self.count[last] += 1
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def _new(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.count.append(0)
        return len(self.size) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # another passage went this way
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, c, q)
        new, p = self._new(self.size[last] + 1, {}, 0), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, c, q)
        return new

    def repeated(self, passage: list[int], length: int) -> list[int]:
        """Where the passage has ``length`` symbols that end at two places or more."""
        state = matched = 0
        out = []
        for i, c in enumerate(passage):
            while state and c not in self.step[state]:
                state = self.link[state]
                matched = self.size[state]
            if c in self.step[state]:
                state, matched = self.step[state][c], matched + 1
            while self.link[state] >= 0 and self.size[self.link[state]] >= length:
                state = self.link[state]
                matched = self.size[state]
            if matched >= length and self.count[state] > 1:
                out.append(i - length + 1)
        return out


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x, _, _, first = words(*texts(batch.column(batch.schema.get_field_index("text"))))
    return x, first


def _passages(joined: DataFrame, depth: Depth) -> DataFrame:
    """(ah, id, at, n, words): the passages that share a minimizer with a different one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                kind, at, n, ah, row = span_arrays(batch)
                pick = kind == 3
                if not pick.any():
                    continue
                x, offs = _symbols(batch)
                ids = column(batch, "id")
                at, n, ah, row = at[pick], n[pick] & ((1 << 32) - 1), ah[pick], row[pick]
                begin = offs[row] + at
                cut = [x[b : b + m + depth.length - 1].tobytes() for b, m in zip(begin, n, strict=True)]
                yield pa.RecordBatch.from_arrays([signed(ah), signed(ids[row]), signed(placed(batch, row, at)), signed(n), pa.array(cut, pa.binary())], ["ah", "id", "at", "n", "words"])

    return joined.mapInArrow(tidy(run), "ah long, id long, at long, n long, words binary")


def _match(passages: DataFrame, depth: Depth, most: int, hot: Sequence[int]) -> DataFrame:
    """Records (see ``_windows``) of repeated windows: known ones from the automata, open ones of shards that are too large, as those of ``hot`` digits."""
    rest, out = passages, None
    if hot:
        rest, out = passages.where(~F.col("ah").isin(list(hot))), _windows(passages.where(F.col("ah").isin(list(hot))), depth)
    large = rest.groupBy("ah").agg(F.count("*").alias("c")).where(F.col("c") > most).select("ah")
    told = _automata(rest.join(large, "ah", "left_anti"), depth).unionByName(_windows(rest.join(large, "ah", "left_semi"), depth))
    return told if out is None else told.unionByName(out)


def _automata(passages: DataFrame, depth: Depth) -> DataFrame:
    dealt = passages.repartition(shuffle_partitions(passages.sparkSession), "ah").sortWithinPartitions("ah", "id", "at")

    def shard(group: list[tuple]) -> list[tuple[int, int]]:
        words_of = [np.frombuffer(r[4], np.uint64).tolist() for r in group]
        automaton = SuffixAutomaton(words_of)
        return [(r[1], r[2] + i) for r, s in zip(group, words_of, strict=True) for i in automaton.repeated(s, depth.length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("ah", "id", "at", "n", "words")), strict=True):
                if group and group[0][0] != r[0]:
                    found += shard(group) if len(group) > 1 else []
                    group = []
                group.append(r)
            if found:
                yield _known(*(np.array(v, np.int64) for v in zip(*found, strict=True)))
        if len(group) > 1 and (found := shard(group)):
            yield _known(*(np.array(v, np.int64) for v in zip(*found, strict=True)))

    return dealt.mapInArrow(tidy(run), RUN_SCHEMA)


def _windows(passages: DataFrame, depth: Depth) -> DataFrame:
    """Each window by itself, where it stands: they are dealt by their own content, so a hot shard meets in no one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ah, ids, at, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ah", "id", "at", "n"))
            run_of, place = grouped(n)
            x = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint64)
            size = n + depth.length - 1
            wh = windows_of(x, np.cumsum(size) - size, n, depth.length)
            yield grouped_here(ids[run_of], at[run_of] + place, np.ones(len(run_of), np.int64), wh, ah[run_of].view(U64), depth.later)

    return passages.select("ah", "id", "at", "n", "words").mapInArrow(tidy(run), RUN_SCHEMA)


def _known(ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(ids)))
    one = np.ones(len(first), np.int64)
    return pa.RecordBatch.from_arrays([signed(v) for v in (ids[first] * 31 + at[first], 0 * one, ids[first], at[first], n, one)], ["ah", "ch", "id", "at", "n", "kind"])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_passages: int = SHARD_PASSAGES) -> DataFrame:
    """One row per row of ``docs``: key, kept (binary: the kept words joined by one space), n_words, n_removed.

    Words are runs of anything but ASCII white space, unchanged.  Each word in a window of ``window`` words that also
    starts anywhere else, in the same document too, is removed.  Texts are taken whole; a null has no words, shorter texts keep
    all theirs.  Rows that repeat a key are documents of their own; a row with a null key comes back with
    all its words and is compared with nothing.  Keys are numbers.  Columns other than the key are not returned.
    """
    ship(docs.sparkSession)
    depth = Depth(window, min(8, max(1, window // 3)), later=False)
    base = numbered(docs, key, text)
    hot, _ = frequent(base, _symbols, depth)
    joined = base.join(spans_by_row(resolve(map_runs(base, _symbols, depth), later=False, apart=True, hot=hot)), ["id", "dup"], "left")
    single = spans_by_row(resolve(_match(_passages(joined, depth), depth, shard_passages, hot), later=False, apart=False)).withColumnRenamed("spans", "singles")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, offs = texts(batch.column(batch.schema.get_field_index("text")))
                _, starts, ends, first = words(data, offs)
                kind, at, n, _, row = (np.concatenate(v) for v in zip(*(span_arrays(batch, c) for c in ("spans", "singles")), strict=True))
                pick = kind == 1
                keep = ~covered(first, row[pick], at[pick], n[pick], window)
                kept_before = np.concatenate(([0], np.cumsum(keep)))[first]
                s, size = starts[keep], (ends - starts)[keep] + 1
                run_of, place = grouped(size)
                flat = data[np.minimum(s[run_of] + place, len(data) - 1)] if len(s) else np.zeros(0, np.uint8)
                stop = np.concatenate(([0], np.cumsum(size)))
                flat[stop[1:] - 1] = 0x20
                ends_at = stop[kept_before]
                kept = [flat[a : max(a, b - 1)].tobytes() for a, b in zip(ends_at[:-1], ends_at[1:], strict=True)]
                n_words = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("id")), pa.array(kept, pa.binary()), pa.array(n_words), pa.array(n_words - np.diff(kept_before))], ["id", "kept", "n_words", "n_removed"]
                )

    out = joined.join(single, ["id", "dup"], "left").mapInArrow(tidy(cut), "id long, kept binary, n_words long, n_removed long")
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    nameless = docs.where(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.array_join(found, " ").cast("binary").alias("kept"), F.size(found).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")
    )
    return out.unionByName(nameless).withColumnRenamed("id", key)


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = deduplicated(load(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same digest by counting all windows, for tests."""
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    counts = Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if counts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d WHERE len(ws) > 0),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS kept, count(gone.p) AS n_removed
      FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
