"""Repeated windows of symbols across a corpus, found by most-significant-digit passes.

All suffixes of the corpus are to be ordered by their first ``length`` symbols; groups that are
equal to that depth are the repeated windows.  A pass over every suffix would move many times
the corpus, so the digits are chosen to keep equal windows in one record for as long as possible:

1. The first digit of a window is its minimizer, the least of its ``k``-symbol substrings.  Equal
   windows have the same one.  Consecutive windows with one minimizer stay together as a *run*.
2. The second digit is the whole run.  Runs equal to this depth are equal window by window.
3. Runs that share a minimizer with a different run are cut at fixed distances from it into *cells*.  All windows of a
   cell have its core in common, most of a window; the core is the next digit, and the whole cell the one after it.
4. Only cells that share a core with a different cell are taken apart, and the last digit is the window.

Each map task first groups what it holds itself, so that a window with very many occurrences
sends one record from each task.  Digits are 64-bit hashes and a group is told by two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U64, gathered, grams, grouped, mix, signed, slices, tidy
from ._spark import shuffle_partitions

#: Kinds of records: to be resolved; known to be repeated; both.
OPEN, KNOWN, BOTH = 0, 1, 2
_PIECE = 1 << 18
_PLACE = 20
_COLUMNS = ("doc", "at", "n", "ah", "ch")
#: ``n`` has the number of windows, and above it the distance from the first window to the minimizer.
_NUMBER = (1 << 32) - 1
_CELLS = 4
#: ``at`` has the place in the text, and above it the number of the row among those that share its id.
_DUP = 40
RUN_SCHEMA = "ah long, ch long, id long, at long, n long, kind long"

#: symbols(batch) gives the symbols of all texts as uint64, and len + 1 offsets.
Symbols = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Depth:
    length: int
    k: int
    later: bool  # True: an occurrence counts as repeated if it is not the first; False: if it is not the only one


def _minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(x: np.ndarray, at: np.ndarray, depth: Depth) -> dict[str, np.ndarray]:
    """Every window of every text in ``x`` (at most 2**20 symbols), as runs: text, place, count, digits."""
    length, k = depth.length, depth.k
    counts = np.maximum(np.diff(at) - length + 1, 0)
    if not counts.any():
        return {c: np.zeros(0, U64 if c in ("ah", "ch") else np.int64) for c in _COLUMNS}
    doc, place = grouped(counts)
    p = at[:-1][doc] + place
    h = grams(x, k)
    low = U64((1 << _PLACE) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U64)
    least = (_minimum(key, length - k + 1) & low).astype(np.int64)[p]
    new = np.ones(len(p), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(p)))
    start, anchor = p[first], least[first]
    shape = ((anchor - start) << 32 | n).astype(U64)
    return {"doc": doc[first], "at": place[first], "n": n | (anchor - start) << 32, "ah": mix(h[anchor]), "ch": mix(stretch(grams(x, length), start, n) ^ shape)}


def stretch(windows: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the symbols that ``n`` consecutive windows cover: the first and the last cover them all, as n is no more than their length."""
    return mix(windows[start] * U64(0x9E3779B97F4A7C15) + windows[start + n - 1])


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, begin, end) of pieces of texts, packed so that each yield has about _PIECE symbols; long texts overlap by length - 1."""
    docs, begins, ends, size = [], [], [], 0
    for d in np.flatnonzero(np.diff(at) >= length):
        lo, hi = int(at[d]), int(at[d + 1])
        while True:
            end = min(hi, lo + 2 * _PIECE)
            docs.append(d)
            begins.append(lo)
            ends.append(end)
            size += end - lo
            if size >= _PIECE:
                yield np.array(docs), np.array(begins), np.array(ends)
                docs, begins, ends, size = [], [], [], 0
            if end == hi:
                break
            lo = end - length + 1
    if docs:
        yield np.array(docs), np.array(begins), np.array(ends)


def all_runs(x: np.ndarray, at: np.ndarray, depth: Depth) -> dict[str, np.ndarray]:
    parts = []
    for docs, begins, ends in _pieces(at, depth.length):
        whole = np.concatenate(([0], np.cumsum(ends - begins)))
        if int(ends[-1] - begins[0]) == int(whole[-1]) and (begins[1:] == ends[:-1]).all():
            piece = x[begins[0] : ends[-1]]
        else:
            piece = np.concatenate([x[a:b] for a, b in zip(begins, ends, strict=True)])
        r = runs(piece, whole, depth)
        r["at"] = r["at"] + (begins - at[docs])[r["doc"]]
        r["doc"] = docs[r["doc"]]
        parts.append(r)
    return {c: np.concatenate([r[c] for r in parts]) if parts else np.zeros(0, U64 if c in ("ah", "ch") else np.int64) for c in _COLUMNS}


def _batch(ids: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray, ah: np.ndarray, ch: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([signed(ah), signed(ch), signed(ids), signed(at), signed(n), signed(kind)], ["ah", "ch", "id", "at", "n", "kind"])


def grouped_here(ids: np.ndarray, at: np.ndarray, n: np.ndarray, ah: np.ndarray, ch: np.ndarray, later: bool) -> pa.RecordBatch:
    """Runs of one batch, grouped: one record for each group to be resolved, and what is repeated within the batch already."""
    order = np.lexsort((at, ids, ch, ah))
    ids, at, n, ah, ch = ids[order], at[order], n[order], ah[order], ch[order]
    head = np.ones(len(ids), bool)
    head[1:] = (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])
    kind = np.where(head, OPEN, KNOWN)
    if not later and len(ids):
        size = np.diff(np.append(np.flatnonzero(head), len(ids)))
        kind[head] = np.where(size > 1, BOTH, OPEN)
    known = kind == KNOWN
    # known spans need no digits: join neighbours, spread them evenly
    kids, kat, kn = ids[known], at[known], n[known] & _NUMBER
    o = np.lexsort((kat, kids))
    kids, kat, kn = kids[o], kat[o], kn[o]
    if len(kids):
        new = np.ones(len(kids), bool)
        new[1:] = (kids[1:] != kids[:-1]) | (kat[1:] != kat[:-1] + kn[:-1])
        f = np.flatnonzero(new)
        kn = np.add.reduceat(kn, f)
        kids, kat = kids[f], kat[f]
    keep = ~known
    spread = mix(kids.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + kat.astype(U64))
    return _batch(
        np.concatenate((ids[keep], kids)), np.concatenate((at[keep], kat)), np.concatenate((n[keep], kn)), np.concatenate((kind[keep], np.full(len(kids), KNOWN))),
        np.concatenate((ah[keep], spread)), np.concatenate((ch[keep], np.zeros(len(kids), U64))),
    )


def map_runs(docs: DataFrame, symbols: Symbols, depth: Depth) -> DataFrame:
    """Records of the runs of ``docs`` (id, dup, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x, at = symbols(batch)
                r = all_runs(x, at, depth)
                yield grouped_here(column(batch, "id")[r["doc"]], placed(batch, r["doc"], r["at"]), r["n"], r["ah"], r["ch"], depth.later)

    return docs.select("id", "dup", "text").mapInArrow(tidy(run), RUN_SCHEMA)


#: Documents that are looked at for frequent digits, and the share of them (and the number, at least) that must have one.
SAMPLE_DOCS, FREQUENT_SHARE, FREQUENT_LEAST = 10_000, 0.002, 20


def frequent(docs: DataFrame, symbols: Symbols, depth: Depth) -> tuple[list[int], list[int]]:
    """First digits of runs and cores of cells that very many documents have, seen in a sample of ``docs`` (id, dup, text).

    They decide only how records are dealt, never what is found.  Their number is bounded by that of the sample's runs over FREQUENT_LEAST.
    """
    n = docs.count()
    if n < FREQUENT_LEAST:
        return [], []
    some = docs.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_DOCS / n)) + 1).select("id", "dup", "text")
    least = max(FREQUENT_LEAST, int(FREQUENT_SHARE * min(n, SAMPLE_DOCS)))
    digits = lambda records: [r["ah"] for r in records.where(F.col("kind") != KNOWN).groupBy("ah").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("ah").collect()]
    records = map_runs(some, symbols, depth)
    firsts = digits(records)
    if not firsts:
        return [], []
    hot = records.where((F.col("kind") != KNOWN) & F.col("ah").isin(firsts)).select("id", "at", "n", F.lit(3).cast("long").alias("kind"), "ah")
    return firsts, digits(cells(some.join(spans_by_row(hot), ["id", "dup"]), symbols, depth))


def resolve(records: DataFrame, later: bool, apart: bool, hot: Sequence[int] = ()) -> DataFrame:
    """(id, at, n, kind, ah): kind 1 for repeated runs, and with ``apart`` kind 3 for one run of each content that shares its first digit with another.

    Runs whose first digit is ``hot`` are dealt by their content, so they meet in no one task, and count as sharing that digit.
    """
    key = F.when(F.col("ah").isin(list(hot)), F.col("ch")).otherwise(F.col("ah")) if hot else F.col("ah")
    dealt = records.repartition(shuffle_partitions(records.sparkSession), key).sortWithinPartitions("ah", "ch", "id", "at")
    shared = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ah = last_ch = None
        head: tuple | None = None  # the first record of the current content, if not yet told as repeated
        only: tuple | None = None  # the first record of the current first digit, while it has one content
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
            ah, ch, kind = c["ah"], c["ch"], c["kind"]
            m = len(ah)
            known = kind == KNOWN
            live = np.flatnonzero(~known)
            out = [(c["id"][known], c["at"][known], c["n"][known], np.full(known.sum(), 1), ah[known])]
            tell = lambda i, k: out.append((c["id"][i], c["at"][i], c["n"][i], np.full(len(i), k), ah[i]))  # noqa: B023, E731
            tell_one = lambda r, k: out.append(tuple(np.array([v]) for v in (r[0], r[1], r[2], k, r[3])))  # noqa: B023, E731
            if len(live):
                a, b, kd = ah[live], ch[live], kind[live]
                new_a = np.ones(len(live), bool)
                new_a[1:] = a[1:] != a[:-1]
                new_a[0] = last_ah is None or a[0] != last_ah
                new_b = new_a.copy()
                new_b[1:] |= b[1:] != b[:-1]
                new_b[0] |= b[0] != last_ch
                tell(live[~new_b], 1)
                if not later:
                    heads = np.flatnonzero(new_b)
                    size = np.diff(np.append(heads, len(live)))
                    twice = (size > 1) | (kd[heads] == BOTH)
                    tell(live[heads[twice]], 1)
                    if not new_b[0] and head is not None:
                        tell_one(head, 1)
                        head = None
                    if len(heads):
                        i = live[heads[-1]]
                        head = None if twice[-1] else (c["id"][i], c["at"][i], c["n"][i], ah[i])
                if apart:
                    heads = np.flatnonzero(new_b)
                    if len(heads):
                        g = np.cumsum(new_a[heads])  # groups of contents by first digit; 0: goes on from the batch before
                        sizes = np.bincount(g)
                        before = 1 if only is not None else 2  # contents of the group that goes on: one is held, or told already
                        many = (sizes[g] > 1) | np.isin(a[heads], shared)
                        if sizes[0]:
                            many[g == 0] = True
                            if before == 1:
                                tell_one(only, 3)
                                only = None
                        tell(live[heads[many]], 3)
                        if g[-1] > 0 or last_ah is None:
                            i = live[heads[-1]]
                            only = None if many[-1] else (c["id"][i], c["at"][i], c["n"][i], ah[i])
                last_ah, last_ch = a[-1], b[-1]
            joined = [np.concatenate(v) for v in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in joined], ["id", "at", "n", "kind", "ah"])

    return dealt.mapInArrow(tidy(run), "id long, at long, n long, kind long, ah long")


def windows_of(x: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``n`` windows from each place on, one place after another."""
    some, at = gathered(x, begin, n + length - 1)
    run, place = grouped(n)
    return grams(some, length)[at[run] + place]


def numbered(docs: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, dup, text, keep_...): every row with an id, dealt by id; ``dup`` numbers the rows of one id by text from 0 on."""
    some = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    ties = [c for c, kind in some.dtypes if c.startswith("keep_") and "map<" not in kind and "variant" not in kind]
    return some.withColumn("dup", F.row_number().over(Window.partitionBy("id").orderBy("text", *ties)) - 1)


def spans_by_row(found: DataFrame) -> DataFrame:
    """(id, dup, spans): the found records of each row in one array; as many as the row's text has windows at most."""
    dup = F.shiftright("at", _DUP).cast("int").alias("dup")
    # dealt by id alone, as the texts are
    return found.repartition("id").groupBy("id", dup).agg(F.collect_list(F.struct("kind", F.col("at").bitwiseAND((1 << _DUP) - 1).alias("at"), "n", "ah")).alias("spans"))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def placed(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places in the texts of the given rows as records have them."""
    return at + (column(batch, "dup").astype(np.int64) << _DUP)[row]


def cells(joined: DataFrame, symbols: Symbols, depth: Depth) -> DataFrame:
    """Records of the cells of those runs (id, text, spans) that share their minimizer with another."""
    length = depth.length
    width = -(-(length - depth.k + 1) // _CELLS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                kind, at, n, ah, row = span_arrays(batch)
                pick = np.flatnonzero(kind == 3)
                if not len(pick):
                    continue
                x, offs = symbols(batch)
                ids = column(batch, "id")
                at, n, ah, row = at[pick], n[pick], ah[pick], row[pick]
                last, count = n >> 32, n & _NUMBER
                some, start = gathered(x, offs[row] + at, count + length - 1)
                cores, whole_windows = grams(some, length - width + 1), grams(some, length)
                least = last - count + 1
                of, place = grouped(last // width - least // width + 1)
                cell = least[of] // width + place
                far, near = np.minimum(last[of], cell * width + width - 1), np.maximum(least[of], cell * width)
                m = far - near + 1
                begin, core = last[of] - far, last[of] - cell * width  # from the run's first window on
                digit = mix(cores[start[of] + core])
                content = stretch(whole_windows, start[of] + begin, m)
                new_ah = mix(ah[of].view(U64) ^ mix(digit ^ cell.astype(U64)))
                yield grouped_here(ids[row[of]], placed(batch, row[of], at[of] + begin), m, new_ah, mix(content ^ (far << 32 | m).astype(U64)), depth.later)

    return joined.select("id", "dup", "text", "spans").mapInArrow(tidy(run), RUN_SCHEMA)


def take_apart(joined: DataFrame, symbols: Symbols, depth: Depth, spans: str = "spans") -> DataFrame:
    """Records of the single windows of those cells (id, text, spans) that share their core with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                kind, at, n, ah, row = span_arrays(batch, spans)
                pick = kind == 3
                if not pick.any():
                    continue
                x, offs = symbols(batch)
                ids = column(batch, "id")
                at, n, ah, row = at[pick], n[pick] & _NUMBER, ah[pick], row[pick]
                wh = windows_of(x, offs[row] + at, n, depth.length)
                run_of, place = grouped(n)
                yield grouped_here(ids[row[run_of]], placed(batch, row[run_of], at[run_of] + place), np.ones(len(run_of), np.int64), wh, ah[run_of].view(U64), depth.later)

    return joined.select("id", "dup", "text", spans).mapInArrow(tidy(run), RUN_SCHEMA)


def span_arrays(batch: pa.RecordBatch, name: str = "spans") -> tuple[np.ndarray, ...]:
    """kind, at, n, ah and row of all elements of a column of spans; ``n`` is a plain number where the kind is 1."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    kind, at, n, ah = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
    return kind, at, np.where(kind == 1, n & _NUMBER, n), ah, np.repeat(np.arange(len(column)), sizes)


def covered(offs: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """For each symbol, whether a window that starts in one of the spans covers it."""
    edge = np.zeros(int(offs[-1]) + 1, np.int64)
    begin = offs[row] + at
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0
