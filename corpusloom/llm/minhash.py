"""MinHash near-dedup: universal hash minima, banding, verification on full sets, components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import U64, grams, grouped, mix, signed, slices, texts, tidy, words
from ._components import components
from ._spark import cut, load, ship

#: 28 bands of 5 minima: of pairs at similarity 0.8, two in 100,000 share no band.
BANDS, ROWS = 28, 5
_BLOCK = 1 << 15
_PARAMS = np.random.default_rng(11).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)
_MULTIPLIERS, _ADDENDS = _PARAMS[:, 0] * U64(2) + U64(1), _PARAMS[:, 1]


def shingles(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, and len + 1 offsets."""
    x, _, _, first = words(*texts(batch.column(batch.schema.get_field_index("text"))), lower=True)
    n = np.diff(first)
    doc, place = grouped(np.maximum(n - size + 1, 0))
    h = grams(x, size)[first[:-1][doc] + place]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):  # the whole sequence is the one shingle
        tail = np.array([mix(grams(x[first[d] : first[d + 1]], int(n[d])) ^ U64(int(n[d]))).item() for d in short], U64)
        h, doc = np.concatenate((h, tail)), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def minima(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signatures (texts x BANDS * ROWS, the upper 16 bits of the minima) and the band keys (texts x BANDS) of non-empty sets."""
    out = np.empty((len(at) - 1, BANDS), U64)
    signature = np.empty((len(at) - 1, BANDS * ROWS), np.uint16)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
        x, begin = h[at[i] : at[j]], at[i:j] - at[i]
        buffer = np.empty_like(x)
        key = np.zeros(j - i, U64)
        for m in range(BANDS * ROWS):
            np.multiply(x, _MULTIPLIERS[m], out=buffer)
            np.add(buffer, _ADDENDS[m], out=buffer)
            least = np.minimum.reduceat(buffer, begin)
            signature[i:j, m] = least >> U64(48)
            key = mix(key * U64(0x9E3779B97F4A7C15) ^ least)
            if m % ROWS == ROWS - 1:
                out[i:j, m // ROWS] = mix(key ^ U64(m))
                key = np.zeros(j - i, U64)
        i = j
    return signature, out


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of every set, in two halves; of the empty set both are zero."""
    some = np.flatnonzero(np.diff(at))
    k1, k2 = np.zeros(len(at) - 1, U64), np.zeros(len(at) - 1, U64)
    if len(some):
        k1[some] = np.add.reduceat(mix(h), at[:-1][some])
        k2[some] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at[:-1][some])
    return k1, k2


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, row, n, k1, k2, bands, signature) of (id, row, text): the size of the set, its key, band keys and minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, at = shingles(batch, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                k1, k2 = set_keys(h, at)
                found, keys = minima(h, np.append(at[:-1][some], at[-1])) if len(some) else (np.zeros((0, BANDS * ROWS), np.uint16), np.zeros((0, BANDS), U64))
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)), signed(keys.ravel()))
                minima_of = iter(found)
                packed = pa.array([next(minima_of).tobytes() if k else b"" for k in n], pa.binary())
                same = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "row")]
                yield pa.RecordBatch.from_arrays([*same, signed(n), signed(k1), signed(k2), bands, packed], ["id", "row", "n", "k1", "k2", "bands", "signature"])

    return docs.mapInArrow(tidy(run), "id long, row long, n long, k1 long, k2 long, bands array<long>, signature binary")


#: Shingles of one block, and of the sets that are asked for in it at once, of a group of candidates that are still to be told apart.
BLOCK_SHINGLES = 150_000
#: Up to so many candidates, their ids are broadcast to the scan of the texts; beyond that they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Pairs with one set on their right that meet in one task; a set with more is dealt to several.
PAIRS_A_SET = 250


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(node, id, n, k1, k2, last, bands, signature): each set once, with the least and the last id that has it.

    Its node in the graphs below is that least id, or a hash where an id that is repeated has several sets.
    """
    sets = rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.min("n").alias("n"), F.max(F.struct("bands", "signature")).alias("s"))
    twin = F.row_number().over(Window.partitionBy("id").orderBy("k1", "k2"))
    return sets.withColumn("twin", twin).select(F.when(F.col("twin") == 1, F.col("id")).otherwise(F.xxhash64("id", "k1", "k2")).alias("node"), "id", "n", "k1", "k2", "last", "s.bands", "s.signature")


def candidates(sets: DataFrame) -> DataFrame:
    """(u, v): each set with the least node of every bucket that it is in, from (node, bands)."""
    buckets = sets.select("node", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("bucket", "v")
    return buckets.join(least, "bucket").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ...) with the columns of ``table`` (node, x) for u and v as xu and xv; a v of very many pairs is dealt to several tasks.

    v and its part are one key, a struct: a table that is dealt by v alone would else do for a join on both, and deal all pairs of a v to one task.
    """
    x = [c for c in table.columns if c != "node"]
    left = pairs.join(table.select(F.col("node").alias("u"), *(F.col(c).alias(f"{c}u") for c in x)), "u")
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / PAIRS_A_SET).cast("int").alias("parts"))
    right = table.select(F.col("node").alias("v"), *(F.col(c).alias(f"{c}v") for c in x)).join(parts, "v")
    right = right.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct("v", i.alias("part")))).alias("spot"), *(f"{c}v" for c in x))
    spot = F.struct("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    return left.join(parts, "v").withColumn("spot", spot).drop("parts").join(right, "spot").drop("spot")


def least_agreement(percent: int) -> int:
    """The number of equal minima that sets of the given similarity have, but for six standard deviations."""
    m, p = BANDS * ROWS, percent / 100
    return int(np.ceil(m * p - 6 * np.sqrt(m * p * (1 - p))))


def by_signature(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose signatures agree as far as such pairs' do."""
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("signatureu", "signaturev"))
            keep = (a == b).sum(axis=1) >= least
            yield batch.select(["u", "v", "nu", "nv"]).filter(pa.array(keep))

    both = _beside(pairs, sets.select("node", "n", "signature")).where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    return both.select("u", "v", "nu", "nv", "signatureu", "signaturev").mapInArrow(tidy(run), "u long, v long, nu long, nv long")


def full_sets(docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """(node, set): the shingles of ``sets`` (node, id, k1, k2), read again from the texts of ``docs`` (id, text)."""
    wanted = sets.select(F.col("id").alias("__id"), "k1", "k2", "node")
    if sets.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, at = shingles(batch, size)
                k1, k2 = set_keys(h, at)
                given = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(U64) for c in ("k1", "k2")]
                ours = np.flatnonzero((k1 == given[0]) & (k2 == given[1]))  # an id may have other texts
                length = np.diff(at)[ours]
                run_of, place = grouped(length)
                node = batch.column(batch.schema.get_field_index("node")).take(pa.array(ours))
                yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), signed(h[at[ours][run_of] + place]))], ["node", "set"])

    return docs.join(wanted, docs["id"] == wanted["__id"]).select("text", "k1", "k2", "node").mapInArrow(tidy(run), "node long, set array<long>")


class _Sets:
    """Some sets with an index from values to the sets that hold them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.values, self.start = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.start[1:], len(flat))

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many values ``s`` has in common with each set."""
        if not len(self.values):
            return np.zeros(len(self.sizes), np.int64)
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        hit = at[self.values[at] == s]
        size = self.stop[hit] - self.start[hit]
        run, place = grouped(size)
        return np.bincount(self.owner[self.start[hit][run] + place], minlength=len(self.sizes))


def _links(ids: list[int], sets: list[np.ndarray], asked: list[bool], known: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join what all links between the sets that are asked for and the others join, beyond what is ``known`` to be joined."""
    top = {k: k for k in known}

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    others = [i for i, a in enumerate(asked) if not a]
    index, out = _Sets([sets[i] for i in others]), []
    where = np.array(others, np.int64)
    for i in (i for i, a in enumerate(asked) if a):
        both = index.shared(sets[i])
        for j in where[100 * both >= percent * (len(sets[i]) + index.sizes - both)].tolist():
            a, b = root(known[i]), root(known[j])
            if a != b:
                top[a] = b
                out.append((known[i], known[j]))
    return out


def across(sets: DataFrame, members: DataFrame, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v): components that a link joins, of ``members`` (node, n, component, group), written; ``sets`` has (node, set).

    Each pair of components of a group has one that isn't the group's largest.  So the sets of a group lie in
    blocks, each in one, and those outside its largest component are asked for in every block, a part of them at a time: a task holds
    a block and a part, each of ``block`` shingles or one set.  Where few are asked for, blocks are smaller, which deals a hot group
    to more tasks and no more than doubles its rows.
    """
    sizes = members.groupBy("group", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    groups = sizes.groupBy("group").agg(F.max_by(F.struct("component", "n"), F.struct("c", -F.col("component"))).alias("main"), F.sum("n").alias("n"))
    rest = F.col("n") - F.col("main.n")
    one = F.least(F.lit(block), F.greatest(rest, F.lit(max(1, block // 8))))
    groups = groups.select("group", F.col("main.component").alias("main"), F.ceil(F.col("n") / one).cast("int").alias("blocks"), F.ceil(rest / block).cast("int").alias("parts"))
    own, part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    place = lambda b, p, asked: F.struct(b.alias("block"), p.alias("part"), F.lit(asked).alias("asked"))
    lying = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: place(own, p, False))
    asked = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: place(b, part, True))
    places = F.when(F.col("component") == F.col("main"), lying).otherwise(F.concat(lying, asked))
    dealt = members.join(groups.where("parts > 0"), "group").select("node", "group", "component", F.explode(places).alias("p")).select("node", "group", "component", "p.*").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("asked", "ascending"), ("node", "ascending")]).combine_chunks()
        column = rows.column("set").combine_chunks() if isinstance(rows.column("set"), pa.ChunkedArray) else rows.column("set")
        at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(U64)
        found = _links(rows.column("node").to_pylist(), [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], rows.column("asked").to_pylist(), rows.column("component").to_pylist(), percent)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return dealt.groupBy("group", "block", "part").applyInArrow(compare, "u long, v long")


def grouped_sets(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of those of ``sets``, written, that are linked with another.

    A set is first compared with the least of those that it shares a bucket with: by signature, then in full.  That joins
    most of what belongs together.  Pairs that still lie in two components are then compared group by group.
    """
    pairs = cut(candidates(sets.select("node", "bands")))
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    full = cut(full_sets(docs, sets.select("node", "id", "k1", "k2").join(nodes, "node"), size))
    near = by_signature(pairs.groupBy("u").agg(F.min("v").alias("v")), sets, percent)
    shared = F.size(F.array_intersect("setu", "setv"))
    links = _beside(cut(near), full).where(100 * shared >= percent * (F.col("nu") + F.col("nv") - shared)).select("u", "v")
    first = components(links)
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v")
    groups = components(apart).select(F.col("node").alias("component"), F.col("component").alias("group"))
    known = sets.select("node", "n").join(nodes, "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = components(across(full, cut(known.join(groups, "component").select("node", "n", "component", "group")), percent)).select(F.col("node").alias("component"), F.col("component").alias("last"))
    return known.join(joined, "component", "left").select("node", F.coalesce("last", "component").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, row (a hash of the text), n_shingles, component (the least key reachable over links), kept (it is its own component).

    The words of a text (A-Z lower-cased, split at ASCII white space) give its set of distinct ``size``-word shingles; a text of fewer
    words is one shingle, a null text or one without words has none and is linked with nothing.  Two documents are linked where
    100 * intersection >= percent * union, confirmed on the full sets.  Equal sets are one vertex.  Pairs that share
    none of the bands aren't found: 2 in 100,000 of those right at similarity 0.8, fewer above; signatures drop fewer than one in a million.
    Rows that repeat a key are documents of their own, each with the component of its text, and kept alike where that is the same;
    a null key is linked with nothing (component null, kept).  Keys are numbers.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    signed_rows = cut(signatures(rows, size))
    sets = cut(distinct_sets(signed_rows.where("id IS NOT NULL AND n > 0")))
    found = grouped_sets(rows.select("id", "text"), sets, size, percent)
    # the least id of a component, as a node may be a hash; sets of one document have its id
    labelled = sets.select("node", "id", "last", "k1", "k2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("id").alias("label"), F.max("last").alias("last")).where("label < last")
    labels = labelled.select("component", "k1", "k2").join(least.select("component", "label"), "component").select("k1", "k2", "label")
    out = signed_rows.select("id", "row", F.col("n").alias("n_shingles"), "k1", "k2").join(labels, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "id"))
    return out.select(F.col("id").alias(key), "row", "n_shingles", component.alias("component"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(load(spark, folder, "documents"), size=4)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
