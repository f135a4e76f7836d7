"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as the embedding of the word, if the model knows it, and as the mean embedding of its
character trigrams.  The network reads overlapping windows of words; a text is scored on
all its windows and takes the highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER, NOT_WORD, U64, grouped, release, slices, texts, words
from ._spark import column_udf, labelled_sample, load, ship, with_place

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
CHAR_SLOTS = 1 << 13
#: Bounds of the fit: labelled texts of each class and their bytes, known words.
TEXTS_A_CLASS = 2000
BYTES_A_CLASS = 8_000_000
KNOWN_WORDS = 20_000
#: A word of fewer texts tells nothing: it may belong to copies of one text.
LEAST_TEXTS = 5
EPOCHS, AFTER = 6, 4
_BATCH = 2048


class Words:
    """The words of some texts: distinct ones with their trigram slots, and every word as an index into them."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        h, starts, ends, self.first = words(data, at, NOT_WORD, lower=True)
        self.hash, where, self.word = np.unique(h, return_index=True, return_inverse=True)
        s, e = starts[where], ends[where]
        size = e - s
        # trigrams of the word between two marks: one for each byte, centred on it
        run, place = grouped(size)
        p = s[run] + place
        low = LOWER[data].astype(np.int64) if len(data) else np.zeros(0, np.int64)
        left = np.where(place > 0, low[np.maximum(p - 1, 0)] if len(low) else 0, 256)
        right = np.where(place < size[run] - 1, low[np.minimum(p + 1, len(low) - 1)] if len(low) else 0, 257)
        mid = low[p]
        self.slot = ((left * 66049 + mid * 257 + right) * 0x9E3779B1 >> 7) % CHAR_SLOTS
        self.slot_word, self.size = run, size
        self.slot_at = np.concatenate(([0], np.cumsum(size)))

    def chars(self, table: np.ndarray) -> np.ndarray:
        """The mean of the rows of ``table`` over each distinct word's trigrams."""
        if not len(self.size):
            return np.zeros((0, table.shape[1]), np.float32)
        out = np.empty((len(self.size), table.shape[1]), np.float32)
        for a in range(0, len(self.size), 20_000):
            b = min(a + 20_000, len(self.size))
            lo, hi = self.slot_at[a], self.slot_at[b]
            out[a:b] = np.add.reduceat(table[self.slot[lo:hi]], self.slot_at[a:b] - lo, axis=0)
        return out / self.size[:, None]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(WINDOW, n) indices of distinct words, -1 beyond a text's end, and each window's text; every text has one at least."""
        n = np.diff(self.first)
        count = np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))
        doc, place = grouped(count)
        at = self.first[:-1][doc] + place * STRIDE + np.arange(WINDOW)[:, None]
        inside = at < self.first[1:][doc]
        index = np.append(self.word, -1)[np.where(inside, at, -1)]
        return np.where(inside, index, -1), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _gru(inputs: list[np.ndarray], mask: np.ndarray, recurrent: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (time, batch, HIDDEN) from the inputs' share of the three gates."""
    h = np.zeros((mask.shape[1], HIDDEN), np.float32)
    states, cache = np.empty((*mask.shape, HIDDEN), np.float32), []
    for t, p in enumerate(inputs):
        q = h @ recurrent
        zr = _sigmoid(p[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(p[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
        m = mask[t][:, None]
        new = n + z * (h - n)
        if keep:
            cache.append((h, z, r, n, q[:, 2 * HIDDEN :], m))
        h = new if m.all() else m * new + (1 - m) * h
        states[t] = h
    return states, cache


def _gru_back(grads: np.ndarray, cache: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the gate inputs (time, batch, 3 * HIDDEN) and by the recurrent weights."""
    out = np.empty((*grads.shape[:2], 3 * HIDDEN), np.float32)
    weights = np.zeros_like(recurrent)
    carry = np.zeros(grads.shape[1:], np.float32)
    for t in range(len(cache) - 1, -1, -1):
        h, z, r, n, qn, m = cache[t]
        d = carry + grads[t]
        dn_ = d * m
        dz = dn_ * (h - n) * z * (1 - z)
        dn = dn_ * (1 - z) * (1 - n * n)
        dr = dn * qn * r * (1 - r)
        out[t] = np.concatenate((dz, dr, dn), axis=1)
        dq = np.concatenate((dz, dr, dn * r), axis=1)
        weights += h.T @ dq
        carry = d * (1 - m) + dn_ * z + dq @ recurrent.T
    return out, weights


def start(rng: np.random.Generator, known: int) -> dict[str, np.ndarray]:
    normal = lambda *shape: rng.normal(size=shape).astype(np.float32) / np.sqrt(shape[0])
    wide = WORD_DIM + CHAR_DIM
    return {
        "E": 0.1 * rng.normal(size=(known + 1, WORD_DIM)).astype(np.float32), "C": 0.1 * rng.normal(size=(CHAR_SLOTS, CHAR_DIM)).astype(np.float32),
        "fP": normal(wide, 3 * HIDDEN), "bP": normal(wide, 3 * HIDDEN), "fU": normal(HIDDEN, 3 * HIDDEN), "bU": normal(HIDDEN, 3 * HIDDEN),
        "fb": np.zeros(3 * HIDDEN, np.float32), "bb": np.zeros(3 * HIDDEN, np.float32),
        "A": normal(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION), "w": normal(2 * HIDDEN), "b": np.zeros(1, np.float32),
    }


def _forward(m: dict, f_in: list[np.ndarray], b_in: list[np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    fs, fc = _gru(f_in, mask, m["fU"], keep)
    bs, bc = _gru(b_in[::-1], mask[::-1], m["bU"], keep)
    s = np.concatenate((fs, bs[::-1]), axis=2)
    u = np.tanh(s @ m["A"] + m["a"])
    e = u @ m["v"] - 30 * (1 - mask)
    alpha = np.exp(e - e.max(axis=0))
    alpha /= alpha.sum(axis=0)
    c = (alpha[:, :, None] * s).sum(axis=0)
    return c @ m["w"] + m["b"][0], (fc, bc, s, u, alpha, c)


def _projected(m: dict, known: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The gate inputs of each distinct word, for both directions, and of padding in the last row."""
    x = np.concatenate((m["E"][_rows(known, found.hash)], found.chars(m["C"])), axis=1)
    pad = np.zeros((1, x.shape[1]), np.float32)
    x = np.concatenate((x, pad))
    return x @ m["fP"] + m["fb"], x @ m["bP"] + m["bb"]


def _rows(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The rows of words in the embedding; the last row is for all others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def window_logits(model: dict, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """The logit of every window, and the text of each."""
    m = model["net"]
    fp, bp = _projected(m, model["known"], found)
    index, doc = found.windows()
    out = np.empty(index.shape[1], np.float32)
    for a in range(0, len(out), _BATCH):
        i = index[:, a : a + _BATCH]
        mask = (i >= 0).astype(np.float32)
        out[a : a + _BATCH], _ = _forward(m, [fp[r] for r in i], [bp[r] for r in i], mask)
    return out, doc


def text_scores(model: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of every text: its highest window, calibrated."""
    if len(at) < 2:
        return np.zeros(0)
    logits, doc = window_logits(model, Words(data, at))
    best = np.maximum.reduceat(logits.astype(np.float64), np.searchsorted(doc, np.arange(len(at) - 1)))
    scale, shift = model["calibration"]
    return 1 / (1 + np.exp(-(scale * best + shift)))


def _train(m: dict, known: np.ndarray, found: Words, index: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int, moments: dict) -> None:
    rows = _rows(known, found.hash)
    other = len(known)
    began = moments.setdefault("began", {k: m[k].copy() for k in ("E", "C")})
    for _ in range(epochs):
        order = rng.permutation(index.shape[1])
        for a in range(0, len(order), 128):
            pick = order[a : a + 128]
            i, t = index[:, pick], y[pick]
            mask = (i >= 0).astype(np.float32)
            used, back = np.unique(i[i >= 0], return_inverse=True)
            row = rows[used].copy()
            row[rng.random(len(row)) < 0.3] = other  # so that characters are learned from too
            lo, size = found.slot_at[used], found.size[used]
            run, place = grouped(size)
            slot = found.slot[lo[run] + place]
            chars = np.add.reduceat(m["C"][slot], np.concatenate(([0], np.cumsum(size)[:-1])), axis=0) / size[:, None] if len(used) else np.zeros((0, CHAR_DIM), np.float32)
            x = np.concatenate((np.concatenate((m["E"][row], chars), axis=1), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))).astype(np.float32)
            local = np.full(i.shape, len(used))
            local[i >= 0] = back
            xs = x[local]
            logit, (fc, bc, s, u, alpha, c) = _forward(m, list(xs @ m["fP"] + m["fb"]), list(xs @ m["bP"] + m["bb"]), mask, keep=True)
            g: dict[str, np.ndarray] = {}
            d = ((_sigmoid(logit) - t) / len(t)).astype(np.float32)
            g["b"], g["w"] = d.sum(keepdims=True), c.T @ d
            dc = d[:, None] * m["w"]
            ds = alpha[:, :, None] * dc
            dalpha = (s * dc).sum(axis=2)
            de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
            g["v"] = np.einsum("tb,tba->a", de, u)
            du = de[:, :, None] * m["v"] * (1 - u * u)
            g["A"], g["a"] = np.einsum("tbs,tba->sa", s, du), du.sum(axis=(0, 1))
            ds = ds + du @ m["A"].T
            fg, g["fU"] = _gru_back(ds[:, :, :HIDDEN], fc, m["fU"])
            bg, g["bU"] = _gru_back(ds[::-1, :, HIDDEN:], bc, m["bU"])
            bg = bg[::-1]
            g["fP"], g["bP"] = np.einsum("tbx,tbg->xg", xs, fg), np.einsum("tbx,tbg->xg", xs, bg)
            g["fb"], g["bb"] = fg.sum(axis=(0, 1)), bg.sum(axis=(0, 1))
            dx = np.zeros_like(x)
            np.add.at(dx, local.ravel(), (fg @ m["fP"].T + bg @ m["bP"].T).reshape(-1, x.shape[1]))
            dx = dx[:-1]
            g["E"], g["C"] = np.zeros_like(m["E"]), np.zeros_like(m["C"])
            np.add.at(g["E"], row, dx[:, :WORD_DIM])
            np.add.at(g["C"], slot, (dx[:, WORD_DIM:] / size[:, None])[run])
            moments["n"] += 1
            for k, v in g.items():
                a1, a2 = moments[k]
                a1 += 0.1 * (v - a1)
                a2 += 0.01 * (v * v - a2)
                if k in began:  # embeddings stay near what the counts say
                    m[k] -= 0.01 * (m[k] - began[k])
                m[k] -= (0.01 * (a1 / (1 - 0.9 ** moments["n"])) / (np.sqrt(a2 / (1 - 0.99 ** moments["n"])) + 1e-6)).astype(np.float32)


def _log_odds(items: np.ndarray, size: int, positive: np.ndarray) -> np.ndarray:
    """How much more often an item is in positive texts; ``items`` and ``positive`` are of (text, item) pairs, each once."""
    p, n = np.bincount(items[positive], minlength=size) + 0.0, np.bincount(items[~positive], minlength=size) + 0.0
    ratio = np.log((p + 0.5) / (n + 0.5))
    return np.where(p + n >= LEAST_TEXTS, ratio, 0) * (p + n) / (p + n + 2 * LEAST_TEXTS)


def fit_texts(some: list[str], labels: list[int], toxic_share: float | None = None, seed: int = 3) -> dict:
    """A model from texts and labels (1: toxic) that fit in memory; ``toxic_share`` is that of all texts, if the given ones are chosen by class.  Without both classes every text scores the share of toxic ones."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        net = start(rng, 0)
        net["w"][:] = 0
        p = min(max(share, 1e-3), 1 - 1e-3)
        return {"known": np.zeros(0, U64), "net": net, "calibration": (0.0, float(np.log(p / (1 - p))))}
    data, at = texts(pa.array(some, pa.large_string()))
    found = Words(data, at)
    doc_of_word = np.repeat(np.arange(len(some)), np.diff(found.first))
    pairs = np.unique(doc_of_word * len(found.hash) + found.word)
    pair_doc, pair_word = pairs // len(found.hash), pairs % len(found.hash)
    frequency = np.bincount(pair_word, minlength=len(found.hash))
    odds = _log_odds(pair_word, len(found.hash), y[pair_doc] > 0)
    common = np.flatnonzero(frequency >= LEAST_TEXTS)
    common = np.sort(common[np.argsort(-frequency[common], kind="stable")][:KNOWN_WORDS])
    known = found.hash[common]
    net = start(rng, len(known))
    net["E"][: len(known), 0] = odds[common]
    word_slots = np.unique(found.slot_word * CHAR_SLOTS + found.slot)
    weight = np.bincount(word_slots % CHAR_SLOTS, odds[word_slots // CHAR_SLOTS] * frequency[word_slots // CHAR_SLOTS], CHAR_SLOTS)
    net["C"][:, 0] = weight / (np.bincount(word_slots % CHAR_SLOTS, frequency[word_slots // CHAR_SLOTS], CHAR_SLOTS) + 5)
    index, doc = found.windows()
    hint = np.append(odds, -9.0)
    moments: dict = {"n": 0} | {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    model = {"known": known, "net": net, "calibration": (1.0, 0.0)}
    rank = hint[index].max(axis=0)
    for epochs in (EPOCHS, AFTER):
        # of a toxic text its most telling window is toxic; of any other its most telling ones are hard cases
        order = np.lexsort((-rank, doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        toxic = y[doc[order]] > 0
        take = order[(toxic & (place == 0)) | (~toxic & (place < 2))]
        plain = rng.permutation(np.flatnonzero(y[doc] == 0))[: len(some) // 2]
        take = np.concatenate((take, plain))
        _train(net, known, found, index[:, take], y[doc[take]], rng, epochs, moments)
        rank = window_logits(model, found)[0]
    best = np.maximum.reduceat(rank.astype(np.float64), np.searchsorted(doc, np.arange(len(some))))
    scale, shift = 1.0, 0.0
    of_all = share if toxic_share is None else toxic_share
    weights = np.where(y > 0, of_all / y.sum(), (1 - of_all) / (1 - y).sum())
    for _ in range(2000):
        e = (1 / (1 + np.exp(-(scale * best + shift))) - y) * weights
        scale, shift = max(0.05, scale - 0.05 * float((e * best).sum())), shift - 0.5 * float(e.sum())
    return model | {"calibration": (scale, shift)}


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from labelled rows; null texts and labels are left out, of each class the first by hash are used (``labelled_sample``), as many as the bounds allow."""
    placed = labelled if "__place" in labelled.columns else with_place(labelled, key, text)
    rows = placed.where(F.col(text).isNotNull() & F.col(label).isin(0, 1))
    rows = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"), F.col(label).alias("y"), "__place", "__bytes")
    found, sizes = labelled_sample(rows, "y", TEXTS_A_CLASS, BYTES_A_CLASS)
    model = fit_texts([r["t"] for r in found], [r["y"] for r in found], sizes.get(1, 0) / max(1, sum(sizes.values())))
    del found
    release()
    return model


def score(docs: DataFrame, model: dict, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each text (0 to 1), row by row, without a shuffle.

    All overlapping windows of a text are scored, whatever its length; a null or empty text is one empty window.  Repeated
    rows score alike, other columns pass through, a column that is called ``into`` already is replaced.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by KNOWN_WORDS and CHAR_SLOTS

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            column = pa.array(batch, pa.large_string(), from_pandas=True)
            record = pa.record_batch([column], ["text"])
            parts = [text_scores(sent.value, *texts(part.column(0))) for part in slices(record, "text", 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(into, column_udf("double", scores)(F.col(text)))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    labels = load(spark, folder, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    model = fit(with_place(docs.where(~out), "doc_id", "text").join(labels, "doc_id"))
    scored = score(docs.withColumn("held_out", out), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
