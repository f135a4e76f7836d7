"""Mixing to target weights with soft membership.

A classifier that is fitted on a table of labelled documents gives each document its posterior over the
domains.  Document rates r >= 0 are then fitted by distributed projected gradient steps, so that each
domain's expected tokens, the sum of rate * tokens * posterior, meet a target.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER, NOT_WORD, WHITESPACE, release, slices, texts, word_spans, words
from ._spark import column_udf, cut, labelled_sample, load, ship, with_place

#: Bounds of the classifier: labelled documents of each domain and their bytes, known words and the documents that a word must be in to be known.
DOCS_A_DOMAIN = 800
BYTES_A_DOMAIN = 4_000_000
KNOWN_WORDS = 20_000
LEAST_DOCS = 3
#: The miss, as a share of all tokens, that counts as none; passes after which the fit gives up (and says so); first and last pull.
CLOSE, PASSES = 1e-7, 200
LOOSEST, TIGHTEST = 1e-6, 1e-13
#: Shares of all tokens.
TARGETS = {"good": 0.78, "plain": 0.17, "toxic": 0.05}


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte shares (texts x 256), the hash of every word, and each text's first word."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    counts = np.bincount(owner * 256 + LOWER[data], minlength=n * 256).reshape(n, 256)
    h, _, _, first = words(data, at, NOT_WORD, lower=True)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), h, first


def _slots(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word among the known ones; one more for all others."""
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    distinct, back = np.unique(hashes, return_inverse=True)
    at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
    return np.where(known[at] == distinct, at, len(known))[back]


def _word_scores(table: np.ndarray, slot: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the words' rows over each text, over the root of their number."""
    n = np.diff(first)
    out = np.zeros((len(n), table.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(table[slot], first[:-1][some], axis=0)
    return out / np.sqrt(np.maximum(n, 1))[:, None]


def fit_texts(some: Sequence[str], domains: Sequence[str], names: Sequence[str], sizes: Mapping[str, int] | None = None, rounds: int = 200) -> dict:
    """Multinomial logistic regression on byte shares and known words; a domain without examples has its prior only.

    ``sizes`` tells how many labelled documents each domain has in all, where the examples are shares of them.
    """
    data, at = texts(pa.array(list(some), pa.large_string()))
    y = np.array([names.index(d) for d in domains], np.int64)
    k = len(names)
    dense, h, first = _features(data, at)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    distinct, back = np.unique(h, return_inverse=True)
    docs = np.bincount(np.unique(back * max(1, len(n)) + owner) // max(1, len(n)), minlength=len(distinct))
    common = np.flatnonzero(docs >= LEAST_DOCS)
    known = np.sort(distinct[common[np.argsort(-docs[common], kind="stable")][:KNOWN_WORDS]])
    slot = _slots(known, h)
    hot = np.eye(k)[y] if len(y) else np.zeros((0, k))
    sampled = hot.sum(axis=0)
    whole = np.array([(sizes or {}).get(d, s) for d, s in zip(names, sampled, strict=True)], float)
    weight = (whole / np.maximum(sampled, 1))[y] if len(y) else np.zeros(0)
    weight = weight / max(weight.sum(), 1e-300)
    b = np.log((whole + 1) / (whole.sum() + k))
    wd, ww = np.zeros((256, k)), np.zeros((len(known) + 1, k))
    scale = 1 / np.sqrt(np.maximum(n, 1))
    speed_d, speed_w = np.full_like(wd, 1e-8), np.full_like(ww, 1e-8)
    for _ in range(rounds if len(y) else 0):
        z = dense @ wd + _word_scores(ww, slot, first) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - hot) * weight[:, None]
        gd = dense.T @ e + 1e-5 * wd
        each = (e * scale[:, None])[owner]
        gw = np.stack([np.bincount(slot, each[:, j], len(known) + 1) for j in range(k)], axis=1) + 3e-5 * ww
        gw[-1] = 0  # unknown words tell nothing
        speed_d += gd * gd
        speed_w += gw * gw
        wd -= 0.3 * gd / np.sqrt(speed_d)
        ww -= 0.3 * gw / np.sqrt(speed_w)
    return {"names": list(names), "dense": wd, "known": known, "words": ww.astype(np.float32), "bias": b}


def fit(labelled: DataFrame, names: Sequence[str], key: str = "doc_id", text: str = "text", domain: str = "domain") -> dict:
    """The classifier from labelled rows; nulls are left out, of each domain the first by hash are used (``labelled_sample``), as many as the bounds allow."""
    placed = labelled if "__place" in labelled.columns else with_place(labelled, key, text)
    rows = placed.where(F.col(text).isNotNull() & F.col(domain).isin(*names))
    rows = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"), F.col(domain).alias("d"), "__place", "__bytes")
    found, sizes = labelled_sample(rows, "d", DOCS_A_DOMAIN, BYTES_A_DOMAIN)
    model = fit_texts([r["t"] for r in found], [r["d"] for r in found], names, sizes)
    del found
    release()
    return model


def posteriors(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``__mix``: struct(tokens, p): the number of words and the posterior of each domain."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # KNOWN_WORDS bounds it

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for batch in batches:
            record = pa.record_batch([pa.array(batch, pa.large_string(), from_pandas=True)], ["text"])
            tokens, found = [], []
            for part in slices(record, "text", 1 << 20):
                data, at = texts(part.column(0))
                dense, h, first = _features(data, at)
                z = dense @ m["dense"] + _word_scores(m["words"], _slots(m["known"], h), first) + m["bias"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                found += list(p / p.sum(axis=1, keepdims=True))
                tokens += np.diff(word_spans(data, at, WHITESPACE)[2]).tolist()
            yield pd.DataFrame({"tokens": pd.Series(tokens, dtype="int64"), "p": pd.Series(found, dtype=object)})

    return docs.withColumn("__mix", column_udf("tokens long, p array<double>", run)(F.col(text)))


def _rate(step: np.ndarray, p: str = "p") -> Column:
    """The rate after a step from one, projected on the nonnegative."""
    return F.greatest(F.lit(0.0), sum((F.col(p)[i] * float(v) for i, v in enumerate(step)), F.lit(1.0)))


def _at(table: DataFrame, points: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each sum of steps: expected tokens, Gram matrix of the documents that aren't at zero, half the squared rates; all in one pass."""
    k = len(points[0])
    tried = F.array(*(F.struct(F.lit(n).alias("n"), F.array(*(F.lit(float(v)) for v in x)).alias("x")) for n, x in enumerate(points)))
    rated = table.select("tokens", "p", F.explode(tried).alias("s")).select("tokens", "p", F.col("s.n").alias("n"), F.greatest(F.lit(0.0), sum((F.col("p")[i] * F.col("s.x")[i] for i in range(k)), F.lit(1.0))).alias("r"))
    rows = rated.withColumn("free", (F.col("r") > 0).cast("double")).groupBy("n").agg(
        F.sum(F.col("tokens") * F.col("r") * F.col("r") / 2).alias("v"),
        *(F.sum(F.col("tokens") * F.col("r") * F.col("p")[i]).alias(f"t{i}") for i in range(k)),
        *(F.sum(F.col("tokens") * F.col("free") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)),
    )
    found = {r["n"]: r for r in rows.collect()}
    out = []
    for n in range(len(points)):
        r = found[n]
        out.append((np.array([r[f"t{i}"] for i in range(k)]), np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]), r["v"]))
    return out


def fit_rates(table: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The summed gradient steps, as weights of the domains, that bring the expected tokens of ``table`` (tokens, p) to ``wanted``.

    The gradient of half the squared miss by a document's rate is its tokens times its posterior times the miss.  Scaled by
    1 / tokens it depends on the posterior alone, so a rate is a function of the posterior and of the sum of all steps, and nothing is
    kept for a document.  The sum is projected anew after each step (lazy projection): of all rates that meet the targets,
    the limit has those nearest to one.  It is the least point of a convex function, half the squared rates less the sum times ``wanted``,
    whose gradient is the miss.  Each pass tries six lengths of a Newton step on it and takes the best; a pull towards an earlier point,
    weakened whenever the fit has settled, keeps the step finite where nothing meets the targets.

    It ends when the targets are met, or when the projected gradient proves that no rates come notably nearer: then, or if neither comes
    within PASSES, a warning tells the remaining miss.
    """
    k, all_of = len(wanted), float(np.abs(wanted).sum())
    if not all_of or not (table.agg(F.sum("tokens")).first()[0] or 0):
        return np.zeros(k)
    share = wanted / all_of
    at = centre = np.zeros(k)
    pull, why = LOOSEST, f"not settled in {PASSES} passes"
    sums, gram, _ = _at(table, [at])[0]
    for _ in range(PASSES):
        miss = share - sums / all_of
        if np.abs(miss).sum() <= CLOSE:
            return at
        least = max(1e-4 * float(miss @ miss), CLOSE**2)  # of the squared miss, what more passes might still gain
        used = abs(float(miss @ sums)) / all_of
        if used <= least:  # the free documents gain nothing by a common factor; now the others
            unused = table.where("tokens > 0").agg(F.max(sum((F.col("p")[i] * float(v) for i, v in enumerate(miss)), F.lit(0.0)))).first()[0]
            if used + max(0.0, unused) * k**0.5 <= least:
                why = "the targets can't be met"
                break
        slope = pull * (at - centre) - miss
        if np.abs(slope).sum() <= 0.05 * np.abs(miss).sum():
            centre, pull, slope = at, max(pull / 10, TIGHTEST), -miss
        step = np.linalg.solve(gram / all_of + pull * np.eye(k), -slope)
        points = [at + step / 4.0**i for i in range(6)]
        tried = _at(table, points)
        height = [t[2] / all_of - float(share @ x) + pull / 2 * float(((x - centre) ** 2).sum()) for t, x in zip(tried, points, strict=True)]
        best = int(np.argmin(height))
        at, (sums, gram, _) = points[best], tried[best]
    warnings.warn(f"mixing: {why}; shares wanted {share.round(6).tolist()}, got {(sums / all_of).round(6).tolist()}", stacklevel=2)
    return at


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, key: str = "doc_id", text: str = "text", domain: str = "domain") -> DataFrame:
    """``docs`` with n_tokens, p_<domain> of each target, rate, and copies (columns of those names are replaced).

    ``targets`` are the shares of all tokens wanted from each domain; they are scaled to one, so the mix keeps its size.  ``copies`` is the
    rate rounded up or down by a hash of the key, on average the rate.  A null or empty text has no tokens, a posterior
    like any other and, as it can't bring any target nearer, rate one.  Targets that can't be met (a domain without mass) are met as nearly
    as any rates come, with a warning of the miss.  Repeated rows
    are rated alike, a null key rounds like a key of its own, an empty table gives an empty one.
    """
    names = sorted(targets)
    model = fit(labelled, names, key, text, domain)
    scored = posteriors(docs, model, text)
    table = cut(scored.select("__mix.tokens", "__mix.p"))
    total = table.agg(F.sum("tokens")).first()[0] or 0
    share = np.array([max(0.0, targets[d]) for d in names])
    step = fit_rates(table, total * share / max(share.sum(), 1e-300)) if total else np.zeros(len(names))
    made = ("n_tokens", *(f"p_{d}" for d in names), "rate", "copies")
    out = scored.withColumn("__rate", F.when(F.col("__mix.tokens") > 0, F.round(_rate(step, "__mix.p"), 9)).otherwise(1.0))
    luck = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return out.select(
        *(c for c in docs.columns if c not in made),
        F.col("__mix.tokens").alias("n_tokens"),
        *(F.round(F.col("__mix.p")[i], 9).alias(f"p_{d}") for i, d in enumerate(names)),
        F.col("__rate").alias("rate"),
        (F.floor("__rate") + (luck < F.col("__rate") - F.floor("__rate")).cast("long")).cast("long").alias("copies"),
    )


def labelled_documents(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """(doc_id, text, domain) of the labelled documents: toxic, good or plain."""
    labels = load(spark, folder, "labels").where("toxic IS NOT NULL OR quality IS NOT NULL")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain")
    return with_place(docs.select("doc_id", "text"), "doc_id", "text").join(labels.select("doc_id", domain.alias("domain")), "doc_id")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return mix(docs, labelled_documents(spark, folder, docs)).drop("text")
