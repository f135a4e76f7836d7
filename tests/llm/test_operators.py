"""The operators against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import warnings
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _bytes, _components, _windows, decontaminate, embedding_dedup, language_id, minhash, mixing, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter
from corpusloom.llm._components import components
from corpusloom.llm._spark import labelled_sample, with_place

from ..conftest import DATA

SMALL = str(DATA / "sf0.01")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- kernels


def test_words_and_grams():
    some = ["a bb  ccc", "", "bb a bb ccc", "é\x0bé"]
    data, at = _bytes.texts(pa.array(some))
    h, s, e, first = _bytes.words(data, at)
    split = [w for t in some for w in t.encode().split()]
    assert [data[a:b].tobytes() for a, b in zip(s, e, strict=True)] == split
    assert len(set(h.tolist())) == len(set(split)) and first.tolist() == [0, 3, 3, 7, 9]
    x = np.array([1, 2, 3, 1, 2, 3, 1], np.uint64)
    for n in range(1, 8):
        g = _bytes.grams(x, n)
        assert len(g) == 8 - n
        same = [[tuple(x[i : i + n]) == tuple(x[j : j + n]) for j in range(8 - n)] for i in range(8 - n)]
        assert (np.equal.outer(g, g) == np.array(same)).all()


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(55)] + [(i, i + 1) for i in range(100, 140)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert found == {v: root(v) for v in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- tokens


def test_token_counts_match_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    got = {r["doc_id"]: r for r in token_counts.op2_token_counts(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(sp.encode(t)) for k, t in texts.items()}
    assert all(got[k]["n_bytes"] == len(t.encode()) and got[k]["over_limit"] == (got[k]["n_tokens"] > 4096) for k, t in texts.items())


def test_tokens_proven_once(spark, monkeypatch):
    """The vocabulary is proven before texts are read, once for however many tasks and calls."""
    calls = []
    plain = token_counts.prove
    monkeypatch.setattr(token_counts, "prove", lambda proto: calls.append(1) or plain(proto))
    token_counts._proof.cache_clear()
    docs = spark.createDataFrame([(i, "two words") for i in range(20)], "doc_id long, text string").repartition(5)
    for _ in range(2):
        assert {r["n_tokens"] for r in token_counts.count_tokens(docs, token_counts.default_model()).collect()} == {2}
    assert len(calls) == 1


def test_token_counts_of_odd_texts():
    with open(token_counts.default_model(), "rb") as f:
        counter = token_counts.WholeTokens(f.read())
    assert counter.proven and counter.feed and len(counter.whole) > 10_000
    random.seed(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "▁", "the", "Zürich", "中", "\x00", "😀", "<s>", "<unk>", "\r\n", "word ", "　", "<0x0A>"]
    for _ in range(3000):
        t = "".join(random.choices(parts, k=random.randint(0, 12)))
        assert counter.count(t) == len(counter.library.encode(t)), t


# --- repeated passages


def digest(rows, *columns):
    return {r["doc_id"]: (*(r[c] for c in columns), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in rows.collect()}


def passages(symbols, extra, seed):
    random.seed(seed)
    base = random.choices(symbols, k=700)
    out = []
    for i in range(50):
        a, b = sorted(random.sample(range(700), 2))
        out.append((i, base[a:b] + random.choices(extra, k=random.randint(0, 80)) + base[b - 100 :] * random.randint(0, 2)))
    return out


@pytest.mark.parametrize("threshold", [7, 20, 100])
def test_suffix_dedup(spark, threshold):
    rows = [(k, "".join(t)) for k, t in passages("abcdé ", "xyz ", 3)] + [(100, "ab" * 400), (101, "ab" * 300), (102, ""), (103, None), (104, "q" * 99), (105, "q" * 100), (106, "q" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digest(suffix_dedup.deduplicated(df, threshold=threshold), "n_bytes", "n_removed", "n_spans") == suffix_dedup.brute_force(rows, threshold)


def test_suffix_dedup_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op7_suffix_dedup(spark, SMALL).collect()}
    assert got == suffix_dedup.brute_force(rows)


@pytest.mark.parametrize(("window", "shard"), [(35, 400), (9, 400), (35, 3), (9, 2)])
def test_substring_dedup(spark, window, shard):
    rows = [(k, " ".join(t)) for k, t in passages(["a", "b", "cé", "d\x85", "xx"], ["u", "v", "w"], 3)] + [(100, "ab " * 400), (101, "ab\t" * 36), (102, ""), (103, None), (104, "q " * 34), (105, "r " * 35), (106, "s " * 36), (107, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digest(substring_dedup.deduplicated(df, window=window, shard_passages=shard), "n_words", "n_removed") == substring_dedup.brute_force(rows, window)


def test_frequent_digits(spark, monkeypatch):
    """A sentence that many documents share, in texts that differ around it: it is dealt by content, with the same result."""
    monkeypatch.setattr(_windows, "FREQUENT_LEAST", 8)
    rng = random.Random(7)
    common = "this one sentence stands in very many of the documents of the corpus and is longer than a hundred bytes by far, as it should be, with some more words put in to make it thirty-five words long and more"
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(5, 40))), common, *(word() for _ in range(rng.randint(5, 40)))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    base = _windows.numbered(df, "doc_id", "text")
    runs, cores = _windows.frequent(base, suffix_dedup._symbols, _windows.Depth(100, 32, later=True))
    assert runs and cores
    assert digest(suffix_dedup.deduplicated(df), "n_bytes", "n_removed", "n_spans") == suffix_dedup.brute_force(rows)
    assert digest(substring_dedup.deduplicated(df), "n_words", "n_removed") == substring_dedup.brute_force(rows)
    records = _windows.map_runs(base, suffix_dedup._symbols, _windows.Depth(100, 32, later=True))
    dealt = _windows.resolve(records, later=True, apart=True, hot=runs).withColumn("part", F.spark_partition_id()).where(F.col("ah").isin(runs))
    assert dealt.select("part").distinct().count() > 1


def test_suffix_automaton():
    random.seed(5)
    texts = [random.choices("ab", k=random.randint(3, 14)) for _ in range(6)]
    a = substring_dedup.SuffixAutomaton(texts)
    for n in (1, 2, 3, 5):
        counts: dict = {}
        for t in texts:
            for i in range(len(t) - n + 1):
                counts[tuple(t[i : i + n])] = counts.get(tuple(t[i : i + n]), 0) + 1
        for t in texts:
            assert a.repeated(t, n) == [i for i in range(len(t) - n + 1) if counts[tuple(t[i : i + n])] > 1]


# --- near-duplicates


def brute_links(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize(("block", "broadcast", "one", "pairs"), [(minhash.BLOCK_SHINGLES, minhash.BROADCAST_IDS, _components.ONE_PARTITION, minhash.PAIRS_A_SET), (300, 0, 0, 3)])
def test_minhash(spark, monkeypatch, block, broadcast, one, pairs):
    """Against all pairs of sets; also where every bound on a broadcast, a partition or a block is exceeded."""
    random.seed(5)
    base, rows = [f"W{i}" for i in range(60)], []
    for i in range(150):
        t = list(base[: random.choice([60, 60, 40])])
        for _ in range(random.randint(0, 6)):
            t[random.randrange(len(t))] = random.choice("xyzuv")
        rows.append((i * 3, " ".join(t)))
    rows += [(1000, ""), (1001, None), (1002, "a b"), (1003, "A  b"), (1004, "a"), (1005, " "), (1006, "a b c d"), (1007, "a b c D"), (1, rows[9][1])]
    monkeypatch.setattr(minhash.across, "__defaults__", (block,))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(minhash, "PAIRS_A_SET", pairs)
    monkeypatch.setattr(_components, "ONE_PARTITION", one)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[2:] for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == brute_links(rows, 4, 80)


def test_pairs_of_one_set_are_dealt(spark, monkeypatch):
    """Also where tables that are dealt by v alone would do for the join."""
    monkeypatch.setattr(minhash, "PAIRS_A_SET", 50)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.adaptive.enabled")}
    for c, v in zip(before, ("-1", "false", "false"), strict=True):
        spark.conf.set(c, v)
    try:
        pairs = spark.range(1, 1001).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
        table = spark.range(0, 1001).select(F.col("id").alias("node"), (F.col("id") * 2).alias("x"))
        rows = minhash._beside(pairs, table).select("u", "v", "xu", "xv", F.spark_partition_id().alias("at")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r["u"], r["v"], r["xu"], r["xv"]) for r in rows) == [(i, 0, 2 * i, 0) for i in range(1, 1001)]
    assert len({r["at"] for r in rows}) > 3


@pytest.mark.parametrize("block", [20, 200, 5000])
def test_groups_are_dealt_in_blocks_and_parts(spark, block):
    """Components of one group, against all pairs of sets, whether those outside the largest are few or most."""
    rng = random.Random(block)
    for lone in (3, 40):
        sets = [sorted(rng.sample(range(14), 10)) for _ in range(45 + lone)]
        component = [0] * 45 + list(range(1, lone + 1))
        members = spark.createDataFrame([(i, 10, c, 7) for i, c in enumerate(component)], "node long, n long, component long, group long")
        got = minhash.across(spark.createDataFrame(list(enumerate(sets)), "node long, set array<long>"), members, 80, block).collect()
        linked = [(component[i], component[j]) for i in range(len(sets)) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 80 * len({*sets[i]} | {*sets[j]})]

        def joined(links):
            top = list(range(lone + 1))
            for _ in range(lone + 1):
                for a, b in links:
                    top[a] = top[b] = min(top[a], top[b])
            return top

        assert joined([(r["u"], r["v"]) for r in got]) == joined(linked)


def test_minhash_rows_of_one_id(spark):
    near, far = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, near), (5, near + " x"), (5, far), (5, far), (7, far + " y"), (9, near), (9, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 1, False), (9, 9, True)]


def test_signatures_agree_as_sets_do():
    rng = random.Random(4)
    least, worst = minhash.least_agreement(80), 1.0
    texts = []
    for _ in range(150):
        words = [f"w{rng.random()}" for _ in range(100)]
        texts += [" ".join(words), " ".join(words[:89]), " ".join(words[:30])]  # 0.89 and 0.28 of the single words
    h, at = minhash.shingles(pa.record_batch([pa.array(texts)], ["text"]), 1)
    signature, _ = minhash.minima(h, at)
    agree = lambda i, j: int((signature[i] == signature[j]).sum())
    for i in range(0, len(texts), 3):
        assert agree(i, i + 1) >= least > agree(i, i + 2)
        worst = min(worst, agree(i, i + 1) / signature.shape[1])
    assert worst < 0.89


def test_embeddings_hard_pairs(spark):
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=a.shape)
    z = unit(z - (z * a).sum(1)[:, None] * a)
    c = rng.uniform(0.9, 0.95, size=(1500, 1))
    v = np.concatenate((a, c * a + np.sqrt(1 - c * c) * z, np.repeat(a[:1], 1300, 0) + 0.01 * rng.normal(size=(1300, 64))))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).orderBy("vec_id").toPandas()
    u = unit(v)
    true = u @ u.T >= 0.9
    np.fill_diagonal(true, False)
    n = true.sum(1)
    assert (got.n_links.to_numpy() <= n).all() and got.n_links.sum() / n.sum() > 0.99  # the large group spans several blocks


def test_embeddings_many_pivots(spark):
    """The measured recall at the most pivots, of pairs right above the threshold."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(rng.normal(size=(10_000, 64)))
    z = rng.normal(size=a.shape)
    z = unit(z - (z * a).sum(1)[:, None] * a)
    c = rng.uniform(0.9, 0.91, size=(10_000, 1))
    b = c * a + np.sqrt(1 - c * c) * z
    pivots = unit(rng.normal(size=(embedding_dedup.PIVOTS[1], 64)))
    near = [embedding_dedup._describe(x, pivots) for x in (a, b)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).sum(axis=(1, 2))
    assert (shared >= embedding_dedup.SHARED).mean() > 0.96


def test_equal_embeddings(spark):
    """Equal vectors count one link with each other and with whatever one of them is linked with."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(i, [1.0, 0.2, 0.0]) for i in range(30, 50)] + [(50, [0.0, 0.0, 1.0]), (51, [1.0, 0.5, 0.0])]
    got = {r["vec_id"]: tuple(r)[1:3] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(links.tolist()))
    assert {v[1] for k, v in got.items() if k != 50} == {0}


# --- filters and classifiers


def fits(rule, host, path):
    name, _, start = rule.partition("/")
    return (host == name or host.endswith("." + name)) and path.startswith("/" + start)


def test_url_filter(spark):
    rows = url_filter.op5_url_filter(spark, SMALL).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = plain_split(urls[r["page_id"]])
        found = sorted((x for x in url_filter.RULES if fits(x[1], host, path)), key=lambda x: -len(x[1]))
        assert (r["host"], r["path"], r["rule"]) == (host, path, found[0][1] if found else None)
        assert r["verdict"] == (found[0][0] if found else "block" if r["score"] >= 0.5 else "allow")


def plain_split(url):
    """Host and path, character by character."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host, path, rest = "", "", list(url[at + 3 :])
    while rest and rest[0] not in "/?#":
        c = rest.pop(0)
        host += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    while rest and rest[0] not in "?#":
        path += rest.pop(0)
    return host, path


def test_url_scores(spark):
    """The score of each page is the logistic function of its n-grams' weights, got one by one."""
    w, b = url_filter.fit([(*url_filter.split_url(u), y) for u, y in url_filter.LABELLED])
    for r in url_filter.op5_url_filter(spark, SMALL).limit(200).collect():
        grams = set()
        for tag, part in (("h", "^" + r["host"] + "$"), ("p", "^" + r["path"] + "$")):
            for n in (3, 4, 5):
                grams |= {tag + part[i : i + n] for i in range(len(part)) if i + n <= len(part) or i == 0}
        at = {zlib.crc32(g.encode()) % url_filter.SLOTS for g in grams}
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(w[i] for i in at) / math.sqrt(len(at)) - b)), abs=1e-9)


def test_url_hosts_held_out():
    """Ten times a tenth of the table's hosts is held out whole: they are told by the words that they share with others."""
    table = [(*url_filter.split_url(u), y) for u, y in url_filter.LABELLED]
    part = lambda host: zlib.crc32(re.sub(r"^(www|m|blog|news|cdn)\.|\.[a-z]+$", "", host).encode()) % 10
    right = {0: [], 1: []}
    for p in range(10):
        w, b = url_filter.fit([x for x in table if part(x[0]) != p])
        for host, _, y in (x for x in table if part(x[0]) == p):
            at = url_filter.slots(host, "/")
            right[y].append((w[at].sum() / np.sqrt(len(at)) + b >= 0) == bool(y))
    assert np.mean(right[0]) > 0.9 and np.mean(right[1]) > 0.9


def test_url_model():
    """Hosts that the table doesn't have are told by their words, whatever the path."""
    w, b = url_filter.fit([(*url_filter.split_url(u), y) for u, y in url_filter.LABELLED])
    known = {url_filter.split_url(u)[0].rsplit(".", 1)[0] for u, _ in url_filter.LABELLED}

    def blocked(host, path):
        at = url_filter.slots(host, path)
        return w[at].sum() / np.sqrt(len(at)) + b >= 0

    for host in ("online-casino24.com", "cheap-viagra.net", "pills-discount.org", "payday-loans.com", "free-poker-bonus.info", "sexcams.net", "spam-mailing.com", "win-an-iphone.com"):
        assert host.rsplit(".", 1)[0] not in known and blocked(host, "/en/1"), host
    for host in ("www.national-library.org", "blog.martha.net", "gazette.com", "m.history-today.com", "en.encyclopedia.org", "cathedral.info", "village-school.org", "astronomy.net"):
        assert host.rsplit(".", 1)[0] not in known and not blocked(host, "/article/7"), host


def test_url_rules(spark):
    urls = ["http://example.net/en/1", "http://xexample.net/en/1", "http://net", "http://net/", "http://a.example.com/de/", "http://example.com/dex", "http://a.org/fr/x", "http://a.organ/fr/x", "HTTP://A.ORG/fr/#x", "http://a.org/FR/", "x://y://z/", "http://b.net?u=http://c.net/d", "http://b.net#/e"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"]) for r in url_filter.filter_urls(df).collect()}
    assert [got[i][1] for i in range(len(urls))] == ["example.net/en/", "net/", None, "net/", "example.com/de/", None, "org/fr/", None, "org/fr/", None, None, None, None]
    assert got[8][0] == "a.org" and got[10][0] == "y:"


def test_language_id(spark):
    rows = language_id.op9_language_id(spark, SMALL).join(documents(spark).select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_backoff():
    model = {"langs": ["a", "b"], "words": {"cat": 0}, "grams": {"^": 0, "^d": 1, "og$": 2}, "word_logs": np.array([[-1.0, -5.0]]), "gram_logs": np.array([[-1.0, -1.0], [-4.0, -2.0], [-1.0, -9.0]])}
    s = language_id.Scorer(model)
    assert s.score("Cat")[0] == "a"
    assert s.backoff("dog") == pytest.approx(np.array([-1.0, -9.0]) * 3 / 5)  # the longest known n-gram decides
    assert s.backoff("dx") == pytest.approx(np.array([-4.0, -2.0]) * 2 / 5)
    assert s.score("12 !") == ("und", 0.0)


def plain_toxicity(model, text):
    """The network on one window after the other, in loops over steps and units."""
    m, size = {k: v.astype(float) for k, v in model["net"].items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    words = re.findall(r"[a-z0-9]+", text.lower())
    hashes = [int(_bytes.words(*_bytes.texts(pa.array([w], pa.large_string())), _bytes.NOT_WORD, lower=True)[0][0]) for w in words]
    known = {int(h): i for i, h in enumerate(model["known"])}

    def entry(word, h):
        marks = [256, *word.encode(), 257]
        slots = [((a * 66049 + b * 257 + c) * 0x9E3779B1 >> 7) % toxicity.CHAR_SLOTS for a, b, c in zip(marks, marks[1:], marks[2:])]
        return [*m["E"][known.get(h, len(known))], *(sum(m["C"][s][j] for s in slots) / len(slots) for j in range(toxicity.CHAR_DIM))]

    def states(xs, way):
        h, out = [0.0] * size, []
        for x in xs:
            gate = lambda j: sum(v * m[way + "P"][i][j] for i, v in enumerate(x)) + m[way + "b"][j]  # noqa: B023, E731
            back = lambda j: sum(v * m[way + "U"][i][j] for i, v in enumerate(h))  # noqa: B023, E731
            z, r = [sigmoid(gate(j) + back(j)) for j in range(size)], [sigmoid(gate(size + j) + back(size + j)) for j in range(size)]
            n = [math.tanh(gate(2 * size + j) + r[j] * back(2 * size + j)) for j in range(size)]
            h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(size)]
            out.append(h)
        return out

    def logit(xs):
        if not xs:
            return float(m["b"][0])
        s = [f + b for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = [sum(math.tanh(sum(x * m["A"][i][j] for i, x in enumerate(row)) + m["a"][j]) * m["v"][j] for j in range(toxicity.ATTENTION)) for row in s]
        weight = [math.exp(x) / sum(map(math.exp, e)) for x in e]
        return sum(a * sum(x * m["w"][i] for i, x in enumerate(row)) for a, row in zip(weight, s, strict=True)) + float(m["b"][0])

    xs = [entry(w, h) for w, h in zip(words, hashes, strict=True)]
    starts = range(0, max(1, len(xs) - (toxicity.WINDOW - toxicity.STRIDE)), toxicity.STRIDE)
    scale, shift = model["calibration"]
    return sigmoid(scale * max(logit(xs[a : a + toxicity.WINDOW]) for a in starts) + shift)


def test_toxicity():
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]

    def text(bad):
        t = rng.choices(plain, k=rng.randint(3, 150))
        if bad:
            t[rng.randrange(len(t))] = rng.choice(["nasty", "vile", "grim" + rng.choice("abc")])
        return " ".join(t)

    labels = [i % 3 == 0 for i in range(900)]
    texts = [text(b) for b in labels]
    model = toxicity.fit_texts(texts[:700], [int(b) for b in labels[:700]])
    data, at = _bytes.texts(pa.array(texts[700:]))
    p = toxicity.text_scores(model, data, at) >= 0.5
    y = np.array(labels[700:])
    assert (p == y).mean() > 0.95
    # one bad word anywhere in a long text is seen: all windows are scored
    long = [" ".join(rng.choices(plain, k=3000)) for _ in range(6)]
    worse = [" ".join([*t.split()[: 500 * i], "vile", "nasty", *t.split()[500 * i :]]) for i, t in enumerate(long)]
    s = toxicity.text_scores(model, *_bytes.texts(pa.array(long + worse)))
    assert (s[6:] > s[:6]).all()


def test_toxicity_scores_by_the_book():
    """A text's score is that of the plain network, unit by unit and step by step, on its best window."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    some = [" ".join(rng.choices(plain, k=rng.randint(3, 60)) + (["vile"] if i % 3 == 0 else [])) for i in range(240)]
    model = toxicity.fit_texts(some, [int(i % 3 == 0) for i in range(240)])
    tried = [*some[:12], "", "new words only", "Vile w1 vile", " ".join(plain)]
    found = toxicity.text_scores(model, *_bytes.texts(pa.array(tried)))
    assert found == pytest.approx([plain_toxicity(model, t) for t in tried], abs=2e-3)


def test_labelled_sample(spark):
    """Long texts are as likely as others, bounds hold, rows repeated in full are taken once and counted each."""
    rows = [(str(i), "x" * (30_000 if i % 10 == 0 else 10), i % 2) for i in range(400)] + [("same", "text", 0)] * 300 + [("huge", "y" * 500_000, 1)]
    df = with_place(spark.createDataFrame(rows, "k string, t string, y int").repartition(5), "k", "t")
    found, sizes = labelled_sample(df, "y", 10_000, 100_000_000)
    assert sizes == {0: 500, 1: 201} and [(r["k"], r["t"], r["y"]) for r in found] == sorted(set(rows))
    found, sizes = labelled_sample(df, "y", 50, 400_000)
    for y in (0, 1):
        mine = [r for r in found if r["y"] == y]
        assert 0 < len(mine) <= 50 and sum(len(r["t"]) for r in mine) <= 400_000
    assert any(len(r["t"]) > 10_000 for r in found) and "huge" not in {r["k"] for r in found}
    assert [tuple(r) for r in labelled_sample(df.repartition(3), "y", 50, 400_000)[0]] == [tuple(r) for r in found]
    assert labelled_sample(df.limit(0), "y", 50, 400_000) == ([], {})


def test_toxicity_gradient():
    rng = np.random.default_rng(1)
    net = toxicity.start(rng, 0)
    inputs = [rng.normal(size=(2, 3 * toxicity.HIDDEN)) for _ in range(4)]
    mask = np.array([[1, 1], [1, 1], [1, 0], [0, 0]], np.float32)
    weights = rng.normal(size=(4, 2, toxicity.HIDDEN))
    u = net["fU"].astype(float)
    states, cache = toxicity._gru(inputs, mask, u, True)
    by_input, by_weight = toxicity._gru_back(weights.astype(np.float32), cache, u)
    f = lambda x, w: float((toxicity._gru(x, mask, w, False)[0] * weights).sum())
    for t, b, j in ((0, 0, 3), (1, 1, 9), (2, 0, 20)):
        up = [x.copy() for x in inputs]
        up[t][b, j] += 1e-3
        down = [x.copy() for x in inputs]
        down[t][b, j] -= 1e-3
        assert (f(up, u) - f(down, u)) / 2e-3 == pytest.approx(by_input[t, b, j], abs=2e-3)
    d = np.zeros_like(u)
    d[2, 5] = 1e-3
    assert (f(inputs, u + d) - f(inputs, u - d)) / 2e-3 == pytest.approx(by_weight[2, 5], abs=5e-3)


def test_decontaminate(spark):
    items = spark.createDataFrame([(7, "one two three"), (10, " ".join(f"b{i}" for i in range(20))), (11, None), (12, "...")], "item_id long, text string")
    rows = [(1, "Zero ONE,two-three four"), (2, " ".join(f"B{i}" for i in range(3, 17)) + " x" * 300), (3, " ".join(f"b{i}" for i in range(12))), (4, "one two"), (5, None), (6, "one two three " * 2), (7, "one two three" + " y" * 57), (8, "one two three" + " y" * 58)]
    got = {r["doc_id"]: r for r in decontaminate.judged(decontaminate.find_hits(spark.createDataFrame(rows, "doc_id long, text string"), items)).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) for i in range(1, 9)] == [
        (5, 3, ["7"], True), (314, 14, ["10"], False), (12, 0, [], False), (2, 0, [], False), (0, 0, [], False), (6, 6, ["7"], True), (60, 3, ["7"], True), (61, 3, ["7"], False),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, items).collect()) == [2, 3, 4, 5, 8]
    plan = decontaminate.op10_decontaminate(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontaminate_in_parts(spark, monkeypatch):
    """More windows than one broadcast takes, and more documents with hits: the same result."""
    wanted = {r["doc_id"]: tuple(r) for r in decontaminate.op10_decontaminate(spark, SMALL).collect()}
    monkeypatch.setattr(decontaminate, "HASHES_A_SCAN", 700)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["doc_id"]: tuple(r) for r in decontaminate.op10_decontaminate(spark, SMALL).collect()} == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_decontaminate_a_long_text(spark):
    item = " ".join(f"b{i}" for i in range(20))
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("some words of a text. "), 230_000), F.lit(item)).alias("text"))
    r = decontaminate.judged(decontaminate.find_hits(df, spark.createDataFrame([(1, item)], "item_id long, text string"))).first()
    assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (1_150_020, 20, ["1"], False)


def test_mixing(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((1, 0.4, 0.2), 2000)
    table = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(rng.integers(0, 900, 2000), p, strict=True)], "tokens long, p array<double>")
    n = np.array([r["tokens"] for r in table.collect()])
    for target in ((0.4, 0.3, 0.3), (0.05, 0.05, 0.9)):  # the second can be met only with some rates at zero
        wanted = n.sum() * np.array(target)
        step = mixing.fit_rates(table, wanted)
        rate = np.maximum(0, 1 + p @ step)
        assert (n * rate) @ p == pytest.approx(wanted, rel=1e-4)
    assert (rate == 0).any()


def nearest(a, b):
    """Nonnegative least squares by Lawson and Hanson: how near a @ x comes to b."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(1000):
        g = np.where(on, -1, a.T @ (b - a @ x))
        if g.max() <= 1e-12 * np.abs(b).sum() * np.abs(a).max():
            break
        on[np.argmax(g)] = True
        while True:
            z = np.zeros(len(x))
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z[on] > 0).all():
                x = z
                break
            bad = on & (z <= 0)
            x = x + (x[bad] / (x[bad] - z[bad])).min() * (z - x)
            on &= x > 1e-14
            x[~on] = 0
    return np.linalg.norm(b - a @ x)


@pytest.mark.parametrize(("kind", "met"), [((25, 4, 8), True), ((60, 6, 6), True), ((20, 5, 5), True), ((200, 2, 2), False)])
def test_mixing_of_soft_posteriors(spark, kind, met):
    """Few telling labels, or a corpus mostly of one domain: as near as nonnegative least squares."""
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet(kind, 20_000), rng.integers(0, 900, 20_000)
    table = spark.createDataFrame(pd.DataFrame({"tokens": n, "p": p.tolist()}), "tokens long, p array<double>")
    wanted = np.array([0.78, 0.17, 0.05])
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        rate = np.maximum(0, 1 + p @ mixing.fit_rates(table, n.sum() * wanted))
    miss = np.linalg.norm((n * rate) @ p / n.sum() - wanted)
    least = nearest(p.T * n / n.mean(), wanted)
    assert (least < 1e-9) == met
    assert miss == pytest.approx(least, rel=1e-3, abs=1e-6)
    assert any("can't be met" in str(w.message) for w in told) == (not met)


def test_mixing_classifier(spark):
    docs = documents(spark).select("doc_id", "text")
    out = mixing.mix(docs, mixing.labelled_documents(spark, SMALL, docs))
    sums = out.agg(F.sum("n_tokens").alias("all"), *(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS)).first()
    for d, share in mixing.TARGETS.items():
        assert sums[d] / sums["all"] == pytest.approx(share, rel=1e-3)
    assert out.where("rate < 0 OR abs(copies - rate) >= 1").count() == 0
