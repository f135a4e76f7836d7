from __future__ import annotations

import random
from collections import deque

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from corpusloom.operators import graph, linkpred, mentions, walks
from corpusloom.session import Scratch

from .conftest import rows


def table(spark, n, pairs):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), graph.canonical(spark.createDataFrame(pairs, "src long, dst long"))


@pytest.fixture(scope="module")
def example(spark):
    random.seed(4)
    n = 24
    pairs = list({(min(a, b), max(a, b)) for a, b in ((random.randrange(n - 4), random.randrange(n - 4)) for _ in range(34)) if a != b})
    near = {i: set() for i in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    return n, near, table(spark, n, [*pairs, (pairs[0][1], pairs[0][0]), (1, 1)])


def distances(near, s):
    seen, queue = {s: 0}, deque([s])
    while queue:
        v = queue.popleft()
        for w in near[v]:
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def test_degrees_and_summary(example):
    n, near, (v, e) = example
    assert {r["id"]: r["degree"] for r in graph.degrees(v, e).collect()} == {i: len(x) for i, x in near.items()}
    s = graph.summary(v, e).first()
    assert s["nodes"] == n and 2 * s["edges"] == sum(map(len, near.values()))
    assert s["mean_degree"] == round(2 * s["edges"] / n, 6)


def test_paths_and_components(example):
    n, near, (v, e) = example
    wanted = {(s, t): d for s in near for t, d in distances(near, s).items() if d}
    found = {(r["src"], r["dst"]): r["dist"] for r in graph.shortest_paths(e).collect()}
    assert found == wanted
    assert all(found[b, a] == d for (a, b), d in found.items())
    assert {r["id"]: r["component"] for r in graph.components(v, e).collect()} == {i: min(distances(near, i)) for i in near}


def test_long_chain(spark):
    v, e = table(spark, 40, [(i, i + 1) for i in range(39)])
    assert {r["component"] for r in graph.components(v, e).collect()} == {0}
    assert graph.pair_distance(e, spark.createDataFrame([(0, 39), (3, 3)], "src long, dst long")).where("src = 0").first()["dist"] == 39


def test_pair_distance_from_both_ends(spark, example, monkeypatch):
    """Distances are those of whole searches, and frontiers have fewer rows."""
    n, near, (v, e) = example
    pairs = [(a, b) for a in near for b in near if (a * 7 + b) % 5 == 0] + [(3, 3), (0, n - 1)]
    df = spark.createDataFrame(pairs + pairs[:3], "src long, dst long")
    got = [tuple(r) for r in graph.pair_distance(e, df).collect()]
    assert sorted(got) == sorted((a, b, distances(near, a).get(b, 10)) for a, b in pairs + pairs[:3])
    assert {tuple(r)[2] for r in graph.pair_distance(e, df, most=2).collect()} == {0, 1, 2, 10}
    assert graph.pair_distance(e, df.limit(0)).count() == 0
    _, tree = table(spark, 255, [(i, (i - 1) // 2) for i in range(1, 255)])
    seen = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: seen.append(keep(self, df)) or seen[-1])
    leaves = spark.createDataFrame([(200, 250), (130, 131), (254, 1)], "src long, dst long")
    assert rows(graph.pair_distance(tree, leaves)) == [(130, 131, 6), (200, 250, 12), (254, 1, 8)]
    monkeypatch.undo()
    whole = graph.shortest_paths(tree, leaves.select(F.col("src").alias("id")).distinct()).count()
    assert whole == 3 * 254


def test_paths_have_no_bound(spark):
    _, e = table(spark, 71, [(i, i + 1) for i in range(70)])
    starts = spark.createDataFrame([(0,)], "id long")
    assert {r["dst"]: r["dist"] for r in graph.shortest_paths(e, starts).collect()} == {i: i for i in range(1, 71)}
    assert {r["dst"]: r["dist"] for r in graph.shortest_paths(e, starts, 3).collect()} == {1: 1, 2: 2, 3: 3}


def test_clustering(example):
    n, near, (v, e) = example
    for r in graph.clustering(v, e).collect():
        x = near[r["id"]]
        t = sum(1 for a in x for b in x if a < b and b in near[a])
        assert r["triangles"] == t
        assert r["clustering"] == pytest.approx(2 * t / (len(x) * (len(x) - 1)) if len(x) > 1 else 0)


def test_betweenness(spark):
    v, e = table(spark, 5, [(0, 1), (1, 2), (2, 3), (1, 4)])
    found = {r["id"]: r["betweenness"] for r in graph.betweenness(v, e).collect()}
    assert found == pytest.approx({0: 0, 1: 5 / 6, 2: 3 / 6, 3: 0, 4: 0})


def brandes(near):
    """Betweenness by one walk from each vertex."""
    out = dict.fromkeys(near, 0.0)
    for s in near:
        order, before, paths, dist, queue = [], {}, {s: 1.0}, {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before.setdefault(w, []).append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, ()):
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                out[w] += share[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_in_blocks(spark, example, monkeypatch):
    """Blocks of a few sources, and a hub that is dealt by salts, give the same; nothing is left in the shared folder but the sums."""
    n, near, (v, e) = example
    wanted = brandes(near)
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(v, e).collect()} == pytest.approx(wanted, abs=1e-8)
    monkeypatch.setattr(graph, "SALT_ROWS", 7)
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(v, e, block_rows=9 * n).collect()} == pytest.approx(wanted, abs=1e-8)
    assert max(r["parts"] for r in graph._steps(v, e, 9)[1].collect()) > 3
    one = graph.betweenness(v, e, spark.createDataFrame([(0,), (0,)], "id long"))
    assert sum(r["betweenness"] for r in one.collect()) == pytest.approx(sum(d - 1 for d in distances(near, 0).values() if d) * n / ((n - 1) * (n - 2)), abs=1e-6)
    assert {r["betweenness"] for r in graph.betweenness(v, e.limit(0)).collect()} == {0.0}
    assert graph.betweenness(v.limit(0), e.limit(0)).count() == 0


def test_pair_features(spark):
    v, e = table(spark, 6, [(0, 1), (1, 2), (0, 2), (2, 3)])
    pairs = spark.createDataFrame([(0, 3), (0, 4)], "src long, dst long")
    found = {(r[0], r[1]): tuple(r)[2:] for r in graph.pair_features(v, e, pairs).collect()}
    assert found[0, 3] == pytest.approx((1 / 3, 0.5, 0.2, 0.2))
    assert found[0, 4] == pytest.approx((1.0, 0.5, 1.0, 0.4))


def test_network(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "d")], "k long, person string")
    pairs = mentions.cooccurrence(found, "k")
    assert rows(pairs) == [("a", "b", 2), ("a", "c", 1)]
    nodes, edges = mentions.network(mentions.mention_counts(found), pairs, 2, 1)
    assert rows(nodes.select("id", "weight", "degree")) == [("a", 3, 2), ("b", 2, 1)]
    assert rows(edges) == [("a", "b", 2)]
    assert sum(r["degree"] for r in mentions.degrees(pairs).collect()) == 2 * pairs.count()


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "李白居易訪杜甫"), (2, None), (3, ""), (4, "將軍李")], "k long, t string")
    names = ["李白", "白居易", "杜甫", "王維"]
    for automaton in (False, True):
        assert rows(mentions.mentions(docs, "k", "t", names, automaton)) == sorted([(1, "李白"), (1, "白居易"), (1, "杜甫")], key=repr)
    assert mentions.mentions(docs, "k", "t", []).count() == 0
    assert (4, "將軍李") in rows(mentions.title_mentions(docs, "k", "t", names))


def test_link_samples(example):
    n, near, (v, e) = example
    some = linkpred.labelled_pairs(v, e)
    r = some.collect()
    assert sum(x["label"] for x in r) * 2 == len(r)
    assert all((x["dst"] in near[x["src"]]) == bool(x["label"]) and x["src"] < x["dst"] for x in r)
    assert rows(some) == rows(linkpred.labelled_pairs(v, e))
    parts = linkpred.split(some).groupBy("label", "part").count().collect()
    assert len(parts) == 4


def test_metrics(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.4, 1), (0.4, 0), (0.1, 0)], "score double, label int")
    m = linkpred.metrics(scored).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == pytest.approx((0.6, 0.5, 0.5, 0.5))
    assert m["auc"] == pytest.approx((3 + 1.5) / 6)


def test_circuits():
    import numpy as np

    z = linkpred.circuit("ring", np.zeros((1, 2)), np.zeros((1, 2, 3)))
    assert z == pytest.approx(np.ones((1, 2)))
    turned = linkpred.circuit("topology", np.array([[np.pi, 0.0]]), np.zeros((0, 2, 3)))
    assert turned == pytest.approx(np.array([[-1.0, 1.0]]))
    flipped = linkpred.circuit("topology", np.array([[np.pi, 0.0]]), np.zeros((1, 2, 3)))  # the first qubit flips the second
    assert flipped == pytest.approx(np.array([[-1.0, -1.0]]))
    rng = np.random.default_rng(0)
    for kind in ("full", "topology", "ring"):
        s = linkpred.circuit(kind, rng.normal(size=(3, 4)), rng.normal(size=(2, 4, 3)))
        assert s.shape == (3, 4) and (np.abs(s) <= 1 + 1e-9).all()
    x = rng.normal(size=(40, 4))
    y = (x[:, 0] > 0).astype(float)
    assert linkpred.train_readout(x, y)[2][-1] < linkpred.train_readout(x, y)[2][0]
    h = linkpred.Hybrid()
    losses = h.train(x, y)
    assert losses[-1] < losses[0] and ((0 < h.score(x)) & (h.score(x) < 1)).all()


def test_negative_samples_of_a_dense_graph(spark):
    """All pairs that are no edges are found where as many are wanted, and as many as are wanted otherwise."""
    import random

    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    edges = random.Random(1).sample(pairs, 220)
    v, e = spark.range(30), spark.createDataFrame(edges, "src long, dst long")
    for count in (215, 300, 120, 90):
        found = [tuple(r) for r in linkpred.negative_samples(v, e, count).collect()]
        assert len(found) == len(set(found)) == min(count, 215) and not set(found) & set(edges)


def test_split_is_exact(spark):
    some = spark.createDataFrame([(i, i + 1, int(i % 3 == 0)) for i in range(1000)], "src long, dst long, label int")
    got = {(r["label"], r["part"]): r["count"] for r in linkpred.split(some).groupBy("label", "part").count().collect()}
    assert got == {(1, "train"): 267, (1, "test"): 67, (0, "train"): 532, (0, "test"): 134}


def test_paths_in_blocks(spark, monkeypatch):
    """Several blocks of sources, tiles and salts give the distances of whole searches, and counts of pairs at each; no step makes a row for each source and edge."""
    random.seed(5)
    pairs = [(100 * c + a, 100 * c + b) for c in range(3) for a, b in (random.sample(range(50), 2) for _ in range(90))]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    wanted = {(s, t, d) for s in near for t, d in distances(near, s).items() if d}
    _, e = table(spark, 1, pairs)
    for name, value in (("WORDS", 1), ("TILE", 16), ("SALT_ROWS", 40)):
        monkeypatch.setattr(graph, name, value)
    made = []
    stepped = graph._stepped
    monkeypatch.setattr(graph, "_stepped", lambda *a: made.append(stepped(*a)) or made[-1])
    assert {tuple(r) for r in graph.shortest_paths(e).collect()} == wanted
    assert made and "block" in made[0].columns
    assert dict(graph.path_lengths(e).collect()) == {d: sum(1 for s, t, x in wanted if s < t and x == d) for d in {d for _, _, d in wanted}}


def test_searches_in_parts(monkeypatch):
    """A task that adds up a few neighbours at a time, of a few sources, gives the same."""
    random.seed(9)
    near = {i: set() for i in range(40)}
    for a, b in [random.sample(range(40), 2) for _ in range(60)] + [(0, i) for i in range(1, 40)]:
        near[a].add(b)
        near[b].add(a)
    row = lambda i: {"pack": 0, "slice": 0, "slices": 1, "place": i, "id": str(i), "asked": True, "to": sorted(near[i])}
    monkeypatch.setattr(walks, "SOURCES", 7)
    monkeypatch.setattr(walks, "CELLS", 130)
    monkeypatch.setattr(walks, "ROWS", 9)
    g = walks.Graph([pa.RecordBatch.from_pylist([row(i) for i in range(40)])])
    assert {i: x / (39 * 38) for i, x in enumerate(g.dependencies())} == pytest.approx(brandes(near), abs=1e-8)
    found = [(r["src"], r["dst"], r["dist"]) for b in walks.paths(g) for r in b.to_pylist()]
    assert sorted(found) == sorted((str(s), str(t), d) for s in near for t, d in distances(near, s).items() if d)


def test_searches_within_tasks(spark, monkeypatch):
    """Tasks that hold a few components each give the distances, counts and betweenness of whole searches, and store nothing for a step."""
    random.seed(8)
    pairs = sorted({tuple(sorted(random.sample(range(c, c + 50), 2))) for c in (0, 50, 100) for _ in range(75)} | {(0, i) for i in range(1, 30)})
    near = {i: set() for i in range(160)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    v, e = table(spark, 160, pairs)
    wanted = {(s, t, d) for s in near for t, d in distances(near, s).items() if d}
    for name, value in (("TABLE_PAIRS", 0), ("TILE", 16), ("OWN_WORK", 900)):
        monkeypatch.setattr(graph, name, value)
    monkeypatch.setattr(graph, "_stepped", None)
    found = graph.shortest_paths(e).collect()
    assert len(found) == len(wanted) and set(map(tuple, found)) == wanted
    starts = spark.createDataFrame([(3,), (3,), (61,), (900,)], "id long")
    assert rows(graph.shortest_paths(e, starts, 2)) == sorted((x for x in wanted if x[0] in (3, 61) and x[2] <= 2), key=repr)
    assert dict(graph.path_lengths(e).collect()) == {d: sum(1 for s, t, x in wanted if s < t and x == d) for d in {d for _, _, d in wanted}}
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(v, e).collect()} == pytest.approx(brandes(near), abs=1e-8)
    monkeypatch.undo()
    for name, value in (("TABLE_PAIRS", 0), ("OWN_EDGES", 3)):  # a component that a task can't hold is searched by tables
        monkeypatch.setattr(graph, name, value)
    assert graph._own_graphs(Scratch(spark), graph._placed(Scratch(spark), v, e), e, None) is None


def test_pair_features_of_edges_take_a_step(spark, monkeypatch):
    """The search is for the pairs alone: where they are edges it ends after a step, however large the graph."""
    v, e = table(spark, 40, [(i, i + 1) for i in range(39)])
    whole = []
    monkeypatch.setattr(graph, "shortest_paths", lambda *a: whole.append(a))
    seen = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: seen.append(1) or keep(self, df))
    assert {r["path_length"] for r in graph.pair_features(v, e, e).collect()} == {0.1}
    assert not whole and len(seen) <= 8


def test_betweenness_of_several_blocks(spark, monkeypatch):
    """More sources than a row has, in several components and rounds."""
    random.seed(6)
    near = {i: set() for i in range(30)}
    for a, b in (sorted(random.sample(range(c, c + 14), 2)) for c in (0, 14) for _ in range(22)):
        near[a].add(b)
        near[b].add(a)
    v, e = table(spark, 30, [(a, b) for a in near for b in near[a] if a < b])
    monkeypatch.setattr(graph, "_PATHS", graph._PATHS[:5])
    monkeypatch.setattr(graph, "TILE", 8)
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(v, e, block_rows=250).collect()} == pytest.approx(brandes(near), abs=1e-8)


def test_cooccurrence_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    """More lines make more tasks, not larger ones; the pairs are the same."""
    from corpusloom.plans import tables

    lines = [(o, p) for o in range(60) for p in {o % 7, o % 5, o % 3 + 4}]
    spark.createDataFrame(lines + lines[:9], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    found = tables.supplier_pairs(spark, str(tmp_path))
    assert tables._tasks(spark, str(tmp_path)) == -(-(len(lines) + 9) // 10) == found.rdd.getNumPartitions()
    orders = spark.createDataFrame(lines, "k long, person long").distinct()
    assert rows(found) == rows(mentions.cooccurrence(orders, "k"))


def test_pair_distance_steps_from_the_smaller_frontier(spark, monkeypatch):
    """Many sources and one target: the target's frontier is the one that goes on."""
    v, e = table(spark, 60, [(i, i + 1) for i in range(9)] + [(i, i + 1) for i in range(20, 59)])
    kept = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    monkeypatch.setattr(Scratch, "drop", lambda self, after=0: None)
    found = graph.pair_distance(e, v.select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst")))
    assert {r["src"]: r["dist"] for r in found.collect()} == {i: abs(i - 1) if i < 10 else 10 for i in range(60)}
    assert max(t.count() for t in kept if t.columns == ["end", "v"]) == 59


def test_baselines_weigh_equal_rows(spark, monkeypatch):
    """Models see each different row once, and the result is that of all rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    some = [(i, i + 1, int((i * 7919) % 11 < 2 + 2 * (i % 3) + i % 4), "test" if i % 5 == 0 else "train", i % 3, (i % 4) / 2) for i in range(3000)]
    pairs = spark.createDataFrame(some, "src long, dst long, label int, part string, w long, s double")
    seen, made = [], linkpred.radial_features
    monkeypatch.setattr(linkpred, "radial_features", lambda rows, *a, **k: (seen.append(rows.count()), made(rows, *a, width=16, **k))[1])
    found = {r["model"]: r for r in linkpred.baselines(pairs, ("w", "s")).collect()}
    assert seen == [len({r[2:] for r in some})] and seen[0] < 100
    cast = VectorAssembler(inputCols=["w", "s"], outputCol="raw").transform(pairs.withColumn("label", F.col("label").cast("double")))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(cast.where("part = 'train'")).transform(cast)
    model = LogisticRegression(regParam=1e-4).fit(scaled.where("part = 'train'"))
    wanted = linkpred.metrics(model.transform(scaled.where("part = 'test'")).withColumn("score", F.round(vector_to_array("probability")[1], 9))).first()
    assert found["logistic_regression"]["auc"] == pytest.approx(wanted["auc"], abs=1e-6)
    assert found["logistic_regression"]["accuracy"] == pytest.approx(wanted["accuracy"], abs=1e-6)
    assert len(found) == 4 and all(0 <= r[c] <= 1 for r in found.values() for c in ("auc", "accuracy", "precision", "recall", "f1"))


def test_bundles_leave_no_row_out(spark):
    told = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", 25.0)], "x string, rows double")
    assert {(r["x"], r["n"], r["k"]) for r in linkpred.bundles(told, "rows", 1).groupBy("x").agg({"rows": "sum", "x": "count"}).toDF("x", "n", "k").collect()} == {("a", 1, 1), ("b", 10, 10), ("c", 25, 25)}
    some = linkpred.bundles(told, "rows", 10).collect()
    assert sorted(r["x"] for r in some) == ["a", "b", "c", "c"] + ["c"] * (len(some) - 4) and sum(r["rows"] for r in some) == pytest.approx(36)


def test_metrics_read_their_input_once(spark):
    from pyspark.sql import functions as F

    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    scored = spark.createDataFrame([(i % 10 / 10, i % 3 % 2) for i in range(300)], "score double, label int").repartition(3)
    m = linkpred.metrics(scored.withColumn("score", F.udf(seen, "double")("score"))).first()
    assert n.value == 300 and tuple(m) == tuple(linkpred.metrics(scored).first())
    told = scored.groupBy("score", "label").agg(F.count("*").cast("double").alias("rows"))
    assert tuple(linkpred.metrics(told, rows="rows").first()) == tuple(m)


def test_score_metrics_reads_lines_once(spark, monkeypatch):
    """Nodes and pairs are counted from orders that are told apart once."""
    from pyspark.sql import functions as F

    from corpusloom.plans import queries, tables

    n, folder, read = spark.sparkContext.accumulator(0), "/root/testdata/sf0.001", tables.table

    def seen(x):
        n.add(1)
        return x

    wanted = tuple(queries.score_metrics(spark, folder).first())
    counted = F.udf(seen, "long")
    monkeypatch.setattr(tables, "table", lambda spark, folder, name: read(spark, folder, name).withColumn("l_suppkey", counted("l_suppkey")) if name == "lineitem" else read(spark, folder, name))
    assert tuple(queries.score_metrics(spark, folder).first()) == wanted
    assert n.value == read(spark, folder, "lineitem").count()


def test_sets_of_texts(spark):
    """Sets hold what the different rows hold, nulls too; pairs are those of a join, repeated rows and null keys as there."""
    some = [(1, 5), (1, 3), (1, 5), (1, None), (2, 5), (2, 3), (3, None), (None, 5), (None, 3), (None, None), (4, 9)]
    found = spark.createDataFrame(some, "k long, person long")
    sets = mentions.together(found, "k", tasks=3)
    assert sorted(((r["k"], p) for r in sets.collect() for p in r["persons"]), key=repr) == sorted(set(some), key=repr)
    assert rows(mentions.met_counts(sets, "k", 3)) == [(3, 5, 2)]
    assert rows(mentions.cooccurrence(found, "k")) == rows(mentions.cooccurrence(found, "k", tasks=3)) == [(3, 5, 3)]
    assert "Join" not in mentions.cooccurrence(found, "k")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "int"])
def test_pairs_as_one_number(spark, kind):
    """Pairs sent as one number are those sent as two, of the same type; where one number can't hold them, two are sent."""
    ends = [-(2**31), -1, 0, 7, 2**31 - 1] if kind == "int" else [-5, -1, 0, 7, 3_037_000_493]  # the widest of long that fit
    some = [(k, p) for k in range(6) for p in ends[k % 3 :]] + [(1, None), (None, ends[0]), (None, ends[1]), (2, ends[3])]
    sets = mentions.together(spark.createDataFrame(some, f"k long, person {kind}"), "k")
    told = mentions.met_counts(sets, "k", 3, (ends[0], ends[-1]))
    two = mentions.met_counts(sets, "k", 3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert rows(told) == rows(two) and len(rows(told)) == 10
    assert told.dtypes == two.dtypes
    assert ("hashpartitioning(pair" in plan(told)) == (kind == "long") and "hashpartitioning(p1" in plan(two)
    for span in ((None, None), (-(2**63), 2**63 - 1)):
        assert "hashpartitioning(p1" in plan(mentions.met_counts(sets, "k", 3, span)) and rows(mentions.met_counts(sets, "k", 3, span)) == rows(two)


def test_supplier_pairs_travel_as_one_number(spark):
    from corpusloom.plans import tables

    folder = "/root/testdata/sf0.001"
    sets = tables.supplier_sets(spark, folder)
    for pairs in (tables.supplier_pairs(spark, folder), tables.supplier_pairs(spark, folder, sets)):
        assert "hashpartitioning(pair" in pairs._jdf.queryExecution().executedPlan().toString()
        assert rows(pairs) == rows(mentions.met_counts(sets, "order"))


def test_negative_samples_look_at_low_places_first(spark, monkeypatch):
    """Not all pairs drawn are stored, and what is found doesn't depend on the share that is looked at first."""
    edges = spark.range(8000).selectExpr("id % 2000 as src", "2000 + id % 7 as dst").distinct()
    sizes, made = [], linkpred.stored

    def store(df):
        table, path = made(df)
        sizes.append(table.count())
        return table, path

    monkeypatch.setattr(linkpred, "stored", store)
    find = lambda: rows(linkpred.negative_samples(spark.range(2007), edges, 8000))
    found = find()
    assert len(found) == 8000 <= sizes[0] < 16000 and len(sizes) == 1
    for share in (1.0, 0.001):
        monkeypatch.setattr(linkpred, "_likely_share", lambda *_, s=share: s)
        assert find() == found
    assert sizes[1] > 16000 and sizes[2] < 8000 < sizes[3] == sizes[1]
