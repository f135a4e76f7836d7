"""Link prediction on a weighted graph: samples, features, models, circuits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dropped, ship, stored
from .mentions import met

#: Rows that a forest's trees are drawn from; where there are more, equal ones are drawn together, in bundles, so no row is left out.
FOREST_ROWS = 1_000_000
#: Vertices that a task draws pairs from, counted once for each round.
DRAW_ROWS = 1_000_000


def place(*columns: str, seed: int = 42) -> Column:
    """A fixed pseudo-random place of a row, the same in any engine that has md5."""
    return F.md5(F.concat_ws("_", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))


def negative_samples(vertices: DataFrame, edges: DataFrame, count: int, seed: int = 42, bucket: int = 8) -> DataFrame:
    """``count`` pairs (src < dst) that are no edges, or all there are, the first by ``place`` of those drawn.

    Rather than from all pairs, pairs are drawn from vertices that meet in small random buckets, in as many rounds as give three
    times the pairs wanted, a number that follows ``count``.  Rounds are doubled until enough are drawn.  Where more than half of
    all that are no edges are wanted, every pair is looked at, which then are no more than twice the pairs wanted, and the edges.

    As the first by place are wanted, pairs drawn are first looked at up to a place below which there are likely enough of them.  If there are
    not, all are.
    """
    n = vertices.count()
    known = edges.select("src", "dst")
    free = n * (n - 1) // 2 - known.distinct().count()
    rounds = max(2, -(-6 * count // max(1, n * (bucket - 1))))
    share = _likely_share(n, free, rounds * n * bucket / 2, count)
    while True:
        every = 2 * count > free
        if every:
            pairs = _all_pairs(vertices, max(1, n // 1000))
        else:
            tasks = max(vertices.sparkSession.sparkContext.defaultParallelism, -(-n * rounds // DRAW_ROWS))
            pairs = _drawn_pairs(vertices, max(1, n // bucket), rounds, seed, tasks)
            pairs = (pairs if share >= 1 else pairs.where(place("src", "dst", seed=seed) < f"{int(share * 16**8):08x}")).distinct()
        fresh, path = stored(pairs.join(known, ["src", "dst"], "left_anti").withColumn("place", place("src", "dst", seed=seed)))
        if every or fresh.count() >= count:
            return _first_by_place(fresh, count)
        dropped(vertices.sparkSession, path)
        share, rounds = 1.0, rounds if share < 1 else 2 * rounds


def _likely_share(n: int, free: int, drawn: float, count: int) -> float:
    """The share of places within which ``count`` different pairs that are no edges are likely, and some more, of so many drawn."""
    likely = free * -np.expm1(-drawn / max(1, n * (n - 1) / 2))
    return min(1.0, (1.1 * count + 1000) / likely) if likely > 0 else 1.0


def _first_by_place(pairs: DataFrame, count: int) -> DataFrame:
    """The ``count`` first pairs (src, dst, place).  Places are counted in 65536 equal parts; only the part in which the last one lies is put in order."""
    own = F.left("place", F.lit(4))
    before, last = 0, ""
    for part, n in sorted(tuple(r) for r in pairs.groupBy(own.alias("part")).count().collect()):  # at most 65536 rows
        last = part
        if before + n >= count:
            break
        before += n
    rest = pairs.where(own == last).orderBy("place").limit(max(count - before, 0))
    return pairs.where(own < last).unionByName(rest).select("src", "dst")


def _drawn_pairs(vertices: DataFrame, buckets: int, rounds: int, seed: int, tasks: int) -> DataFrame:
    dealt = vertices.select("id").repartition(tasks)  # a row makes one for each round
    drawn = dealt.select("id", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    number = F.conv(F.left(F.md5(F.concat_ws("_", F.col("id").cast("string"), F.col("round").cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("long")
    dealt = drawn.withColumn("bucket", F.pmod(number, F.lit(buckets))).repartition(tasks, "round", "bucket")
    return met(dealt.groupBy("round", "bucket").agg(F.collect_list("id").alias("ids")), "ids", "src", "dst")  # a few in each


def _all_pairs(vertices: DataFrame, blocks: int) -> DataFrame:
    """Every pair, each pair of blocks in a group of its own."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = vertices.select("id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    a = dealt.select(F.col("id").alias("src"), F.col("own").alias("i"), F.col("other").alias("j"))
    b = dealt.select(F.col("id").alias("dst"), F.col("other").alias("i"), F.col("own").alias("j"))
    return a.join(b, ["i", "j"]).where("src < dst").select("src", "dst")


def labelled_pairs(vertices: DataFrame, edges: DataFrame, seed: int = 42, ratio: float = 1.0) -> DataFrame:
    """(src, dst, label): all edges and as many pairs (times ``ratio``) that are none."""
    edges, _ = stored(edges.select("src", "dst"))  # read several times
    n = int(edges.count() * ratio)
    return edges.select("src", "dst", F.lit(1).alias("label")).unionByName(negative_samples(vertices, edges, n, seed).withColumn("label", F.lit(0)))


def node_features(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with weight and size of both ends: w1, s1, w2, s2."""
    ends = (nodes.select(F.col("id").alias(end), F.col("weight").alias(f"w{i}"), F.col("size").alias(f"s{i}")) for i, end in ((1, "src"), (2, "dst")))
    out = pairs
    for end, about in zip(("src", "dst"), ends, strict=True):
        out = out.join(about, end)
    return out.select(*pairs.columns, "w1", "s1", "w2", "s2")


def split(pairs: DataFrame, share: float = 0.8, label: str = "label", seed: int = 42) -> DataFrame:
    """``pairs`` with ``part``: train for the first ``share`` of each label by ``place``, else test.

    Places are counted in 4096 equal parts first; a row's rank is what lies in the parts before its own and its rank within that.
    """
    at = pairs.withColumn("__place", place("src", "dst", seed=seed)).withColumn("__part", F.left("__place", F.lit(3)))
    parts = at.groupBy(label, "__part").agg(F.count("*").alias("__c"))
    every = Window.partitionBy(label)
    before = F.coalesce(F.sum("__c").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(label, "__part", before.alias("__before"), F.sum("__c").over(every).alias("__n"))  # at most 4096 rows a label
    ranked = at.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__part").orderBy("__place")))
    told = ranked.alias("a").join(parts.alias("b"), (F.col(f"a.{label}").eqNullSafe(F.col(f"b.{label}"))) & (F.col("a.__part") == F.col("b.__part")))
    return told.select(*(F.col(f"a.{c}") for c in pairs.columns), F.when(F.col("__before") + F.col("__r") <= F.floor(F.col("__n") * share), "train").otherwise("test").alias("part"))


def metrics(scored: DataFrame, score: str = "score", label: str = "label", rows: str | None = None) -> DataFrame:
    """One row: accuracy, precision, recall, f1 at one half, and the area under the curve by ranks (ties count half).

    ``scored`` is read once, for a table of its different scores; ``rows`` names a column that tells how many rows one stands for.
    """
    p, y, n = F.col("s") >= 0.5, F.col(label) == 1, F.col(rows) if rows else F.lit(1)
    total = lambda which, what: F.coalesce(F.sum(F.when(which, what)), F.lit(0)).cast("long")
    by, _ = stored(scored.groupBy(F.col(score).alias("s")).agg(total(y, n).alias("pos"), total(~y, n).alias("neg")))
    c = by.agg(total(p, F.col("pos")).alias("tp"), total(p, F.col("neg")).alias("fp"), total(~p, F.col("pos")).alias("fn"), total(~p, F.col("neg")).alias("tn"))
    # negatives below a score: those in lower parts of the range of scores, and those below it in its own part
    least, most = by.agg(F.min("s"), F.max("s")).first()
    wide = (most - least) if most is not None and most > least else 1.0
    by = by.withColumn("part", F.least(F.floor((F.col("s") - F.lit(least if least is not None else 0.0)) / F.lit(wide) * 4096), F.lit(4095)))
    lower = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sorted(tuple(r) for r in by.groupBy("part").agg(F.sum("neg")).collect())  # at most 4096 rows
    starts = [0, *accumulate(n for _, n in sizes)]
    parts = F.broadcast(scored.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, starts, strict=False)], "part long, before long"))
    below = F.col("before") + lower(Window.partitionBy("part").orderBy("s"))
    auc = by.join(parts, "part").select((F.col("pos") * (below + F.col("neg") / 2)).alias("won"), "pos", "neg").agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    out = c.select((tp + tn).alias("right"), (tp + fp + fn + tn).alias("all"), F.coalesce(precision, F.lit(0.0)).alias("precision"), F.coalesce(recall, F.lit(0.0)).alias("recall"))
    out = out.select((F.col("right") / F.nullif(F.col("all"), F.lit(0))).alias("accuracy"), "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)).alias("f1"))
    return out.join(auc)  # one row each


def radial_features(rows: DataFrame, vector: str, into: str, gamma: float, width: int = 512, seed: int = 42) -> DataFrame:
    """``rows`` with random Fourier features of a vector column: their inner products are exp(-gamma |x - y|^2), but for an error that falls with the root of ``width``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = rows.select(F.size(vector_to_array(vector)).alias("n")).first()
    rng = np.random.default_rng(seed)
    turns, shifts = rng.standard_normal((size["n"] if size else 1, width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, width)

    def waves(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(np.sqrt(2 / width) * np.cos(np.stack(x.to_list()) @ turns + shifts)) if len(x) else [])

    waves.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(into, array_to_vector(F.pandas_udf("array<double>")(waves)(vector_to_array(vector))))


def baselines(pairs: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """(model, auc, accuracy, precision, recall, f1) on the test part, of a random forest, a logistic regression, and support vector machines with a linear and a radial kernel.

    The radial one is an approximation: a linear machine on random Fourier features of the kernel exp(-|x - y|^2 / number of features), of standardised features.
    Rows of the same features, label and part are one row that weighs as many, so the models' work follows the different rows.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cast = pairs.select("part", F.col("label").cast("double").alias("label"), *(F.col(f).cast("double").alias(f) for f in features))
    told, _ = stored(cast.groupBy(*cast.columns).agg(F.count("*").cast("double").alias("rows")))
    train, n = told.where("part = 'train'"), F.sum("rows")
    count, *means = train.agg(n, *(F.sum(F.col(f) * F.col("rows")) / n for f in features)).first()
    spreads = train.agg(*(F.sqrt(F.sum((F.col(f) - F.lit(m)) ** 2 * F.col("rows")) / F.lit(max(count - 1, 1))) for f, m in zip(features, means, strict=True))).first()
    scaled = told.withColumns({f: (F.col(f) - F.lit(m)) * F.lit(1 / s if s else 0.0) for f, m, s in zip(features, means, spreads, strict=True)})
    scaled = VectorAssembler(inputCols=list(features), outputCol="features").transform(scaled).select("part", "label", "rows", "features")
    scaled = radial_features(scaled, "features", "radial", 1 / len(features), seed=seed).cache()
    # the features' spread is one, so nothing is left to standardise
    models = {
        "random_forest": RandomForestClassifier(numTrees=100, seed=seed), "logistic_regression": LogisticRegression(regParam=1e-4, standardization=False),
        "linear_svc": LinearSVC(maxIter=50, regParam=0.01, standardization=False), "radial_svc": LinearSVC(maxIter=50, regParam=0.001, featuresCol="radial", standardization=False),
    }
    out = None
    for name, model in models.items():
        rows = scaled.where("part = 'train'")
        if name == "random_forest":
            rows = bundles(rows.drop("radial"), "rows", -(-int(count) // FOREST_ROWS))
        seen = model.setWeightCol("rows").fit(rows).transform(scaled.where("part = 'test'"))
        score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])) if name.endswith("svc") else vector_to_array("probability")[1]
        row = metrics(seen.withColumn("score", score), rows="rows").withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    scaled.unpersist()  # all scores are stored
    return out.select("model", "auc", "accuracy", "precision", "recall", "f1")


def bundles(told: DataFrame, rows: str, size: int) -> DataFrame:
    """Rows that each stand for ``rows`` equal ones, dealt to rows that stand for about ``size`` each, at least one: what a bootstrap draws.  The sum of ``rows`` stays."""
    k = F.greatest(F.round(F.col(rows) / size), F.lit(1)).cast("int")
    dealt = told.repartition(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a few rows may stand for very many
    return dealt.withColumn("__k", k).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__k")))).withColumn(rows, F.col(rows) / F.col("__k")).drop("__k", "__i")


# --- circuits -------------------------------------------------------------------------------------------------------


class State:
    """State vectors of a batch of circuits on a few qubits."""

    def __init__(self, batch: int, qubits: int) -> None:
        self.qubits = qubits
        self.v = np.zeros((batch, *(2,) * qubits), complex)
        self.v[(slice(None), *(0,) * qubits)] = 1

    def one(self, gate: np.ndarray, q: int, control: int | None = None) -> None:
        """Apply (2, 2) or (batch, 2, 2) to a qubit, where ``control`` is one if given."""
        if control is None:
            moved = np.moveaxis(self.v, q + 1, 1).reshape(len(self.v), 2, -1)
            out = (gate @ moved).reshape(len(self.v), 2, *(2,) * (self.qubits - 1))
            self.v = np.moveaxis(out, 1, q + 1)
            return
        moved = np.moveaxis(self.v, (control + 1, q + 1), (1, 2)).copy()
        part = moved[:, 1].reshape(len(self.v), 2, -1)
        moved[:, 1] = (gate @ part).reshape(moved[:, 1].shape)
        self.v = np.moveaxis(moved, (1, 2), (control + 1, q + 1))

    def z(self) -> np.ndarray:
        """Expectation of Z on each qubit."""
        p = np.abs(self.v) ** 2
        return np.stack([(s := p.sum(axis=tuple(a for a in range(1, self.qubits + 1) if a != q + 1)))[:, 0] - s[:, 1] for q in range(self.qubits)], axis=1)


def ry(a: np.ndarray | float) -> np.ndarray:
    c, s = np.cos(np.asarray(a) / 2), np.sin(np.asarray(a) / 2)
    return np.stack([np.stack([c, -s], -1), np.stack([s, c], -1)], -2).astype(complex)


def rz(a: np.ndarray | float) -> np.ndarray:
    e = np.exp(-0.5j * np.asarray(a))
    return np.stack([np.stack([e, 0 * e], -1), np.stack([0 * e, e.conj()], -1)], -2)


def rx(a: np.ndarray | float) -> np.ndarray:
    c, s = np.cos(np.asarray(a) / 2), -1j * np.sin(np.asarray(a) / 2)
    return np.stack([np.stack([c + 0j, s], -1), np.stack([s, c + 0j], -1)], -2)


X = np.array([[0, 1], [1, 0]], complex)


def rot(phi: float, theta: float, omega: float) -> np.ndarray:
    return rz(omega) @ ry(theta) @ rz(phi)


def circuit(kind: str, inputs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Z of each qubit for rows of inputs.

    full: RY and RZ of half the input; all pairs entangled by CNOT and controlled RZ, neighbours by CNOT and controlled RX.
    topology: RY; all pairs by CNOT, neighbours by controlled RZ.  ring: RY; a ring of CNOTs.
    Each layer ends with a rotation of every qubit.
    """
    n = inputs.shape[1]
    s = State(len(inputs), n)
    for q in range(n):
        s.one(ry(inputs[:, q]), q)
        if kind == "full":
            s.one(rz(inputs[:, q] * 0.5), q)
    for layer in weights:
        if kind == "ring":
            for q in range(n):
                s.one(X, (q + 1) % n, q)
        else:
            for i in range(n):
                for j in range(i + 1, n):
                    s.one(X, j, i)
                    if kind == "full":
                        s.one(rz(layer[i][0]), j, i)
            for i in range(0, n - 1, 2):
                if kind == "full":
                    s.one(X, i + 1, i)
                    s.one(rx(layer[i][1]), i + 1, i)
                else:
                    s.one(rz(layer[i][0]), i + 1, i)
        for q in range(n):
            s.one(rot(*layer[q]), q)
    return s.z()


def fitted(features: np.ndarray, qubits: int) -> np.ndarray:
    """As many columns as qubits: cut, or filled with zeros."""
    return np.pad(features, ((0, 0), (0, max(0, qubits - features.shape[1]))))[:, :qubits]


def circuit_scores(pairs: DataFrame, features: Sequence[str], kind: str = "topology", qubits: int = 4, layers: int = 2, seed: int = 42, into: str = "score") -> DataFrame:
    """``pairs`` with the sigmoid of a weighted read-out; weights are seeded, not trained."""
    ship(pairs.sparkSession)
    rng = np.random.default_rng(seed)
    weights, readout = rng.normal(size=(layers, qubits, 3)), rng.normal(size=qubits)

    def run(batches):  # noqa: ANN001, ANN202
        for columns in batches:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            yield pd.Series(1 / (1 + np.exp(-circuit(kind, fitted(x, qubits), weights) @ readout)))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return pairs.withColumn(into, F.round(F.pandas_udf("double")(run)(*(F.col(f).cast("double") for f in features)), 9))


class Hybrid:
    """A shared linear encoder of both ends, a ring circuit on the raw features, and a small network on top."""

    def __init__(self, qubits: int = 4, width: int = 16, hidden: int = 32, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.qubits, self.circuit = qubits, rng.normal(size=(2, qubits, 3)) * 0.1
        self.encoder, self.shift = rng.normal(size=(2, width)) / np.sqrt(2), np.zeros(width)
        self.first, self.first_shift = rng.normal(size=(2 * width + qubits, hidden)) / np.sqrt(2 * width + qubits), np.zeros(hidden)
        self.last, self.last_shift = rng.normal(size=hidden) / np.sqrt(hidden), 0.0

    def _inside(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = [x[:, :2] @ self.encoder + self.shift, x[:, 2:4] @ self.encoder + self.shift]
        joined = np.concatenate([*ends, circuit("ring", fitted(x, self.qubits), self.circuit)], axis=1)
        return joined, np.maximum(joined @ self.first + self.first_shift, 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self._inside(x)[1] @ self.last + self.last_shift)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 50, rate: float = 0.05) -> list[float]:
        """Gradient steps on the cross entropy (the circuit's weights stay); the loss of each epoch."""
        losses = []
        for _ in range(epochs):
            joined, inside = self._inside(x)
            p = 1 / (1 + np.exp(-(inside @ self.last + self.last_shift)))
            losses.append(float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))))
            d = (p - y) / len(y)
            back = np.outer(d, self.last) * (inside > 0)
            ends = back @ self.first.T
            width = self.encoder.shape[1]
            self.last, self.last_shift = self.last - rate * inside.T @ d, self.last_shift - rate * d.sum()
            self.first, self.first_shift = self.first - rate * joined.T @ back, self.first_shift - rate * back.sum(axis=0)
            self.encoder = self.encoder - rate * (x[:, :2].T @ ends[:, :width] + x[:, 2:4].T @ ends[:, width : 2 * width])
            self.shift = self.shift - rate * (ends[:, : 2 * width]).reshape(len(x), 2, width).sum(axis=(0, 1))
        return losses


def hybrid_scores(pairs: DataFrame, features: Sequence[str], model: Hybrid | None = None, into: str = "score") -> DataFrame:
    """``pairs`` with the hybrid network's score, of seeded weights unless a trained model is given."""
    ship(pairs.sparkSession)
    net = model or Hybrid()

    def run(batches):  # noqa: ANN001, ANN202
        for columns in batches:
            yield pd.Series(net.score(np.column_stack([c.to_numpy(float) for c in columns])))

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return pairs.withColumn(into, F.round(F.pandas_udf("double")(run)(*(F.col(f).cast("double") for f in features)), 9))


def train_readout(x: np.ndarray, y: np.ndarray, kind: str = "topology", qubits: int = 4, layers: int = 2, seed: int = 42, epochs: int = 100, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Circuit weights (seeded), trained read-out weights, and the loss of each epoch, on rows that fit in memory."""
    rng = np.random.default_rng(seed)
    weights, readout = rng.normal(size=(layers, qubits, 3)), rng.normal(size=qubits)
    z = circuit(kind, fitted(x, qubits), weights)
    losses = []
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-z @ readout))
        losses.append(float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))))
        readout = readout - rate * z.T @ (p - y) / len(y)
    return weights, readout, losses
