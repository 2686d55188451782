"""Further learners: pipelines of steps, boosted histograms and oblivious trees, additive models, kernel machines, trees of
neighbours, hierarchies, embeddings of few points, isolation, search over settings, and explanations.

What is fitted on all rows is fitted by aggregates: histograms by bin, sums by group. What needs points side by side (hierarchies,
t-SNE, graphs of neighbours, isolation trees, kernels) takes a bounded sample or cells of bounded size, and says so.
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import distributions as D
from lumenframe.operators import ml as M


def sampled(df: DataFrame, columns: Sequence[str], key: str, most: int) -> pd.DataFrame:
    """The rows of the `most` smallest hashes of key, on the driver; the same ones in every run."""
    return df.select(key, *columns).orderBy(F.xxhash64(key), key).limit(most).toPandas()


# steps that are fitted, then transform


class Step:
    """fit(df) learns and returns the step; transform(df) applies it. Fitted state is plain values, so steps can be stored."""

    def fit(self, df: DataFrame) -> Step:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def save(self, path: str) -> None:
        """To a local file; only files of one's own are to be loaded, as loading runs what is in them."""
        with open(path, "wb") as f:
            pickle.dump(self, f)

    @staticmethod
    def load(path: str) -> Step:
        with open(path, "rb") as f:
            return pickle.load(f)


@dataclass
class Scale(Step):
    """Columns less their mean over their population deviation; constant ones become 0."""

    columns: Sequence[str]
    state: dict = field(default_factory=dict)

    def fit(self, df):
        one = df.agg(*[x for c in self.columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        self.state = {c: (one[f"m_{c}"], one[f"s_{c}"] or 0.0) for c in self.columns}
        return self

    def transform(self, df):
        return df.withColumns({c: (F.col(c) - m) / s if s else F.lit(0.0) for c, (m, s) in self.state.items()})


@dataclass
class Ordinal(Step):
    """Categories as their place in the sorted list of those seen; others as null. Of at most `most` categories a column."""

    columns: Sequence[str]
    most: int = 10_000
    state: dict = field(default_factory=dict)

    def fit(self, df):
        for c in self.columns:
            found = [r[0] for r in df.select(c).dropna().distinct().limit(self.most + 1).collect()]
            if len(found) > self.most:
                raise ValueError(f"{c} has more than {self.most} categories")
            self.state[c] = sorted(found)
        return self

    def transform(self, df):
        place = lambda c, found: F.array_position(F.array(*[F.lit(x) for x in found]), F.col(c)) - 1
        return df.withColumns({c: F.when(place(c, x) >= 0, place(c, x)).cast("double") for c, x in self.state.items()})


@dataclass
class Impute(Step):
    columns: Sequence[str]
    state: dict = field(default_factory=dict)

    def fit(self, df):
        one = df.agg(*[F.avg(c).alias(c) for c in self.columns]).first()
        self.state = {c: one[c] for c in self.columns}
        return self

    def transform(self, df):
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.state.items()})


@dataclass
class Apply(Step):
    """Named expressions."""

    of: dict[str, str]

    def transform(self, df):
        return df.withColumns({name: F.expr(e) for name, e in self.of.items()})


@dataclass
class Pipeline(Step):
    """Steps one after another; each is fitted on what those before it make."""

    steps: list[tuple[str, Step]]

    def fit(self, df):
        for k, (_, step) in enumerate(self.steps):
            step.fit(df)
            if k < len(self.steps) - 1:
                df = step.transform(df)
        return self

    def transform(self, df):
        return functools.reduce(lambda x, s: s[1].transform(x), self.steps, df)

    def __getitem__(self, name: str) -> Step:
        return dict(self.steps)[name]


@dataclass
class ColumnTransformer(Step):
    """Each step on its own columns of the input; other columns stay (or go, with remainder 'drop')."""

    parts: list[tuple[str, Step, Sequence[str]]]
    remainder: str = "passthrough"

    def fit(self, df):
        for _, step, _ in self.parts:
            step.fit(df)
        return self

    def transform(self, df):
        out = functools.reduce(lambda x, p: p[1].transform(x), self.parts, df)
        return out if self.remainder == "passthrough" else out.select(*[c for _, _, columns in self.parts for c in columns])


@dataclass
class FeatureUnion(Step):
    """The columns that each step makes of the same input, side by side under its name."""

    parts: list[tuple[str, Step]]
    columns: Sequence[str]

    def fit(self, df):
        for _, step in self.parts:
            step.fit(df)
        return self

    def transform(self, df):
        out = df
        for name, step in self.parts:
            copies = {c: f"_in_{c}" for c in self.columns}
            wide = out.withColumns({v: F.col(c) for c, v in copies.items()})
            wide = step.transform(wide)
            made = [c for c in wide.columns if c in self.columns or c not in out.columns and c not in copies.values()]
            out = wide.select(*[F.col(copies[c]).alias(c) if c in copies else F.col(c) for c in out.columns], *[F.col(c).alias(f"{name}_{c}") for c in made])
        return out


@dataclass
class FeatureGenerator(Step):
    """Transforms of columns as further ones: log, sqrt, square, and products of pairs."""

    columns: Sequence[str]
    transforms: Sequence[str] = ("log", "sqrt", "square", "product")

    def transform(self, df):
        made = {}
        for c in self.columns:
            x = F.col(c).cast("double")
            own = {"log": F.signum(x) * F.log1p(F.abs(x)), "sqrt": F.signum(x) * F.sqrt(F.abs(x)), "square": x * x}
            made |= {f"{k}_{c}": e for k, e in own.items() if k in self.transforms}
        if "product" in self.transforms:
            made |= {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b) for a, b in itertools.combinations(self.columns, 2)}
        return df.withColumns(made)


# trees on histograms: rows carry their bins, each level is one aggregate of gradient sums by node, feature and bin


@dataclass
class Boosted(Step):
    """Gradient boosting on binned features. kind 'hist': each node has its own split; 'oblivious': all nodes of a level share one;
    'additive': trees of one feature each, in turn, so the model is a sum of curves. loss 'squared' or 'logistic'."""

    columns: Sequence[str]
    label: str
    kind: str = "hist"
    loss: str = "squared"
    trees: int = 10
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    penalty: float = 1.0
    edges: dict = field(default_factory=dict)
    base: float = 0.0
    forest: list = field(default_factory=list)

    def fit(self, df):
        y = F.col(self.label).cast("double")
        rows = df.filter(y.isNotNull())
        cuts = rows.agg(F.avg(y).alias("_base"), *[F.percentile_approx(F.col(c).cast("double"), [k / self.bins for k in range(1, self.bins)], 10_000).alias(c) for c in self.columns]).first()
        if cuts["_base"] is None:
            raise ValueError("no labelled rows")
        self.edges = {c: sorted(set(cuts[c] or [])) for c in self.columns}
        p = min(max(cuts["_base"], 1e-6), 1 - 1e-6)
        self.base = cuts["_base"] if self.loss == "squared" else math.log(p / (1 - p))
        self.forest = []
        binned = rows.select(y.alias("_y"), *[self._bin(c).alias(f"_b{i}") for i, c in enumerate(self.columns)])
        for t in range(self.trees):
            score = self._margin(binned, lambda i: F.col(f"_b{i}"))
            chance = 1 / (1 + F.exp(-score))
            g, h = (F.col("_y") - score, F.lit(1.0)) if self.loss == "squared" else (F.col("_y") - chance, chance * (1 - chance))
            own = [t % len(self.columns)] if self.kind == "additive" else list(range(len(self.columns)))
            self.forest.append(self._grow(binned.select("*", g.alias("_g"), h.alias("_h")), own))
        return self

    def _bin(self, c: str) -> Column:
        """How many edges are below the value; null is bin -1, left of all."""
        x, edges = F.col(c).cast("double"), self.edges[c]
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)) if edges else F.lit(0))

    def _grow(self, rows: DataFrame, features: list[int]) -> dict:
        """nodes: number -> (feature, bin) or a leaf's value; a node's children are 2n and 2n + 1."""
        nodes, open_ = {}, {1}
        for level in range(self.depth + 1):
            at = self._node(nodes, lambda i: F.col(f"_b{i}"))
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_b{i}").alias("b")) for i in features]))
            found: dict[int, dict[int, dict[int, tuple]]] = {}
            for r in rows.select(at.alias("n"), "_g", "_h", pairs.alias("p")).groupBy("n", "p.i", "p.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                found.setdefault(r["n"], {}).setdefault(r["i"], {})[r["b"]] = (r["g"], r["h"])
            totals = {n: np.sum(list(next(iter(of.values())).values()), axis=0) for n, of in found.items()}
            if level == self.depth:
                for n in open_:
                    g, h = totals.get(n, (0.0, 0.0))
                    nodes[n] = float(self.rate * g / (h + self.penalty))
                break
            gains = {n: self._gains(of, totals[n]) for n, of in found.items() if n in open_}
            if self.kind == "oblivious" and gains:
                sums: dict[tuple, float] = {}
                for of in gains.values():
                    for split, gain in of.items():
                        sums[split] = sums.get(split, 0.0) + gain
                best = max(sums, key=lambda s: (sums[s], s)) if sums else None
                chosen = dict.fromkeys(open_, best)
            else:
                chosen = {n: max(gains[n], key=lambda s: (gains[n][s], s)) if gains.get(n) else None for n in open_}
            further = set()
            for n in open_:
                split = chosen.get(n)
                if split is None or self.kind != "oblivious" and gains[n][split] <= 1e-12:
                    g, h = totals.get(n, (0.0, 0.0))
                    nodes[n] = float(self.rate * g / (h + self.penalty))
                else:
                    nodes[n] = split
                    further |= {2 * n, 2 * n + 1}
            open_ = further
            if not open_:
                break
        return nodes

    def _gains(self, of: dict[int, dict[int, tuple]], total) -> dict[tuple[int, int], float]:
        value, out = lambda g, h: g * g / (h + self.penalty), {}
        for i, bins in of.items():
            g = h = 0.0
            for b in sorted(bins)[:-1]:
                g, h = g + bins[b][0], h + bins[b][1]
                out[i, b] = value(g, h) + value(total[0] - g, total[1] - h) - value(*total)
        return out

    def _node(self, nodes: dict, bin_of: Callable[[int], Column]) -> Column:
        """The node a row comes to."""

        def down(n: int) -> Column:
            if not isinstance(nodes.get(n), tuple):
                return F.lit(n)
            i, b = nodes[n]
            return F.when(bin_of(i) <= b, down(2 * n)).otherwise(down(2 * n + 1))

        return down(1)

    def _margin(self, df: DataFrame, bin_of: Callable[[int], Column]) -> Column:
        def down(nodes: dict, n: int) -> Column:
            if not isinstance(nodes[n], tuple):
                return F.lit(nodes[n])
            i, b = nodes[n]
            return F.when(bin_of(i) <= b, down(nodes, 2 * n)).otherwise(down(nodes, 2 * n + 1))

        return functools.reduce(lambda x, t: x + down(t, 1), self.forest, F.lit(float(self.base)))

    def transform(self, df):
        """df with prediction (and probability, if logistic); JVM expressions only."""
        names = {f"_b{i}": self._bin(c) for i, c in enumerate(self.columns)}
        out = df.withColumns(names).withColumn("_m", self._margin(df, lambda i: F.col(f"_b{i}"))).drop(*names)
        if self.loss == "squared":
            return out.withColumnRenamed("_m", "prediction")
        return out.withColumn("probability", 1 / (1 + F.exp(-F.col("_m")))).withColumn("prediction", (F.col("_m") > 0).cast("double")).drop("_m")

    def importances(self) -> dict[str, int]:
        """How many splits each feature has."""
        n = dict.fromkeys(self.columns, 0)
        for tree in self.forest:
            for node in tree.values():
                if isinstance(node, tuple):
                    n[self.columns[node[0]]] += 1
        return n

    def margin_of(self, values: dict[str, float]) -> float:
        """The margin of one row, on the driver."""
        bins = [sum(e < values[c] for e in self.edges[c]) if values[c] is not None else -1 for c in self.columns]
        total = self.base
        for nodes in self.forest:
            n = 1
            while isinstance(nodes[n], tuple):
                i, b = nodes[n]
                n = 2 * n + (bins[i] > b)
            total += nodes[n]
        return total


def catboost(columns: Sequence[str], label: str, loss: str = "squared", **settings) -> Boosted:
    return Boosted(columns, label, "oblivious", loss, **settings)


def explainable_boosting(columns: Sequence[str], label: str, loss: str = "squared", **settings) -> Boosted:
    return Boosted(columns, label, "additive", loss, **{"depth": 2, **settings})


# kernel machines: random features of a radial kernel, then a linear machine


@dataclass
class KernelMachine(Step):
    """A support vector machine ('classifier', labels 0 and 1) or regressor ('regressor', epsilon-insensitive) by subgradient steps
    on sums over all rows. kernel 'linear', 'poly' (degree 2) or 'rbf' (random Fourier features)."""

    columns: Sequence[str]
    label: str
    kind: str = "classifier"
    kernel: str = "rbf"
    gamma: float = 0.5
    features: int = 64
    penalty: float = 1e-3
    epsilon: float = 0.1
    steps: int = 30
    seed: int = 0
    weights: np.ndarray | None = None

    def _mapped(self) -> Column:
        x = [F.col(c).cast("double") for c in self.columns]
        if self.kernel == "linear":
            return F.array(F.lit(1.0), *x)
        if self.kernel == "poly":
            return F.array(F.lit(1.0), *x, *[a * b for a, b in itertools.combinations_with_replacement(x, 2)])
        r = np.random.default_rng(self.seed)
        w, b = r.normal(size=(self.features, len(x))) * math.sqrt(2 * self.gamma), r.random(self.features) * 2 * math.pi
        dot = lambda row: functools.reduce(lambda p, q: p + q, [float(v) * c for v, c in zip(row, x, strict=True)])
        return F.array(F.lit(1.0), *[F.cos(dot(w[k]) + float(b[k])) * math.sqrt(2 / self.features) for k in range(self.features)])

    def fit(self, df):
        y = F.col(self.label).cast("double")
        rows = df.select(self._mapped().alias("_z"), (2 * y - 1 if self.kind == "classifier" else y).alias("_y")).dropna().persist()
        try:
            size = rows.select(F.size("_z")).first()
            if size is None:
                raise ValueError("no rows to learn from")
            n, k = rows.count(), size[0]
            w, late = np.zeros(k), []
            for t in range(self.steps):
                g = np.zeros(k)
                sums = rows.mapInArrow(self._push(w), "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # a row a weight
                for r in sums:
                    g[r["i"]] = r["g"]
                w = w - (g / n + self.penalty * np.concatenate([[0.0], w[1:]])) * 2.0 / math.sqrt(1 + t)
                if 2 * t >= self.steps:  # the mean of the later weights is steadier than the last
                    late.append(w)
        finally:
            rows.unpersist()
        self.weights = np.mean(late, axis=0) if late else w
        return self

    def _push(self, w: np.ndarray):
        """A partition's sums of subgradients, by weight."""
        classifier, epsilon = self.kind == "classifier", self.epsilon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w))
            for batch in batches:
                z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                margin = z @ w
                push = np.where(y * margin < 1, -y, 0.0) if classifier else np.where(np.abs(margin - y) > epsilon, np.sign(margin - y), 0.0)
                total += push @ z
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)), pa.int32()), pa.array(total)], names=["i", "g"])

        return run

    def transform(self, df):
        margin = F.aggregate(F.zip_with(self._mapped(), F.array(*[F.lit(float(v)) for v in self.weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return df.withColumn("margin", margin).withColumn("prediction", (F.col("margin") > 0).cast("double") if self.kind == "classifier" else F.col("margin"))


# neighbours


def kd_order(df: DataFrame, columns: Sequence[str], leaves: int) -> tuple[DataFrame, list]:
    """df with `leaf`, and the splits (column, value) by node: halved at approximate medians, a column after another, until there
    are so many leaves. The tree is as small as its leaves; rows stay on the cluster."""
    tree: dict[int, tuple[str, float]] = {}
    levels = max(0, math.ceil(math.log2(max(1, leaves))))

    def leaf(n: int) -> Column:
        if n not in tree:
            return F.lit(n)
        c, v = tree[n]
        return F.when(F.col(c) <= v, leaf(2 * n)).otherwise(leaf(2 * n + 1))

    for level in range(levels):
        c = columns[level % len(columns)]
        for r in df.select(leaf(1).alias("n"), c).groupBy("n").agg(F.percentile_approx(c, 0.5).alias("v")).collect():
            if r["v"] is not None:
                tree[r["n"]] = (c, float(r["v"]))
    return df.withColumn("leaf", leaf(1)), sorted(tree.items())


def within_radius(df: DataFrame, queries: DataFrame, key: str, columns: Sequence[str], radius: float, digits: int | None = None) -> DataFrame:
    """(query, key, distance): rows within a distance of a query. Both sides are dealt to cells as wide as the radius, a query to
    those around its own too, so rows meet only those of the same cell; a cell's queries are dealt over several tasks. Rows of equal
    places meet as one and are written out after; `digits` rounds the distance before that."""
    cell = lambda c, side=0: F.floor(F.col(c) / radius).cast("long") + side
    places = lambda rows, name: _places(rows, key, columns).withColumnRenamed("_ids", name)
    deal = F.pmod(F.xxhash64(F.col("_to"), *columns), F.lit(8))
    left = places(df, "_x_ids").select("_x_ids", *[F.col(c).alias(f"_x_{c}") for c in columns], *[cell(c).alias(f"_c_{c}") for c in columns]).withColumn("_deal", F.explode(F.array(*[F.lit(i).cast("long") for i in range(8)])))
    right = places(queries, "_q_ids").select("_q_ids", deal.alias("_deal"), *[F.col(c).alias(f"_q_{c}") for c in columns], *[F.array(cell(c, -1), cell(c), cell(c, 1)).alias(f"_c_{c}") for c in columns])
    for c in columns:
        right = right.withColumn(f"_c_{c}", F.explode(f"_c_{c}"))
    distance = F.sqrt(functools.reduce(lambda a, b: a + b, [(F.col(f"_x_{c}") - F.col(f"_q_{c}")) * (F.col(f"_x_{c}") - F.col(f"_q_{c}")) for c in columns]))
    met = left.join(right, ["_deal", *[f"_c_{c}" for c in columns]]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    met = met if digits is None else met.withColumn("distance", F.round("distance", digits))
    return met.select(F.explode("_q_ids").alias("query"), "_x_ids", "distance").select("query", F.explode("_x_ids").alias(key), "distance")


def _places(rows: DataFrame, key: str, columns: Sequence[str], most: int = 4096) -> DataFrame:
    """(columns, _to, _ids): the keys of rows of equal places, in lists of some `most` at a place."""
    counted = rows.groupBy(*columns).agg(F.ceil(F.count(F.lit(1)) / most).alias("_lists"))
    dealt = rows.select(key, *columns).join(counted, list(columns)).withColumn("_to", F.pmod(F.xxhash64(key), F.col("_lists")))
    return dealt.groupBy(*columns, "_to").agg(F.collect_list(F.struct(key)).alias("_ids")).withColumn("_ids", F.col(f"_ids.{key}"))


@dataclass
class NeighbourGraph:
    """A layered graph of near neighbours (greedy search from a few entries, wider at the bottom), of points of one cell."""

    points: np.ndarray
    links: list[list[list[int]]]
    entry: int

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 12, width: int = 48, seed: int = 0) -> NeighbourGraph:
        r = np.random.default_rng(seed)
        levels = np.minimum(6, (-np.log(np.maximum(r.random(len(points)), 1e-12)) / math.log(degree)).astype(int))
        out = cls(points, [[[] for _ in points] for _ in range(int(levels.max(initial=0)) + 1)], 0)
        top = -1
        for i in range(len(points)):
            at = [out.entry]
            if i:
                for level in range(top, levels[i], -1):
                    at = [n for _, n in out._layer(points[i], at, level, 1)]
                for level in range(min(top, int(levels[i])), -1, -1):
                    near = out._layer(points[i], at, level, width)
                    at = [n for _, n in near]
                    for _, n in near[:degree]:
                        out.links[level][i].append(n)
                        back = out.links[level][n]
                        back.append(i)
                        if len(back) > 2 * degree:
                            d = ((points[back] - points[n]) ** 2).sum(1)
                            out.links[level][n] = [back[k] for k in np.argsort(d, kind="stable")[: 2 * degree]]
            if levels[i] > top:
                top, out.entry = int(levels[i]), i
        return out

    def _layer(self, q: np.ndarray, entries: list[int], level: int, width: int) -> list[tuple[float, int]]:
        import heapq

        seen = set(entries)
        dist = lambda n: float(((self.points[n] - q) ** 2).sum())
        open_ = [(dist(n), n) for n in entries]
        heapq.heapify(open_)
        best = [(-d, n) for d, n in open_]
        heapq.heapify(best)
        while open_:
            d, n = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [x for x in self.links[level][n] if x not in seen]
            seen.update(new)
            for x, dx in zip(new, ((self.points[new] - q) ** 2).sum(1).tolist() if new else (), strict=True):
                if len(best) < width or dx < -best[0][0]:
                    heapq.heappush(open_, (dx, x))
                    heapq.heappush(best, (-dx, x))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, width: int = 64) -> list[tuple[float, int]]:
        """(distance, number) of about the k nearest."""
        at = [self.entry]
        for level in range(len(self.links) - 1, 0, -1):
            at = [n for _, n in self._layer(q, at, level, 1)] or at
        return [(math.sqrt(d), n) for d, n in self._layer(q, at, 0, max(width, k))[:k]]


def hnsw_search(rows: DataFrame, queries: DataFrame, k: int, cell_rows: int = 20_000, most_queries: int = 10_000) -> DataFrame:
    """(query, id, distance): about the k nearest rows of each query; both are (id, vector). Rows are dealt by hash to cells of
    `cell_rows`, each a graph of its own; all are asked, and the best of every cell merged."""
    asked = queries.limit(most_queries + 1).toPandas()
    if len(asked) > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    cells = max(1, -(-rows.count() // cell_rows))
    shared = rows.sparkSession.sparkContext.broadcast((asked["id"].tolist(), [np.asarray(v, dtype=float) for v in asked["vector"]]))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, points = part["id"].to_numpy(), np.stack([np.asarray(v, dtype=float) for v in part["vector"]])
        graph, out = NeighbourGraph.build(points), []
        for q, v in zip(*shared.value, strict=True):
            out += [(q, int(ids[n]), d) for d, n in graph.search(v, k)]
        return pd.DataFrame(out, columns=["query", "id", "distance"])

    from pyspark.sql import Window

    found = rows.withColumn("_cell", F.pmod(F.xxhash64("id"), F.lit(cells))).groupBy("_cell").applyInPandas(run, "query long, id long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")


# hierarchies and maps of few points


def agglomerate(points: np.ndarray, clusters: int, linkage: str = "average") -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Labels and merges (a, b, distance) of at most 5,000 points: the two nearest groups are merged until so many are left.
    linkage: single, complete, average or ward."""
    n = len(points)
    if n > 5000:
        raise ValueError("more than 5,000 points: cluster a sample, or group points first")
    d = np.sqrt(np.maximum(0, ((points[:, None, :] - points[None, :, :]) ** 2).sum(2))) if n <= 1500 else np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in points])
    if linkage == "ward":
        d = d**2 / 2
    np.fill_diagonal(d, np.inf)
    size, alive, name = np.ones(n), np.ones(n, bool), list(range(n))
    groups, merges = {i: [i] for i in range(n)}, []
    while len(groups) > max(1, clusters):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        merges.append((name[i], name[j], float(math.sqrt(2 * d[i, j]) if linkage == "ward" else d[i, j])))
        a, b = d[i], d[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.where(alive, np.maximum(a, b), np.inf)
        elif linkage == "average":
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            new = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        size[i] += size[j]
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = new, new, np.inf, np.inf
        groups[i] += groups.pop(j)
        name[i] = n + len(merges) - 1
    labels = np.empty(n, dtype=int)
    for k, (_, members) in enumerate(sorted(groups.items())):
        labels[members] = k
    return labels, merges


def tsne(points: np.ndarray, perplexity: float = 20.0, rounds: int = 250, seed: int = 0) -> np.ndarray:
    """Two coordinates a point, of at most 5,000."""
    n = len(points)
    if n > 5000:
        raise ValueError("more than 5,000 points: map a sample")
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2) if n <= 1500 else np.stack([((points - p) ** 2).sum(1) for p in points])
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n) / max(1e-12, np.median(d))
    off, want = ~np.eye(n, dtype=bool), math.log(min(perplexity, max(1.0, (n - 1) / 3)))
    for _ in range(50):
        p = np.exp(-(d - np.where(off, d, np.inf).min(1, keepdims=True)) * beta[:, None]) * off
        p /= p.sum(1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > want
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = (p + p.T) / (2 * n)
    y, step, gain = np.random.default_rng(seed).normal(0, 1e-2, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for t in range(rounds):
        q = 1 / (1 + ((y[:, None, :] - y[None, :, :]) ** 2).sum(2)) * off
        pull = ((4 if t < rounds // 4 else 1) * p - q / q.sum()) * q
        grad = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(0.01, np.where(np.sign(grad) == np.sign(step), gain * 0.8, gain + 0.2))
        step = (0.5 if t < rounds // 4 else 0.8) * step - max(10.0, n / 12) * gain * grad
        y = y + step
        y -= y.mean(0)
    return y


# isolation


@dataclass
class IsolationForest(Step):
    """Trees of random splits, each on a sample of rows; points that few splits set apart are odd."""

    columns: Sequence[str]
    key: str
    trees: int = 50
    sample: int = 256
    seed: int = 0
    forest: list = field(default_factory=list)

    def fit(self, df):
        rows = sampled(df.dropna(subset=list(self.columns)), self.columns, self.key, self.trees * self.sample)[list(self.columns)].to_numpy(float)
        r = np.random.default_rng(self.seed)
        self.forest = []
        for _ in range(self.trees if len(rows) else 0):
            own = rows[r.choice(len(rows), min(self.sample, len(rows)), replace=False)]
            self.forest.append(self._tree(own, r, math.ceil(math.log2(max(2, self.sample)))))
        return self

    def _tree(self, rows: np.ndarray, r, depth: int):
        wide = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
        if not depth or not len(wide):
            return len(rows)
        c = int(r.choice(wide))
        v = float(r.uniform(rows[:, c].min(), rows[:, c].max()))
        return c, v, self._tree(rows[rows[:, c] < v], r, depth - 1), self._tree(rows[rows[:, c] >= v], r, depth - 1)

    @staticmethod
    def _expected(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def transform(self, df):
        """df with anomaly_score, from 0 to 1; null where a column is."""
        forest, columns, scale = self.forest, list(self.columns), self._expected(self.sample)
        expected = self._expected

        @F.pandas_udf("double")
        def score(*values: pd.Series) -> pd.Series:
            x = np.column_stack([v.to_numpy(float) for v in values])
            depth = np.zeros(len(x))

            def walk(node, rows: np.ndarray, d: int) -> None:
                if not len(rows):
                    return
                if isinstance(node, tuple):
                    c, v, a, b = node
                    left = x[rows, c] < v
                    walk(a, rows[left], d + 1)
                    walk(b, rows[~left], d + 1)
                else:
                    depth[rows] += d + expected(node)

            for tree in forest:
                walk(tree, np.arange(len(x)), 0)
            out = pd.Series(2.0 ** (-depth / max(1, len(forest)) / max(scale, 1e-9)))
            return out.where(~np.isnan(x).any(1) & bool(forest))

        return df.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in columns]))


# search over settings


def cross_val_score(df: DataFrame, make: Callable[[], Step], label: str, key: str, k: int = 3, metric: str = "r2") -> list[float]:
    """The score of each fold, of a step fitted on the others. metric: r2, neg_mse or accuracy."""
    rows, out = M.folds(df, key, k), []
    for f in range(k):
        done = make().fit(rows.filter(F.col("fold") != f)).transform(rows.filter(F.col("fold") == f))
        y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col("prediction")
        score = {"r2": 1 - F.sum(e * e) / (F.var_pop(y) * F.count(y)), "neg_mse": -F.avg(e * e), "accuracy": F.avg((F.col("prediction") == y).cast("double"))}[metric]
        out.append(done.agg(score.alias("s")).first()["s"])
    return out


def random_search_cv(df: DataFrame, make: Callable[..., Step], space: dict[str, Sequence], tries: int, label: str, key: str, k: int = 3, metric: str = "r2", seed: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """The best settings, and all that were tried with their mean scores. A value of space is a list to choose from, or (low, high)
    of floats to draw between."""
    r, tried = np.random.default_rng(seed), []
    for _ in range(tries):
        own = {n: float(r.uniform(*v)) if isinstance(v, tuple) and len(v) == 2 and all(isinstance(x, float) for x in v) else v[int(r.integers(len(v)))] for n, v in space.items()}
        tried.append((own, float(np.mean(cross_val_score(df, lambda own=own: make(**own), label, key, k, metric)))))
    return max(tried, key=lambda t: t[1])[0], tried


def pipeline_optimize(df: DataFrame, candidates: dict[str, tuple[Callable[..., Step], dict]], tries: int, label: str, key: str, metric: str = "r2") -> tuple[str, dict, list]:
    """The best of several kinds of models, each searched at random: (name, settings, all (name, settings, score))."""
    every = []
    for name, (make, space) in candidates.items():
        every += [(name, own, score) for own, score in random_search_cv(df, make, space, tries, label, key, metric=metric)[1]]
    best = max(every, key=lambda t: t[2])
    return best[0], best[1], every


# explanations


def shapley(value: Callable[[frozenset], float], features: Sequence[str]) -> dict[str, float]:
    """Exact Shapley values of a set function, of at most 12 features."""
    n = len(features)
    if n > 12:
        raise ValueError("more than 12 features")
    known = {s: value(s) for k in range(n + 1) for s in map(frozenset, itertools.combinations(features, k))}
    weight = lambda k: math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
    return {f: sum(weight(len(s)) * (v2 - known[s]) for s, v2 in ((s, known[s | {f}]) for s in known if f not in s)) for f in features}


def tree_shap(model: Boosted, row: dict[str, float], background: Sequence[dict[str, float]]) -> dict[str, float]:
    """Shapley values of a boosted model's margin at a row, features that are out taking the background rows' values."""
    mean = lambda s: float(np.mean([model.margin_of({c: row[c] if c in s else b[c] for c in model.columns}) for b in background]))
    return shapley(mean, list(model.columns))


def kernel_shap(predict: Callable[[np.ndarray], np.ndarray], row: np.ndarray, background: np.ndarray, most: int = 2048, seed: int = 0) -> np.ndarray:
    """Shapley values by weighted least squares over sets of features (all sets, if they are at most `most`)."""
    n, r = len(row), np.random.default_rng(seed)
    sets = np.array(list(itertools.product((0, 1), repeat=n)), dtype=float)[1:-1] if 2**n - 2 <= most else (r.random((most, n)) < r.random((most, 1))).astype(float)
    sets = sets[(sets.sum(1) > 0) & (sets.sum(1) < n)]
    k = sets.sum(1)
    weight = np.array([(n - 1) / (math.comb(n, int(x)) * x * (n - x)) for x in k]) if 2**n - 2 <= most else np.ones(len(sets))
    base, full = float(predict(background).mean()), float(predict(row[None])[0])
    values = np.array([float(predict(np.where(s > 0, row, background)).mean()) for s in sets]) - base
    # the last one's value follows from the sum of all
    x, y = sets[:, :-1] - sets[:, -1:], values - sets[:, -1] * (full - base)
    phi = np.linalg.lstsq(x * np.sqrt(weight)[:, None], y * np.sqrt(weight), rcond=None)[0]
    return np.append(phi, full - base - phi.sum())


def lime(predict: Callable[[np.ndarray], np.ndarray], row: np.ndarray, scale: np.ndarray, samples: int = 1000, width: float = 0.75, seed: int = 0) -> tuple[float, np.ndarray]:
    """(intercept, weights) of a linear model of the prediction near a row, points weighted by nearness."""
    z = np.random.default_rng(seed).normal(size=(samples, len(row)))
    w = np.sqrt(np.exp(-(z**2).sum(1) / (width**2 * len(row))))
    x = np.column_stack([np.ones(samples), z])
    a = (x * w[:, None]).T @ (x * w[:, None]) + 1e-6 * np.eye(len(row) + 1)
    beta = np.linalg.solve(a, (x * w[:, None]).T @ (predict(row + z * scale) * w))
    return float(beta[0]), beta[1:] / scale


def uniform_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """A share of rows by a hash of their key."""
    return df.filter(D.uniform_of(key, seed) < share)
