"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector serves all ordered thresholds. x holds log(1 + tf) of chosen
features of a text: its lower-cased words and their character 4- and 5-grams, word ends marked. Features are all those more common in documents labelled toxic, by a likelihood ratio that holds against the number of features tried; the sample bounds their number.
The expected grade, sum over k of P(grade > k), is the severity; a document is toxic where P(grade > 0) reaches a threshold (0.25:
the few who are labelled toxic are missed more easily than clean documents are mistaken).

The model is fitted on a bounded sample of labelled documents (`sample`, those with the smallest hashes of doc_id); all
documents are scored whole. Labels are 0/1, so grades are derived: 0 is a document labelled clean; the toxic ones are dealt
into grades 1..K by how surely toxic a model finds them that was fitted on the other half of the sample (halves by text, so that
copies are in one).

Defined results: a null or empty text has no features and gets the model's grade for that; without any toxic label (an empty
labels table, one class) nothing is toxic and severity is 0; null labels and labels of a null doc_id don't count; a doc_id labelled
twice counts as toxic if either says so; rows that repeat are scored each, and of labelled ones each counts; a null doc_id is
scored like any other; a very long text is gone through token by token, its counts being as many as there are features; an empty
table gives none; columns of other names pass or don't matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, remembered, whole_text

_WORD = re.compile(r"\w+")
#: Words a worker remembers the features of.
REMEMBERED = 300_000


def features(token: str) -> set[str]:
    """Features of a blank-separated token."""
    out = set()
    for word in _WORD.findall(token.lower()):
        marked = f"^{word}$"
        out.add(marked)
        for n in (4, 5):
            out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


@dataclass
class Model:
    """theta: ascending thresholds, one less than the grades."""

    weights: dict[str, float] = field(default_factory=dict)
    theta: tuple[float, ...] = ()

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of linear predictors x."""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.theta)[None, :] - x[:, None], -500, 500)))


class Counts:
    """Chosen features of texts, with the features of a word looked up once."""

    def __init__(self, chosen: dict[str, int]):
        self.chosen, self.known = chosen, {}

    def __call__(self, text: str) -> Counter:
        found, known = Counter(), self.known
        for token in text.split():
            own = known.get(token)
            if own is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                own = known[token] = tuple(sorted(self.chosen[f] for f in features(token) if f in self.chosen))
            if own:
                found.update(own)
        return found


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled documents."""
    one = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so it is small enough to broadcast
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"))
    return texts.join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def choose(rows: DataFrame) -> list[str]:
    """Features more common in toxic texts, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity")
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in (0, 1))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = set()
                for token in set(text.as_py().split()):
                    own |= features(token)
                for f in own:
                    seen[f][toxic] += 1
                if len(seen) > 1_000_000:
                    yield out()
        yield out()

    n = {x["toxic"]: x["n"] for x in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = float(n.get(1, 0)), float(n.get(0, 0))
    if not a or not b:
        return []
    table = rows.select("text", "toxic").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    # features below three toxic documents can't reach the bound; the rest are counted, tested against that number and ranked
    table = table.filter("t >= 3")
    p, share = (F.col("t") + F.col("c")) / (a + b), lambda x, total: x * F.log((x + 1e-9) / total)
    ratio = 2 * (share(F.col("t"), a * p) + share(F.col("c"), b * p) + share(a - F.col("t"), a * (1 - p) + 1e-9) + share(b - F.col("c"), b * (1 - p) + 1e-9))
    table = table.withColumn("ratio", ratio).filter((F.col("t") / a > 4 * F.col("c") / b))
    tried = max(2, table.count())
    best = table.filter(F.col("ratio") > 2 * math.log(tried)).orderBy(F.desc("ratio"), "feature")
    return [x["feature"] for x in best.select("feature").collect()]


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, ridge: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds, by Adam on the mean log likelihood; thresholds are kept in order by their gaps."""
    k, n = int(grades.max()), len(grades)
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    value = np.array([v for r in rows for v in r.values()])
    above = np.array([(grades > j).mean() for j in range(k)]).clip(1e-6, 1 - 1e-6)
    start = np.log((1 - above) / above)
    free = np.concatenate([np.zeros(n_features), start[:1], np.log(np.diff(start) + 1e-3)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        w, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        theta = free[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(at, weights=w[feature] * value, minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(edge[grades + 1] - x), sigmoid(edge[grades] - x)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dx = dhi - dlo  # of the negative log likelihood
        g = np.zeros_like(free)
        g[:n_features] = np.bincount(feature, weights=dx[at] * value, minlength=n_features) / n + ridge * w
        dtheta = np.array([-(dhi * (grades == j)).sum() + (dlo * (grades == j + 1)).sum() for j in range(k)]) / n
        g[n_features] = dtheta.sum()
        for j in range(1, k):
            g[n_features + j] = dtheta[j:].sum() * gaps[j - 1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return free[:n_features], free[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(free[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, grades: int = 3) -> Model:
    """The model of `grades` ordered grades from 0."""
    rows = cut(labelled(docs, labels, sample), "labelled")
    names = choose(rows)
    if not names:
        return Model()
    chosen = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity")
        count = Counts(chosen.value)
        for batch in batches:
            found = [count(x.as_py()) for x in batch.column(0)]
            lists = [pa.array([list(of(x)) for x in found], pa.list_(pa.int32())) for of in (Counter.keys, Counter.values)]
            half = pa.array([zlib.crc32(x.as_buffer()) & 1 for x in batch.column(0)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), half, *lists], names=["toxic", "half", "f", "n"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, half int, f array<int>, n array<int>").collect()  # at most `sample` rows of chosen features
    toxic, half = (np.array([x[c] for x in got]) for c in ("toxic", "half"))
    inputs = [{f: math.log1p(n) for f, n in zip(x["f"], x["n"], strict=True)} for x in got]
    sure = np.array([sum(x.values()) for x in inputs], dtype=float)
    if all(len(set(toxic[half == k].tolist())) == 2 for k in (0, 1)):
        for k in (0, 1):
            w, theta = fit_ordinal([x for x, h in zip(inputs, half, strict=True) if h != k], toxic[half != k], len(names))
            own = np.flatnonzero(half == k)
            sure[own] = [sum(w[f] * v for f, v in inputs[i].items()) - theta[0] for i in own]
    edges = np.quantile(sure[toxic > 0], np.arange(1, grades - 1) / (grades - 1))
    grade = np.where(toxic > 0, 1 + np.searchsorted(edges, sure, side="left"), 0)
    _, grade = np.unique(grade, return_inverse=True)  # a grade that nobody has is left out
    w, theta = fit_ordinal(inputs, grade, len(names))
    return Model(dict(zip(names, w.tolist(), strict=True)), tuple(theta.tolist()))


def score(docs: DataFrame, model: Model, threshold: float = 0.25) -> DataFrame:
    """doc_id, severity (expected grade), grade (most likely), p_toxic, toxic; one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity")
        weigh = _Weigher(shared.value)
        for batch in batches:
            severity, grade, p = weigh([x.as_py() for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(grade), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


class _Weigher:
    def __init__(self, model: Model):
        self.model, self.count = model, Counts({f: i for i, f in enumerate(model.weights)})
        self.w = np.array(list(model.weights.values()))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.model.theta:
            zero = np.zeros(len(texts))
            return zero, zero.astype(np.int32), zero
        x = np.array([sum(self.w[f] * math.log1p(n) for f, n in self.count(t).items()) for t in texts], dtype=float)
        above = self.model.above(x)
        each = -np.diff(np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))]), axis=1)
        return above.sum(1), each.argmax(1).astype(np.int32), above[:, 0]


def clean(docs: DataFrame, model: Model, threshold: float = 0.25) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns; no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity")
        weigh = _Weigher(shared.value)
        for batch in batches:
            p = weigh([x.as_py() or "" for x in batch.column(at)])[2]
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
