"""Tensors as coordinate tables: a column per axis, named after it, and the value in v. Entries that aren't there are zero.

Element-wise work is expressions, reductions and contractions are grouped sums and joins on shared axes, so a tensor is as large as
its table may be. Shapes are kept beside the table. Decompositions iterate over factors on the driver: factors are as small as
axis length times rank, and each step's sums over the tensor are one aggregate.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells that may come to the driver.
DENSE = 1_000_000


@dataclass(frozen=True)
class SliceRange:
    """Positions from start up to stop, every step-th."""

    start: int = 0
    stop: int | None = None
    step: int = 1

    def where(self, axis: str) -> Column:
        c = (F.col(axis) >= self.start) & ((F.col(axis) - self.start) % self.step == 0)
        return c if self.stop is None else c & (F.col(axis) < self.stop)

    def length(self, n: int) -> int:
        return max(0, -(-(min(n, n if self.stop is None else self.stop) - self.start) // self.step))


@dataclass(frozen=True)
class Tensor:
    """df(axes..., v) and the length of each axis."""

    df: DataFrame
    axes: tuple[str, ...]
    shape: tuple[int, ...]

    @property
    def ndim(self) -> int:
        return len(self.axes)

    @property
    def numel(self) -> int:
        return math.prod(self.shape)

    def nnz(self) -> int:
        return self.df.filter("v <> 0").count()

    def density(self) -> float:
        return self.nnz() / self.numel if self.numel else 0.0

    def _with(self, df: DataFrame, axes: Sequence[str] | None = None, shape: Sequence[int] | None = None) -> Tensor:
        axes, shape = tuple(self.axes if axes is None else axes), tuple(self.shape if shape is None else shape)
        return Tensor(df.select(*axes, "v"), axes, shape)

    def dim_index(self, axis: str) -> int:
        return self.axes.index(axis)

    def length(self, axis: str) -> int:
        return self.shape[self.dim_index(axis)]

    # element-wise

    def map(self, f: Callable[[Column], Column]) -> Tensor:
        """f of each entry; for an f that isn't 0 at 0, of dense() first."""
        return self._with(self.df.withColumn("v", f(F.col("v"))))

    def cast_to(self, kind: str) -> Tensor:
        return self.map(lambda v: v.cast(kind))

    def scalar_mul(self, a: float) -> Tensor:
        return self.map(lambda v: v * a)

    def zip_map(self, other: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
        """f of entries in the same place, which are joined; one that is missing is 0."""
        if self.axes != other.axes or self.shape != other.shape:
            raise ValueError("axes and shapes differ")
        both = self.df.join(other.df.withColumnRenamed("v", "w"), list(self.axes), "full")
        return self._with(both.withColumn("v", f(F.coalesce("v", F.lit(0.0)), F.coalesce("w", F.lit(0.0)))))

    def add(self, other: Tensor) -> Tensor:
        return self._with(self.df.unionByName(other.df).groupBy(*self.axes).agg(F.sum("v").alias("v")))

    def coalesce(self) -> Tensor:
        """Entries of one place summed, zeros left out."""
        return self._with(self.df.groupBy(*self.axes).agg(F.sum("v").alias("v")).filter("v <> 0"))

    def dense(self) -> Tensor:
        """All places, zeros written."""
        spark, grid, n = self.df.sparkSession, F.col("id"), self.numel
        names, rest = [], n
        places = spark.range(n)
        for axis, length in zip(self.axes, self.shape, strict=True):
            rest //= max(1, length)
            names.append((F.floor(grid / rest) % length).cast("long").alias(axis))
        return self._with(places.select(*names).join(self.df, list(self.axes), "left").withColumn("v", F.coalesce("v", F.lit(0.0))))

    # choosing

    def slice(self, **ranges: SliceRange) -> Tensor:
        df, shape = self.df, list(self.shape)
        for axis, r in ranges.items():
            df = df.filter(r.where(axis)).withColumn(axis, F.floor((F.col(axis) - r.start) / r.step).cast("long"))
            shape[self.dim_index(axis)] = r.length(self.length(axis))
        return self._with(df, shape=shape)

    def select(self, axis: str, at: int) -> Tensor:
        """One position of an axis, which goes."""
        left = [(a, n) for a, n in zip(self.axes, self.shape, strict=True) if a != axis]
        return self._with(self.df.filter(F.col(axis) == at), [a for a, _ in left], [n for _, n in left])

    def index_select(self, axis: str, positions: Sequence[int]) -> Tensor:
        """Positions of an axis in the order given, which may repeat them."""
        places = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("p"), F.lit(k).cast("long").alias("k")) for k, p in enumerate(positions)]))
        df = self.df.withColumn("_at", places).filter(F.col("_at.p") == F.col(axis)).withColumn(axis, F.col("_at.k"))
        shape = [len(positions) if a == axis else n for a, n in zip(self.axes, self.shape, strict=True)]
        return self._with(df, shape=shape)

    def masked_select(self, test: Callable[[Column], Column]) -> DataFrame:
        """The entries (axes, v) that pass."""
        return self.df.filter(test(F.col("v")))

    def masked_put(self, test: Callable[[Column], Column], value: float) -> Tensor:
        return self.map(lambda v: F.when(test(v), F.lit(float(value))).otherwise(v))

    def index_put(self, entries: DataFrame) -> Tensor:
        """Entries (axes, v) written over what is there."""
        return self._with(self.df.join(entries, list(self.axes), "left_anti").unionByName(entries.select(*self.axes, "v")))

    def gather(self, axis: str, positions: Tensor) -> Tensor:
        """The entry at positions' v along an axis, the other axes being the same."""
        wanted = positions.df.withColumnsRenamed({axis: "_to", "v": axis}).withColumn(axis, F.col(axis).cast("long"))
        return self._with(wanted.join(self.df, list(self.axes), "left").drop(axis).withColumnRenamed("_to", axis).withColumn("v", F.coalesce("v", F.lit(0.0))), shape=positions.shape)

    # reshaping

    def _flat(self) -> Column:
        """The place in row-major order."""
        place = F.lit(0).cast("long")
        for axis, n in zip(self.axes, self.shape, strict=True):
            place = place * n + F.col(axis)
        return place

    def flatten(self, axis: str = "i") -> Tensor:
        return self.reshape({axis: self.numel})

    def reshape(self, lengths: dict[str, int]) -> Tensor:
        if math.prod(lengths.values()) != self.numel:
            raise ValueError("the number of places differs")
        df, rest, columns = self.df.withColumn("_place", self._flat()), self.numel, []
        for axis, n in lengths.items():
            rest //= max(1, n)
            columns.append((F.floor(F.col("_place") / rest) % n).cast("long").alias(axis))
        return Tensor(df.select(*columns, "v"), tuple(lengths), tuple(lengths.values()))

    def permute(self, *axes: str) -> Tensor:
        return self._with(self.df, axes, [self.length(a) for a in axes])

    align_to = permute

    def transpose(self) -> Tensor:
        return self.permute(*reversed(self.axes))

    def rename(self, **names: str) -> Tensor:
        return Tensor(self.df.withColumnsRenamed(names), tuple(names.get(a, a) for a in self.axes), self.shape)

    def unsqueeze(self, axis: str) -> Tensor:
        return Tensor(self.df.select(F.lit(0).cast("long").alias(axis), *self.axes, "v"), (axis, *self.axes), (1, *self.shape))

    def squeeze(self) -> Tensor:
        left = [(a, n) for a, n in zip(self.axes, self.shape, strict=True) if n != 1]
        return self._with(self.df, [a for a, _ in left], [n for _, n in left])

    # reductions and order

    def reduce(self, axis: str | None, f: Callable[[str], Column] = F.sum) -> Tensor:
        """f of the entries along an axis (of all, without one)."""
        left = [a for a in self.axes if axis is not None and a != axis]
        return Tensor(self.df.groupBy(*left).agg(f("v").alias("v")), tuple(left), tuple(self.length(a) for a in left))

    def sum_dim(self, axis: str) -> Tensor:
        return self.reduce(axis)

    def mean_dim(self, axis: str) -> Tensor:
        return self.reduce(axis).scalar_mul(1 / self.length(axis))

    def sort_axis(self, axis: str) -> Tensor:
        """Values ascending along an axis; of a dense tensor."""
        return self._ranked(axis, F.col("v"))

    def argsort_axis(self, axis: str) -> Tensor:
        """Where along the axis the k-th smallest stands."""
        return self._ranked(axis, F.col(axis).cast("double"))

    def _ranked(self, axis: str, value: Column) -> Tensor:
        w = Window.partitionBy(*[a for a in self.axes if a != axis]).orderBy("v", axis)
        return self._with(self.df.withColumn("_n", (F.row_number().over(w) - 1).cast("long")).withColumn("v", value).withColumn(axis, F.col("_n")))

    # small ones on the driver

    def numpy(self) -> np.ndarray:
        if self.numel > DENSE:
            raise ValueError(f"{self.numel} cells are too many for the driver")
        out = np.zeros(self.shape)
        for r in self.df.collect():
            out[tuple(r[a] for a in self.axes)] += r["v"]
        return out


def of_array(spark: SparkSession, array: np.ndarray, axes: Sequence[str]) -> Tensor:
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(np.asarray(array, dtype=float)) if v]
    return Tensor(spark.createDataFrame(rows, ", ".join([*(f"{a} long" for a in axes), "v double"])), tuple(axes), tuple(np.shape(array)))


def full(spark: SparkSession, lengths: dict[str, int], value: float) -> Tensor:
    empty = Tensor(spark.range(0).select(*[F.col("id").alias(a) for a in lengths], F.lit(0.0).alias("v")), tuple(lengths), tuple(lengths.values()))
    return empty.dense().map(lambda v: v + value)


def zeros(spark: SparkSession, lengths: dict[str, int]) -> Tensor:
    return full(spark, lengths, 0.0)


def ones(spark: SparkSession, lengths: dict[str, int]) -> Tensor:
    return full(spark, lengths, 1.0)


def eye(spark: SparkSession, n: int, axes: tuple[str, str] = ("i", "j")) -> Tensor:
    return Tensor(spark.range(n).select(F.col("id").alias(axes[0]), F.col("id").alias(axes[1]), F.lit(1.0).alias("v")), axes, (n, n))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0, axis: str = "i") -> Tensor:
    n = max(0, math.ceil((stop - start) / step))
    return Tensor(spark.range(n).select(F.col("id").alias(axis), (F.col("id") * step + start).alias("v")), (axis,), (n,))


def linspace(spark: SparkSession, start: float, stop: float, n: int, axis: str = "i") -> Tensor:
    return Tensor(spark.range(n).select(F.col("id").alias(axis), (F.lit(float(start)) + F.col("id") * ((stop - start) / max(1, n - 1))).alias("v")), (axis,), (n,))


def concat(tensors: Sequence[Tensor], axis: str) -> Tensor:
    """Along an axis that all have."""
    first, at, parts = tensors[0], 0, []
    for t in tensors:
        parts.append(t.df.withColumn(axis, F.col(axis) + at).select(*first.axes, "v"))
        at += t.length(axis)
    return first._with(functools.reduce(DataFrame.unionAll, parts), shape=[at if a == axis else n for a, n in zip(first.axes, first.shape, strict=True)])


def stack(tensors: Sequence[Tensor], axis: str) -> Tensor:
    return concat([t.unsqueeze(axis) for t in tensors], axis)


# contractions


def parse_subscripts(subscripts: str, n: int) -> tuple[list[str], str]:
    """'ij,jk->ik' as inputs and output; without an output, the letters that occur once, in order."""
    left, arrow, out = subscripts.replace(" ", "").partition("->")
    inputs = left.split(",")
    if len(inputs) != n or not all(re.fullmatch("[a-z]*", x) for x in [*inputs, out]):
        raise ValueError(f"subscripts {subscripts} don't fit {n} operands")
    if not arrow:
        out = "".join(sorted(x for x in set("".join(inputs)) if "".join(inputs).count(x) == 1))
    return inputs, out


def _lettered(t: Tensor, letters: str) -> Tensor:
    """Axes by letter; a letter that is there twice takes the diagonal."""
    df, seen = t.df, {}
    for axis, x in zip(t.axes, letters, strict=True):
        if x in seen:
            df = df.filter(F.col(seen[x]) == F.col(axis))
        else:
            seen[x] = axis
    return Tensor(df.select(*[F.col(a).alias(x) for x, a in seen.items()], "v"), tuple(seen), tuple(t.length(a) for a in seen.values()))


def _contracted(a: Tensor, b: Tensor, keep: set[str]) -> Tensor:
    """The product over shared axes, summed over those that nothing later needs."""
    shared = [x for x in a.axes if x in b.axes]
    lengths = dict(zip(a.axes, a.shape, strict=True)) | dict(zip(b.axes, b.shape, strict=True))
    right = b.df.withColumnRenamed("v", "w")
    # without a shared axis each entry meets each, as the outer product is
    joined = a.df.join(right, shared) if shared else a.df.crossJoin(right)
    out = [x for x in lengths if x in keep]
    return Tensor(joined.groupBy(*out).agg(F.sum(F.col("v") * F.col("w")).alias("v")), tuple(out), tuple(lengths[x] for x in out))


@dataclass(frozen=True)
class ContractionPair:
    """Positions of the operands contracted in a step; the result goes to the end."""

    i: int
    j: int


@dataclass(frozen=True)
class PathInfo:
    path: tuple[ContractionPair, ...]
    flops: float
    largest: int


def einsum_path(subscripts: str, shapes: Sequence[Sequence[int]], strategy: str = "greedy") -> PathInfo:
    """Which pairs to contract, by the number of products: step by step the cheapest (greedy) or the cheapest of all (optimal)."""
    inputs, out = parse_subscripts(subscripts, len(shapes))
    lengths = {x: n for letters, shape in zip(inputs, shapes, strict=True) for x, n in zip(letters, shape, strict=True)}
    size = lambda letters: math.prod(lengths[x] for x in letters)

    def step(left: tuple[frozenset, ...], i: int, j: int) -> tuple[tuple[frozenset, ...], float, int]:
        both = left[i] | left[j]
        others = [x for k, x in enumerate(left) if k not in (i, j)]
        kept = frozenset(both & frozenset(out).union(*others))
        return (*others, kept), size(both), size(kept)

    def search(left: tuple[frozenset, ...]) -> tuple[float, int, tuple[ContractionPair, ...]]:
        if len(left) == 1:
            return 0.0, 0, ()
        found = []
        for i in range(len(left)):
            for j in range(i + 1, len(left)):
                new, flops, largest = step(left, i, j)
                found.append((flops, i, j, largest, new))
        if strategy == "greedy":
            found = [min(found, key=lambda x: x[:3])]
        best = None
        for flops, i, j, largest, new in found:
            more, widest, path = search(new)
            total = (flops + more, max(largest, widest), (ContractionPair(i, j), *path))
            best = total if best is None or total[0] < best[0] else best
        return best

    flops, largest, path = search(tuple(frozenset(x) for x in inputs))
    return PathInfo(path, flops, largest)


def einsum(subscripts: str, *tensors: Tensor, strategy: str = "greedy") -> Tensor:
    """Einstein summation along a contraction path; each step is a join and a grouped sum."""
    inputs, out = parse_subscripts(subscripts, len(tensors))
    left = [_lettered(t, x) for t, x in zip(tensors, inputs, strict=True)]
    for pair in einsum_path(subscripts, [t.shape for t in tensors], strategy).path:
        a, b = left[pair.i], left[pair.j]
        left = [t for k, t in enumerate(left) if k not in (pair.i, pair.j)]
        left.append(_contracted(a, b, set(out).union(*(t.axes for t in left))))
    last = left[0]
    if set(last.axes) != set(out):
        last = Tensor(last.df.groupBy(*out).agg(F.sum("v").alias("v")), tuple(out), tuple(last.length(x) for x in out))
    return last.permute(*out)


def unfold(t: Tensor, axis: str) -> Tensor:
    """A matrix (that axis, all others in row-major order)."""
    others = [a for a in t.axes if a != axis]
    return t.permute(axis, *others).reshape({axis: t.length(axis), "_rest" if axis != "_rest" else "rest": math.prod(t.length(a) for a in others)})


def mode_n_product(t: Tensor, matrix: Tensor, axis: str) -> Tensor:
    """matrix (rows, columns) times the axis, whose length becomes the number of rows."""
    rows, columns = matrix.axes
    right = matrix.df.select(F.col(rows).alias("_r"), F.col(columns).alias(axis), F.col("v").alias("w"))
    others = [a for a in t.axes if a != axis]
    df = t.df.join(right, axis).groupBy(*others, F.col("_r").alias(axis)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return t._with(df, shape=[matrix.shape[0] if a == axis else n for a, n in zip(t.axes, t.shape, strict=True)])


def khatri_rao(a: Tensor, b: Tensor) -> Tensor:
    """Column-wise Kronecker product of (i, r) and (j, r): (i * length of j + j, r)."""
    r = a.axes[1]
    right = b.df.select(F.col(b.axes[0]).alias("_j"), F.col(b.axes[1]).alias(r), F.col("v").alias("w"))
    df = a.df.join(right, r).select((F.col(a.axes[0]) * b.shape[0] + F.col("_j")).alias(a.axes[0]), r, (F.col("v") * F.col("w")).alias("v"))
    return Tensor(df, a.axes, (a.shape[0] * b.shape[0], a.shape[1]))


def _mttkrp(t: Tensor, factors: dict[str, np.ndarray], axis: str) -> np.ndarray:
    """Sums of entries times the other axes' factor rows: one aggregate, factors as literals of the plan."""
    rank = factors[axis].shape[1]
    df = t.df
    for a in t.axes:
        if a != axis:
            rows = df.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(factors[a])], f"{a} long, _f_{a} array<double>")
            df = df.join(F.broadcast(rows), a)  # axis length times rank numbers, as factors on the driver are
    products = [functools.reduce(lambda x, y: x * y, [F.col(f"_f_{a}")[r] for a in t.axes if a != axis], F.col("v")) for r in range(rank)]
    out = np.zeros((t.length(axis), rank))
    for row in df.groupBy(axis).agg(*[F.sum(p).alias(f"s{r}") for r, p in enumerate(products)]).collect():
        out[row[axis]] = [row[f"s{r}"] for r in range(rank)]
    return out


def _gram(factors: dict[str, np.ndarray], axis: str) -> np.ndarray:
    return functools.reduce(lambda x, y: x * y, [f.T @ f for a, f in factors.items() if a != axis])


def _bounded(t: Tensor, rank: int) -> None:
    if sum(t.shape) * rank > DENSE:
        raise ValueError("factors are too large for the driver")


def cp(t: Tensor, rank: int, rounds: int = 20, seed: int = 0, nonnegative: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Factors of unit columns by axis, and weights: alternating least squares, or multiplicative steps if nonnegative."""
    _bounded(t, rank)
    r = np.random.default_rng(seed)
    factors = {a: r.random((n, rank)) + 0.1 for a, n in zip(t.axes, t.shape, strict=True)}
    weights = np.ones(rank)
    for _ in range(rounds):
        for a in t.axes:
            sums, gram = _mttkrp(t, factors, a), _gram(factors, a)
            if nonnegative:
                factors[a] = factors[a] * sums / np.maximum(factors[a] @ gram, 1e-12)
            else:
                factors[a] = sums @ np.linalg.pinv(gram)
            if a != t.axes[-1]:
                norms = np.maximum(np.linalg.norm(factors[a], axis=0), 1e-300)
                factors[a] = factors[a] / norms
                if nonnegative:
                    factors[t.axes[-1]] = factors[t.axes[-1]] * norms
    weights = np.maximum(np.linalg.norm(factors[t.axes[-1]], axis=0), 1e-300)
    factors[t.axes[-1]] = factors[t.axes[-1]] / weights
    return factors, weights


def ntf(t: Tensor, rank: int, rounds: int = 50, seed: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Non-negative factors of a non-negative tensor."""
    return cp(t, rank, rounds, seed, nonnegative=True)


def tucker(t: Tensor, ranks: dict[str, int]) -> tuple[Tensor, dict[str, np.ndarray]]:
    """Core and orthonormal factors: leading eigenvectors of each unfolding's Gram matrix (a join and a grouped sum), then the
    axes projected on them."""
    _bounded(t, max(ranks.values()))
    factors, core = {}, t
    for a in t.axes:
        others = [x for x in t.axes if x != a]
        right = t.df.select(*others, F.col(a).alias("_b"), F.col("v").alias("w"))
        gram = np.zeros((t.length(a),) * 2)
        for row in t.df.join(right, others).groupBy(a, "_b").agg(F.sum(F.col("v") * F.col("w")).alias("g")).collect():
            gram[row[a], row["_b"]] = row["g"]
        values, vectors = np.linalg.eigh(gram)
        factors[a] = vectors[:, np.argsort(values)[::-1][: ranks[a]]]
        core = mode_n_product(core, of_array(t.df.sparkSession, factors[a].T, ("_r", "_c")), a)
    return core, factors


# types

#: Element types by width and kind, and their names in Spark.
TYPES = {"u8": "short", "u16": "int", "u32": "long", "u64": "decimal(20,0)", "i8": "byte", "i16": "short", "i32": "int", "i64": "long", "f32": "float", "f64": "double"}


def promote(a: str, b: str) -> str:
    """The element type of a result of two: floats win, unsigned ones stay so among themselves, mixed signs widen."""
    kinds = {a[0], b[0]}
    bits = lambda t: int(t[1:])
    if "f" in kinds:
        floats = [t for t in (a, b) if t[0] == "f"]
        others = [t for t in (a, b) if t[0] != "f"]
        wide = max(map(bits, floats))
        return "f64" if wide == 64 or any(bits(t) > 16 for t in others) else "f32"
    if len(kinds) == 1:
        return a if bits(a) >= bits(b) else b
    signed, unsigned = (a, b) if a[0] == "i" else (b, a)
    if bits(signed) > bits(unsigned):
        return signed
    return "f64" if bits(unsigned) == 64 else f"i{2 * bits(unsigned)}"


# complex numbers as struct<re, im>


def complex_of(re_: Column | float, im: Column | float = 0.0) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(lift(re_).cast("double").alias("re"), lift(im).cast("double").alias("im"))


def c_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def c_sub(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def c_mul(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def c_div(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_of((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def c_conj(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def c_norm(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def c_arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def c_polar(r: Column, phi: Column) -> Column:
    return complex_of(r * F.cos(phi), r * F.sin(phi))


def c_exp(a: Column) -> Column:
    return c_polar(F.exp(a["re"]), a["im"])


def c_ln(a: Column) -> Column:
    return complex_of(F.log(c_norm(a)), c_arg(a))


def c_sqrt(a: Column) -> Column:
    return c_polar(F.sqrt(c_norm(a)), c_arg(a) / 2)


def c_pow(a: Column, p: float) -> Column:
    return c_polar(F.pow(c_norm(a), F.lit(float(p))), c_arg(a) * p)


def from_interleaved(a: Column) -> Column:
    """array<double> re, im, re, im, ... as an array of complex numbers."""
    return F.transform(F.sequence(F.lit(0), (F.size(a) / 2).cast("int") - 1), lambda k: complex_of(F.get(a, 2 * k), F.get(a, 2 * k + 1)))


def to_interleaved(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda z: F.array(z["re"], z["im"])))
