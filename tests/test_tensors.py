"""Tensors, matrices and distributions against numpy and their own definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import distributions as D
from lumenframe.operators import linalg as L
from lumenframe.operators import tensors as T


def rebuilt(factors, weights, axes):
    letters = "abcd"[: len(axes)]
    return np.einsum(",".join(f"{x}z" for x in letters) + f",z->{letters}", *[factors[a] for a in axes], weights)


def test_decompositions_rebuild_a_tensor_of_low_rank(spark):
    r = np.random.default_rng(1)
    parts = [r.random((n, 2)) for n in (4, 3, 5)]
    array = np.einsum("az,bz,cz->abc", *parts)
    t = T.of_array(spark, array, "ijk")
    factors, weights = T.cp(t, 2, rounds=15)
    assert np.abs(rebuilt(factors, weights, "ijk") - array).max() < 0.1
    factors, weights = T.ntf(t, 2, rounds=12)
    assert all((f >= 0).all() for f in factors.values()) and np.abs(rebuilt(factors, weights, "ijk") - array).max() < 0.4
    core, factors = T.tucker(t, {"i": 2, "j": 2, "k": 2})
    assert np.abs(np.einsum("abc,ia,jb,kc->ijk", core.numpy(), *[factors[a] for a in "ijk"]) - array).max() < 1e-8


@pytest.mark.parametrize("subscripts", ["ij,jk,kl->il", "ij,ij->", "ii->i", "ij->ji", "i,j->ij", "ijk,k->ij", "ij,jk"])
def test_einsum_against_numpy(spark, subscripts):
    r = np.random.default_rng(2)
    lengths = dict(zip("ijkl", (3, 3, 4, 2), strict=True))
    arrays = [r.integers(-3, 4, [lengths[x] for x in letters]).astype(float) for letters in subscripts.split("->")[0].split(",")]
    tensors = [T.of_array(spark, a, [f"x{k}" for k in range(a.ndim)]) for a in arrays]
    for strategy in ("greedy", "optimal"):
        assert np.allclose(T.einsum(subscripts, *tensors, strategy=strategy).numpy(), np.einsum(subscripts, *arrays))


def test_paths_and_types():
    path = T.einsum_path("ij,jk,kl->il", [(2, 100), (100, 100), (100, 2)])
    assert path.path[0] == T.ContractionPair(0, 1) and path.flops == 2 * 100 * 100 + 2 * 100 * 2
    assert T.einsum_path("ij,jk,kl->il", [(100, 2), (2, 100), (100, 3)], "optimal").flops == 2 * 100 * 3 + 100 * 2 * 3
    with pytest.raises(ValueError):
        T.parse_subscripts("ij,jk->ik", 1)
    assert [T.promote(*x) for x in (("u8", "u16"), ("i8", "u8"), ("i32", "f32"), ("i16", "f32"), ("u64", "i64"), ("f32", "f64"), ("i64", "u8"))] == ["u16", "i16", "f64", "f32", "f64", "f64", "i64"]


def test_shapes_and_density(spark):
    array = np.arange(24.0).reshape(2, 3, 4)
    t = T.of_array(spark, array, "ijk")
    assert t.ndim == 3 and t.numel == 24 and t.nnz() == 23 and t.density() == 23 / 24
    assert (t.transpose().numpy() == array.T).all() and (t.flatten().numpy() == array.ravel()).all()
    assert (t.dense().map(lambda v: v + 1).numpy() == array + 1).all()
    assert (t.zip_map(t.scalar_mul(2), lambda a, b: a * b).numpy() == 2 * array * array).all()
    assert t.cast_to("int").df.dtypes[-1][1] == "int" and t.masked_select(lambda v: v > 20).count() == 3
    assert (t.rename(i="x").select("x", 1).numpy() == array[1]).all()
    with pytest.raises(ValueError):
        t.reshape({"a": 5})


def test_null_and_singular_matrices(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [2.0, 4.0]], [1.0, 1.0]), (None, None), ([[2.0, 0.0], [0.0, 2.0]], [2.0, 4.0])], "m array<array<double>>, b array<double>")
    got = df.select(L.solve("m", "b").alias("x"), L.inverse("m").alias("i"), L.cholesky("m").alias("c"), L.lu("m").alias("lu")).collect()
    assert [r.x for r in got] == [None, None, [1.0, 2.0]] and got[0].i is None and got[1].lu.l is None
    order, low, up = L.lu_of(np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 10]]))
    assert np.allclose(np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 10]])[order], low @ up)


ALL = [D.Uniform(1, 3), D.Normal(1, 2), D.LogNormal(0.2, 0.5), D.Exponential(2), D.Gamma(2.5, 1.5), D.ChiSquared(4), D.Beta(2, 3), D.StudentT(5), D.Cauchy(1, 2), D.Laplace(0, 2), D.Pareto(1, 3), D.Weibull(1.5, 2), D.Bernoulli(0.3), D.Binomial(10, 0.4), D.NegativeBinomial(3, 0.4), D.Poisson(3.5), D.Hypergeometric(20, 8, 6)]


@pytest.mark.parametrize("d", ALL, ids=lambda d: type(d).__name__)
def test_distributions_agree_with_themselves(d):
    p = np.array([0.01, 0.2, 0.5, 0.77, 0.99])
    x = d.ppf(p)
    if d.discrete:
        k = np.arange(400)
        assert np.allclose(np.cumsum(d.pdf(k)), d.cdf(k)) and abs((k * d.pdf(k)).sum() - d.mean()) < 1e-6
        assert abs(((k - d.mean()) ** 2 * d.pdf(k)).sum() - d.variance()) < 1e-6
        assert (d.cdf(x) >= p).all() and (d.cdf(x - 1) < p).all() and d.pdf(np.array([0.5]))[0] == 0
    else:
        assert np.allclose(d.cdf(x), p)
        assert np.allclose((d.cdf(x + 1e-5) - d.cdf(x - 1e-5)) / 2e-5, d.pdf(x), rtol=1e-4)
        s = d.ppf((np.arange(20_000) + 0.5) / 20_000)
        assert isinstance(d, D.Cauchy) or abs(s.mean() - d.mean()) < 0.02 * max(1, abs(d.mean()))
    assert np.isnan(d.ppf(np.array([-0.1, 1.1]))).all()


def test_columns_of_distributions(spark):
    df = spark.createDataFrame([(0.5,), (None,), (float("nan"),)], "x double")
    got = [r.y for r in df.select(D.on_column(D.Normal(), "cdf", "x").alias("y")).collect()]
    assert abs(got[0] - 0.6914624612740131) < 1e-12 and got[1] is None
    same = spark.range(5).select(D.uniform("id").alias("u"), D.normal("id").alias("n"))
    assert same.collect() == same.collect() and same.agg(F.min("u") > 0).first()[0]
