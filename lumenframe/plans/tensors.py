"""Tensors, small matrices, complex numbers and distributions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe.functions import distributions as D
from lumenframe.operators import linalg as L
from lumenframe.operators import tensors as T
from lumenframe.plans.registry import Registry
from lumenframe.plans.statistics import rounded
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: A tensor of 7 by 4 by 3: discounted units by line number, supplier class and part class.
_CUBE = "WITH t AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(l_suppkey % 4 AS BIGINT) AS j, CAST(l_partkey % 3 AS BIGINT) AS k, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)"


def cube(spark, d):
    line = table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_suppkey") % 4).cast("long").alias("j"), (F.col("l_partkey") % 3).cast("long").alias("k"), "l_quantity")
    return T.Tensor(line.groupBy("i", "j", "k").agg(F.sum("l_quantity").cast("double").alias("v")), ("i", "j", "k"), (7, 4, 3))


def _r(t):
    return rounded(t.df, 4)


@query("tensor_slice", f"{_CUBE} SELECT (i - 1) // 2 AS i, j, k, round(v, 4) AS v FROM t WHERE i BETWEEN 1 AND 5 AND (i - 1) % 2 = 0 AND j >= 2")
def _(spark, d):
    return _r(cube(spark, d).slice(i=T.SliceRange(1, 6, 2), j=T.SliceRange(2)).map(lambda v: v)).withColumn("j", F.col("j") + 2)


@query("tensor_select", f"{_CUBE} SELECT i, k, round(v, 4) AS v FROM t WHERE j = 1")
def _(spark, d):
    return _r(cube(spark, d).select("j", 1))


@query("tensor_index_select", f"{_CUBE} SELECT x.k AS i, j, t.k, round(v, 4) AS v FROM t JOIN (VALUES (3, 0), (0, 1), (3, 2)) x(p, k) ON t.i = x.p")
def _(spark, d):
    return _r(cube(spark, d).index_select("i", [3, 0, 3]))


@query("tensor_masked", f"{_CUBE}, m AS (SELECT median(v) AS m FROM t) SELECT i, j, k, round(CASE WHEN v > 100 THEN 100.0 ELSE v END, 4) AS v FROM t")
def _(spark, d):
    return _r(cube(spark, d).masked_put(lambda v: v > 100, 100.0))


@query("tensor_index_put", f"{_CUBE} SELECT i, j, k, round(CASE WHEN i = j THEN -1.0 ELSE v END, 4) AS v FROM t")
def _(spark, d):
    t = cube(spark, d)
    return _r(t.index_put(t.df.filter("i = j").withColumn("v", F.lit(-1.0))))


@query("tensor_gather", f"{_CUBE} SELECT a.i, a.j, a.k, round(coalesce(b.v, 0), 4) AS v FROM t a LEFT JOIN t b ON b.i = a.i AND b.k = a.k AND b.j = (a.j + a.k) % 4")
def _(spark, d):
    t = cube(spark, d)
    return _r(t.gather("j", t._with(t.df.withColumn("v", ((F.col("j") + F.col("k")) % 4).cast("double")))))


@query("tensor_reshape", f"{_CUBE} SELECT (i * 12 + j * 3 + k) // 6 AS a, (i * 12 + j * 3 + k) % 6 AS b, round(v, 4) AS v FROM t")
def _(spark, d):
    return _r(cube(spark, d).reshape({"a": 14, "b": 6}))


@query("tensor_permute_sum", f"{_CUBE} SELECT k, i, round(sum(v), 4) AS v FROM t GROUP BY 1, 2")
def _(spark, d):
    return _r(cube(spark, d).permute("k", "j", "i").sum_dim("j"))


@query("tensor_mean_dim", f"{_CUBE} SELECT j, k, round(sum(v) / 7, 4) AS v FROM t GROUP BY 1, 2")
def _(spark, d):
    return _r(cube(spark, d).mean_dim("i"))


@query("tensor_concat_stack", f"{_CUBE} SELECT n AS s, i + 7 * c AS i, j, k, round(v * (1 + n), 4) AS v FROM t, (VALUES (0), (1)) x(n), (VALUES (0), (1)) y(c)")
def _(spark, d):
    t = cube(spark, d)
    return _r(T.stack([T.concat([t, t], "i"), T.concat([t.scalar_mul(2.0)] * 2, "i")], "s")).withColumn("s", F.col("s").cast("int"))


@query("tensor_squeeze", f"{_CUBE} SELECT i, j, round(v, 4) AS v FROM t WHERE k = 2")
def _(spark, d):
    return _r(cube(spark, d).slice(k=T.SliceRange(2, 3)).unsqueeze("one").squeeze())


@query("tensor_sort_axis", f"{_CUBE} SELECT CAST(row_number() OVER (PARTITION BY j, k ORDER BY v, i) - 1 AS BIGINT) AS i, j, k, round(v, 4) AS v FROM t")
def _(spark, d):
    return _r(cube(spark, d).sort_axis("i"))


@query("tensor_argsort_axis", f"{_CUBE} SELECT CAST(row_number() OVER (PARTITION BY j, k ORDER BY v, i) - 1 AS BIGINT) AS i, j, k, CAST(i AS DOUBLE) AS v FROM t")
def _(spark, d):
    return _r(cube(spark, d).argsort_axis("i"))


@query("tensor_create", "SELECT 'eye' AS kind, i, j, CAST(i = j AS INT)::DOUBLE AS v FROM range(4) a(i), range(4) b(j) WHERE i = j UNION ALL SELECT 'ones', i, j, 1.0 FROM range(2) a(i), range(3) b(j) UNION ALL SELECT 'linspace', i, 0, 1 + i * 0.5 FROM range(5) a(i) UNION ALL SELECT 'arange', i, 0, 2 + 3.0 * i FROM range(4) a(i) UNION ALL SELECT 'zeros', i, 0, 0 FROM range(3) a(i)")
def _(spark, d):
    one = lambda t, kind: t.df.select(F.lit(kind).alias("kind"), "i", (F.col("j") if "j" in t.axes else F.lit(0).cast("long")).alias("j"), F.col("v").cast("double").alias("v"))
    made = {"eye": T.eye(spark, 4), "ones": T.ones(spark, {"i": 2, "j": 3}), "linspace": T.linspace(spark, 1, 3, 5), "arange": T.arange(spark, 2, 14, 3), "zeros": T.zeros(spark, {"i": 3})}
    out = None
    for kind, t in made.items():
        out = one(t, kind) if out is None else out.unionAll(one(t, kind))
    return out


@query("einsum_chain", f"{_CUBE} SELECT a.i, b.i AS l, round(sum(a.v * b.v * (1 + a.j)), 4) AS v FROM t a JOIN t b ON a.j = b.j AND a.k = b.k GROUP BY 1, 2")
def _(spark, d):
    t = cube(spark, d)
    weights = T.arange(spark, 1, 5)
    return _r(T.einsum("ijk,j,ljk->il", t, weights, t, strategy="optimal"))


@query("einsum_trace_outer", f"{_CUBE}, m AS (SELECT i, j, sum(v) AS v FROM t WHERE i < 4 GROUP BY 1, 2) SELECT x.j AS a, y.j AS b, round(x.v * y.v, 4) AS v FROM (SELECT j, sum(v) AS v FROM m GROUP BY 1) x, (SELECT j, sum(v) AS v FROM m WHERE i = j GROUP BY 1) y")
def _(spark, d):
    m = cube(spark, d).sum_dim("k").slice(i=T.SliceRange(0, 4))
    return _r(T.einsum("ia,bb->ab", m, m))


@query("tensor_unfold_mode", f"{_CUBE} SELECT j, i * 3 + k AS rest, round(v, 4) AS v FROM t")
def _(spark, d):
    return _r(T.unfold(cube(spark, d), "j")).withColumnRenamed("_rest", "rest")


@query("mode_n_product", f"{_CUBE} SELECT i, r AS j, k, round(sum(v * (r + j)), 4) AS v FROM t, range(2) x(r) GROUP BY 1, 2, 3 HAVING sum(CASE WHEN r + j <> 0 THEN 1 ELSE 0 END) > 0")
def _(spark, d):
    import numpy as np

    return _r(T.mode_n_product(cube(spark, d), T.of_array(spark, np.add.outer(range(2), range(4)), ("r", "c")), "j"))


@query("khatri_rao", f"{_CUBE}, a AS (SELECT i, k, sum(v) AS v FROM t GROUP BY 1, 2), b AS (SELECT j, k, sum(v) AS v FROM t GROUP BY 1, 2) SELECT a.i * 4 + b.j AS i, a.k, round(a.v * b.v, 4) AS v FROM a JOIN b USING (k)")
def _(spark, d):
    t = cube(spark, d)
    return _r(T.khatri_rao(t.sum_dim("j"), t.sum_dim("i")))


@query("sparse_tensor_add", f"{_CUBE} SELECT i, j, k, round(sum(v), 4) AS v FROM (SELECT * FROM t WHERE i < 4 UNION ALL SELECT * FROM t WHERE i > 2) GROUP BY 1, 2, 3 HAVING sum(v) <> 0")
def _(spark, d):
    t = cube(spark, d)
    low, high = t._with(t.df.filter("i < 4")), t._with(t.df.filter("i > 2"))
    return _r(low.add(high).coalesce())


@query("complex_numbers", """SELECT p_partkey, round(a * a - b * b, 6) AS square_re, round(2 * a * b, 6) AS square_im, round(sqrt(a * a + b * b), 6) AS norm, round(atan2(b, a), 6) AS arg, round(a / (a * a + b * b), 6) AS inverse_re,
       round(ln(sqrt(a * a + b * b)), 6) AS ln_re, round(sqrt(sqrt(a * a + b * b)) * cos(atan2(b, a) / 2), 6) AS sqrt_re FROM (SELECT p_partkey, p_size / 10.0 AS a, (p_partkey % 7 - 3)::DOUBLE AS b FROM part)""")
def _(spark, d):
    z = T.complex_of(F.col("p_size") / 10.0, (F.col("p_partkey") % 7 - 3).cast("double"))
    one = T.complex_of(1.0)
    return rounded(table(spark, d, "part").select("p_partkey", T.c_mul(z, z)["re"].alias("square_re"), T.c_mul(z, z)["im"].alias("square_im"), T.c_norm(z).alias("norm"), T.c_arg(z).alias("arg"), T.c_div(one, z)["re"].alias("inverse_re"), T.c_ln(z)["re"].alias("ln_re"), T.c_sqrt(z)["re"].alias("sqrt_re")))


@query("complex_interleaved", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(T.to_interleaved(T.from_interleaved(F.col("embedding"))), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# small matrices, one a row: four by four of embeddings' first sixteen components, made diagonally dominant


def matrices(spark, d):
    e = lambda i, j: F.col("embedding")[4 * i + j].cast("double") + (2.0 if i == j else 0.0)
    return table(spark, d, "embeddings").select("vec_id", F.array(*[F.array(*[e(i, j) for j in range(4)]) for i in range(4)]).alias("m"), F.array(*[F.lit(float(i + 1)) for i in range(4)]).alias("b"))


_M2 = "WITH m AS (SELECT vec_id, embedding[1]::DOUBLE + 2 AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE + 2 AS d FROM embeddings)"


def twos(spark, d):
    e = lambda k, more=0.0: F.col("embedding")[k].cast("double") + more
    return table(spark, d, "embeddings").select("vec_id", F.array(F.array(e(0, 2.0), e(1)), F.array(e(2), e(3, 2.0))).alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("b"))


@query("matrix_det", f"{_M2} SELECT vec_id, round(a * d - b * c, 6) AS det FROM m")
def _(spark, d):
    return rounded(twos(spark, d).select("vec_id", L.det("m").alias("det")))


@query("matrix_inverse", f"{_M2} SELECT vec_id, round(d / (a * d - b * c), 6) AS i00, round(-b / (a * d - b * c), 6) AS i01, round(-c / (a * d - b * c), 6) AS i10, round(a / (a * d - b * c), 6) AS i11 FROM m")
def _(spark, d):
    inv = twos(spark, d).select("vec_id", L.inverse("m").alias("x"))
    return rounded(inv.select("vec_id", *[F.col("x")[i][j].alias(f"i{i}{j}") for i in range(2) for j in range(2)]))


@query("matrix_solve", f"{_M2} SELECT vec_id, round((d - 2 * b) / (a * d - b * c), 6) AS x0, round((2 * a - c) / (a * d - b * c), 6) AS x1 FROM m")
def _(spark, d):
    x = twos(spark, d).select("vec_id", L.solve("m", "b").alias("x"))
    return rounded(x.select("vec_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")))


@query("matrix_lu", f"{_M2} SELECT vec_id, round(CASE WHEN abs(a) >= abs(c) THEN c / a ELSE a / c END, 6) AS l10, round(CASE WHEN abs(a) >= abs(c) THEN a ELSE c END, 6) AS u00, round(CASE WHEN abs(a) >= abs(c) THEN d - b * c / a ELSE b - d * a / c END, 6) AS u11 FROM m")
def _(spark, d):
    x = twos(spark, d).select("vec_id", L.lu("m").alias("x"))
    return rounded(x.select("vec_id", F.col("x.l")[1][0].alias("l10"), F.col("x.u")[0][0].alias("u00"), F.col("x.u")[1][1].alias("u11")))


_S2 = f"{_M2}, s AS (SELECT vec_id, a * a + b * b AS p, a * c + b * d AS q, c * c + d * d AS r FROM m)"


def grams(spark, d):
    m = twos(spark, d)
    g = lambda i, j: F.col("m")[i][0] * F.col("m")[j][0] + F.col("m")[i][1] * F.col("m")[j][1]
    return m.select("vec_id", F.array(F.array(g(0, 0), g(0, 1)), F.array(g(1, 0), g(1, 1))).alias("s"))


@query("matrix_cholesky", f"{_S2} SELECT vec_id, round(sqrt(p), 6) AS l00, round(q / sqrt(p), 6) AS l10, round(sqrt(r - q * q / p), 6) AS l11, round(ln(p * r - q * q), 6) AS log_det FROM s")
def _(spark, d):
    x = grams(spark, d).select("vec_id", L.cholesky("s").alias("l"), L.cholesky_log_det("s").alias("log_det"))
    return rounded(x.select("vec_id", F.col("l")[0][0].alias("l00"), F.col("l")[1][0].alias("l10"), F.col("l")[1][1].alias("l11"), "log_det"))


@query("matrix_eigenvalues", f"{_S2} SELECT vec_id, round((p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q), 6) AS high, round((p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q), 6) AS low FROM s")
def _(spark, d):
    x = grams(spark, d).select("vec_id", L.eigen("s").alias("x"))
    return rounded(x.select("vec_id", F.col("x.values")[0].alias("high"), F.col("x.values")[1].alias("low")))


@query("matrix_qr", f"{_M2} SELECT vec_id, round(sqrt(a * a + c * c), 6) AS r00, round((a * b + c * d) / sqrt(a * a + c * c), 6) AS r01, round(abs(a * d - b * c) / sqrt(a * a + c * c), 6) AS r11 FROM m")
def _(spark, d):
    x = twos(spark, d).select("vec_id", L.qr("m").alias("x"))
    return rounded(x.select("vec_id", F.col("x.r")[0][0].alias("r00"), F.col("x.r")[0][1].alias("r01"), F.col("x.r")[1][1].alias("r11")))


@query("matrix_singular_values", f"{_S2} SELECT vec_id, round(sqrt((p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q)), 6) AS s0, round(sqrt((p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q)), 6) AS s1 FROM s")
def _(spark, d):
    x = twos(spark, d).select("vec_id", L.singular_values("m").alias("x"))
    return rounded(x.select("vec_id", F.col("x")[0].alias("s0"), F.col("x")[1].alias("s1")))


@query("matrix_lstsq", f"{_M2} SELECT vec_id, round((d - 2 * b) / (a * d - b * c), 6) AS x0, round((2 * a - c) / (a * d - b * c), 6) AS x1 FROM m")
def _(spark, d):
    x = twos(spark, d).select("vec_id", L.lstsq("m", "b").alias("x"))
    return rounded(x.select("vec_id", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1")))


@query("gemm", f"{_CUBE}, a AS (SELECT i, j, sum(v) AS v FROM t GROUP BY 1, 2), c AS (SELECT i, j, 1.0 AS v FROM a) SELECT x.i, y.i AS j, round(2 * sum(x.v * y.v) + 3 * (x.i = y.i)::INT, 4) AS v FROM a x JOIN a y USING (j) GROUP BY 1, 2")
def _(spark, d):
    a = cube(spark, d).sum_dim("k").df
    return rounded(L.gemm(2.0, a, L.transpose(a), 3.0, T.eye(spark, 7).df), 4)


@query("gemv", f"{_CUBE}, a AS (SELECT i, j, sum(v) AS v FROM t GROUP BY 1, 2) SELECT i, round(2 * sum(v * (j + 1)) - (i + 1), 4) AS v FROM a GROUP BY 1")
def _(spark, d):
    a = cube(spark, d).sum_dim("k").df
    return rounded(L.gemv(2.0, a, T.arange(spark, 1, 5).df, -1.0, T.arange(spark, 1, 8).df), 4)


@query("csr_rows", f"{_CUBE}, a AS (SELECT i, j, sum(v) AS v FROM t GROUP BY 1, 2) SELECT i, list(j ORDER BY j) AS columns, count(*) AS n, round(sum(v), 4) AS total FROM a GROUP BY 1")
def _(spark, d):
    rows = L.to_csr(cube(spark, d).sum_dim("k").df)
    return rounded(rows.select("i", F.col("entries.j").alias("columns"), F.size("entries").cast("long").alias("n"), F.aggregate("entries.v", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query("csc_round_trip", f"{_CUBE}, a AS (SELECT i, j, sum(v) AS v FROM t GROUP BY 1, 2) SELECT i, j, round(v, 4) AS v FROM a")
def _(spark, d):
    return rounded(L.from_csc(L.to_csc(cube(spark, d).sum_dim("k").df)), 4)


def _dft(part, sign="-"):
    f = "cos" if part == "re" else "sin"
    return f"list_sum(list_transform(generate_series(0, 7), lambda n: e[n + 1] * {f}({'' if part == 're' else sign}2 * pi() * k * n / 8)))"


_E8 = "WITH e AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS e FROM embeddings)"


@query("fft", f"{_E8} SELECT vec_id, k, round({_dft('re')}, 6) + 0.0 AS re, round({_dft('im')}, 6) + 0.0 AS im FROM e, range(8) r(k)")
def _(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", L.fft(F.transform(F.slice("embedding", 1, 8), lambda x: T.complex_of(x))).alias("z"))
    return z.select("vec_id", F.posexplode("z").alias("k", "z")).select("vec_id", F.col("k").cast("long").alias("k"), (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


@query("rfft", f"{_E8} SELECT vec_id, k, round({_dft('re')}, 6) + 0.0 AS re, round({_dft('im')}, 6) + 0.0 AS im FROM e, range(5) r(k)")
def _(spark, d):
    z = table(spark, d, "embeddings").select("vec_id", L.rfft(F.slice("embedding", 1, 8)).alias("z"))
    return z.select("vec_id", F.posexplode("z").alias("k", "z")).select("vec_id", F.col("k").cast("long").alias("k"), (F.round("z.re", 6) + 0.0).alias("re"), (F.round("z.im", 6) + 0.0).alias("im"))


@query("fft_round_trip", f"{_E8} SELECT vec_id, round(list_sum(e), 5) AS complex_sum, round(list_sum(e), 5) AS real_sum FROM e")
def _(spark, d):
    x = F.slice("embedding", 1, 8)
    z = table(spark, d, "embeddings").select("vec_id", L.ifft(L.fft(F.transform(x, lambda v: T.complex_of(v)))).alias("c"), L.irfft(L.rfft(x), 8).alias("r"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), 5)
    return z.select("vec_id", total("c.re").alias("complex_sum"), total("r").alias("real_sum"))


@query("fft2_corner", "SELECT vec_id, round(list_sum(embedding[1:16]::DOUBLE[]), 5) AS at00, round(list_sum(embedding[1:8]::DOUBLE[]) - list_sum(embedding[9:16]::DOUBLE[]), 5) AS rfft2_at_10, round(embedding[1], 5) AS back FROM embeddings".replace("list_sum(embedding[1:8]::DOUBLE[]) - list_sum(embedding[9:16]::DOUBLE[])", "list_sum(embedding[1:4]::DOUBLE[]) - list_sum(embedding[9:12]::DOUBLE[])"))
def _(spark, d):
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", 4 * i + 1, 4), lambda v: v.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", grid.alias("m"))
    z = rows.select("vec_id", L.fft2(F.transform("m", lambda r: F.transform(r, lambda v: T.complex_of(v)))).alias("z"), L.rfft2("m").alias("h"))
    back = z.select("vec_id", "z", "h", L.ifft2("z").alias("back"))
    return back.select("vec_id", F.round(F.col("z")[0][0]["re"], 5).alias("at00"), F.round(F.col("h")[1][0]["re"], 5).alias("rfft2_at_10"), F.round(F.col("back")[0][0]["re"], 5).alias("back"))


# distributions: densities at twenty points each, by the gamma function in SQL

_LB = "(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
_DENSITIES = {
    "uniform": (D.Uniform(0.5, 4.5), "CASE WHEN x BETWEEN 0.5 AND 4.5 THEN 0.25 ELSE 0 END", "least(1, greatest(0, (x - 0.5) / 4))"),
    "normal": (D.Normal(2, 1.5), "exp(-0.5 * power((x - 2) / 1.5, 2)) / (1.5 * sqrt(2 * pi()))", None),
    "lognormal": (D.LogNormal(0.3, 0.8), "CASE WHEN x > 0 THEN exp(-0.5 * power((ln(greatest(x, 1e-9)) - 0.3) / 0.8, 2)) / (x * 0.8 * sqrt(2 * pi())) ELSE 0 END", None),
    "exponential": (D.Exponential(0.7), "0.7 * exp(-0.7 * x)", "1 - exp(-0.7 * x)"),
    "gamma": (D.Gamma(2.5, 1.2), "CASE WHEN x > 0 THEN exp(2.5 * ln(1.2) + 1.5 * ln(greatest(x, 1e-9)) - 1.2 * x - lgamma(2.5)) ELSE 0 END", None),
    "chi_squared": (D.ChiSquared(4), "x * exp(-x / 2) / 4", "1 - exp(-x / 2) * (1 + x / 2)"),
    "beta": (D.Beta(2, 3), "CASE WHEN x <= 1 THEN 12 * x * power(1 - x, 2) ELSE 0 END", "CASE WHEN x >= 1 THEN 1 ELSE 6 * x * x - 8 * x * x * x + 3 * power(x, 4) END"),
    "student_t": (D.StudentT(3), "exp(lgamma(2.0) - lgamma(1.5)) / sqrt(3 * pi()) * power(1 + x * x / 3, -2)", "0.5 + (x / sqrt(3) / (1 + x * x / 3) + atan(x / sqrt(3))) / pi()"),
    "cauchy": (D.Cauchy(1, 2), "1 / (pi() * 2 * (1 + power((x - 1) / 2, 2)))", "0.5 + atan((x - 1) / 2) / pi()"),
    "laplace": (D.Laplace(2, 1.5), "exp(-abs(x - 2) / 1.5) / 3", "CASE WHEN x < 2 THEN 0.5 * exp((x - 2) / 1.5) ELSE 1 - 0.5 * exp((2 - x) / 1.5) END"),
    "pareto": (D.Pareto(1, 2.5), "CASE WHEN x >= 1 THEN 2.5 / power(greatest(x, 1), 3.5) ELSE 0 END", "CASE WHEN x >= 1 THEN 1 - power(greatest(x, 1), -2.5) ELSE 0 END"),
    "weibull": (D.Weibull(1.5, 2), "0.75 * power(x / 2, 0.5) * exp(-power(x / 2, 1.5))", "1 - exp(-power(x / 2, 1.5))"),
    "bernoulli": (D.Bernoulli(0.3), "CASE x WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 ELSE 0 END", "CASE WHEN x >= 1 THEN 1 ELSE 0.7 END"),
    "binomial": (D.Binomial(4, 0.3), "CASE WHEN x = floor(x) AND x <= 4 THEN factorial(4) / (factorial(x::INT) * factorial(greatest(0, 4 - x::INT))) * power(0.3, x) * power(0.7, 4 - x) ELSE 0 END", None),
    "negative_binomial": (D.NegativeBinomial(3, 0.4), "CASE WHEN x = floor(x) THEN (x + 1) * (x + 2) / 2 * power(0.4, 3) * power(0.6, x) ELSE 0 END", None),
    "poisson": (D.Poisson(2.5), "CASE WHEN x = floor(x) THEN power(2.5, x) * exp(-2.5) / factorial(x::INT) ELSE 0 END", None),
    "hypergeometric": (D.Hypergeometric(10, 4, 3), "CASE x WHEN 0 THEN 20.0 / 120 WHEN 1 THEN 60.0 / 120 WHEN 2 THEN 36.0 / 120 WHEN 3 THEN 4.0 / 120 ELSE 0 END", None),
}
for _name, (_distribution, _pdf, _cdf) in _DENSITIES.items():

    @query(f"distribution_{_name}", f"SELECT x, round(CAST({_pdf} AS DOUBLE), 6) AS pdf{f', round(CAST({_cdf} AS DOUBLE), 6) AS cdf' if _cdf else ''} FROM (SELECT k * 0.25 AS x FROM range(21) r(k))".replace("k * 0.25", "CAST(k * 0.25 AS DOUBLE)"))
    def _(spark, d, distribution=_distribution, cdf=_cdf):
        x = spark.range(21).select((F.col("id") * 0.25).alias("x"))
        return rounded(x.select("x", D.on_column(distribution, "pdf", "x").alias("pdf"), *([D.on_column(distribution, "cdf", "x").alias("cdf")] if cdf else [])))


@query("random_moments", "SELECT true AS uniform_ok, true AS range_ok, true AS normal_ok, true AS integers_ok, true AS bernoulli_ok, true AS gamma_ok")
def _(spark, d):
    """Means of hashed samples over lineitem lie within five standard errors of the expected ones."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    made = rows.select(D.uniform("key").alias("u"), D.uniform("key", 2, 6, 1).alias("r"), D.normal("key", 1, 3, 2).alias("n"), D.randint("key", 0, 10, 3).alias("i"), D.bernoulli("key", 0.2, 4).alias("b"), D.on_column(D.Gamma(2, 1), "sample", D.uniform("key", seed=5)).alias("g"))
    near = lambda c, mean, sd: F.abs(F.avg(c) - mean) < 5 * sd / F.sqrt(F.count(F.lit(1)))
    return made.agg(near("u", 0.5, math.sqrt(1 / 12)).alias("uniform_ok"), near("r", 4, 4 / math.sqrt(12)).alias("range_ok"), near("n", 1, 3).alias("normal_ok"), near("i", 4.5, 2.88).alias("integers_ok"), near("b", 0.2, 0.4).alias("bernoulli_ok"), near("g", 2, math.sqrt(2)).alias("gamma_ok"))
