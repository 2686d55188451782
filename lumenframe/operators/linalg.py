"""Matrices as coordinate tables (i, j, v) and vectors as (i, v): products are joins with a grouped sum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """a @ b, both sparse."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j2"), F.col("v").alias("w"))
    return a.withColumnRenamed("j", "k").join(right, "k").groupBy("i", F.col("j2").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    right = x.select(F.col("i").alias("j"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha * a + b."""
    return a.select("i", "j", (F.col("v") * alpha).alias("v")).unionByName(b.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def norms(a: DataFrame) -> DataFrame:
    """l1 (sum of magnitudes), l2 (Frobenius), largest (magnitude)."""
    return a.agg(F.sum(F.abs("v")).alias("l1"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"), F.max(F.abs("v")).alias("largest"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """columns' products summed over rows: the small matrix that decompositions of tall tables need."""
    n = len(columns)
    one = df.agg(*[F.sum(F.col(columns[i]).cast("double") * F.col(columns[j]).cast("double")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    return np.array([[one[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])


def svd(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of a tall table."""
    values, vectors = np.linalg.eigh(gram(df, columns))
    order = np.argsort(values)[::-1]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order].T


def qr_r(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of a QR decomposition of a tall table, with a positive diagonal."""
    return np.linalg.cholesky(gram(df, columns)).T


def gemm(alpha: float, a: DataFrame, b: DataFrame, beta: float = 0.0, c: DataFrame | None = None) -> DataFrame:
    """alpha * a @ b + beta * c."""
    product = matmul(a, b).withColumn("v", alpha * F.col("v"))
    return product if c is None else add(c, product, beta)


def gemv(alpha: float, a: DataFrame, x: DataFrame, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    """alpha * a @ x + beta * y."""
    product = matvec(a, x).withColumn("v", alpha * F.col("v"))
    if y is None:
        return product
    return product.unionByName(y.select("i", (beta * F.col("v")).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def to_csr(a: DataFrame) -> DataFrame:
    """A row per matrix row: (i, entries array<struct<j, v>>, by column). A row's entries are to fit a task."""
    return a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("entries"))


def from_csr(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.inline("entries")).select("i", "j", "v")


def to_csc(a: DataFrame) -> DataFrame:
    """A row per matrix column: (j, entries array<struct<i, v>>, by row)."""
    return a.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("entries"))


def from_csc(columns: DataFrame) -> DataFrame:
    return columns.select("j", F.inline("entries")).select("i", "j", "v")


# Many small dense matrices, one a row as array<array<double>>: LAPACK on whole Arrow batches. Null or singular ones give null.

_MATRIX, _VECTOR = "array<array<double>>", "array<double>"


def _each(f, returns: str):
    """f of a row's matrices, on a column."""
    def one(*values):
        if any(v is None for v in values):
            return None
        try:
            return f(*(np.array([np.asarray(r, dtype=float) for r in v]) if hasattr(v[0], "__len__") else np.asarray(v, dtype=float) for v in values))
        except np.linalg.LinAlgError:
            return None

    @F.pandas_udf(returns)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object if returns != "double" else float)

    return lambda *columns: apply(*[F.col(c) if isinstance(c, str) else c for c in columns])


def _struct(f, returns: str):
    names = [x.split(":")[0].strip() for x in returns.removeprefix("struct<").removesuffix(">").split(";")]

    def one(v):
        if v is None:
            return dict.fromkeys(names)
        try:
            return dict(zip(names, f(np.array([np.asarray(r, dtype=float) for r in v])), strict=True))
        except np.linalg.LinAlgError:
            return dict.fromkeys(names)

    @F.pandas_udf(returns.replace(";", ","))
    def apply(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in column], columns=names)

    return lambda column: apply(F.col(column) if isinstance(column, str) else column)


def lu_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, l, u) with m[order] == l @ u, by partial pivoting."""
    u, n = m.astype(float).copy(), len(m)
    order, low = np.arange(n), np.zeros((n, n))
    for k in range(n):
        p = k + int(np.abs(u[k:, k]).argmax())
        for x in (u, low, order):
            x[[k, p]] = x[[p, k]]
        low[k, k] = 1.0
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return order, low, np.triu(u)


def _qr_positive(m: np.ndarray) -> tuple[list, list]:
    q, r = np.linalg.qr(m)
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return (q * sign).tolist(), (r * sign[:, None]).tolist()


def _eigen(m: np.ndarray) -> tuple[list, list]:
    values, vectors = np.linalg.eigh(m)
    return values[::-1].tolist(), vectors[:, ::-1].T.tolist()


def det(m):
    return _each(lambda a: float(np.linalg.det(a)), "double")(m)


def inverse(m):
    return _each(lambda a: np.linalg.inv(a).tolist(), _MATRIX)(m)


def solve(m, b):
    return _each(lambda a, x: np.linalg.solve(a, x).tolist(), _VECTOR)(m, b)


def lstsq(m, b):
    return _each(lambda a, x: np.linalg.lstsq(a, x, rcond=None)[0].tolist(), _VECTOR)(m, b)


def cholesky(m):
    return _each(lambda a: np.linalg.cholesky(a).tolist(), _MATRIX)(m)


def cholesky_log_det(m):
    return _each(lambda a: float(2 * np.log(np.diag(np.linalg.cholesky(a))).sum()), "double")(m)


def singular_values(m):
    return _each(lambda a: np.linalg.svd(a, compute_uv=False).tolist(), _VECTOR)(m)


def lu(m):
    """struct of the rows' order, l and u."""
    return _struct(lambda a: [x.tolist() for x in lu_of(a)], "struct<order: array<bigint>; l: array<array<double>>; u: array<array<double>>>")(m)


def qr(m):
    """struct of q and r, with a positive diagonal."""
    return _struct(_qr_positive, "struct<q: array<array<double>>; r: array<array<double>>>")(m)


def eigen(m):
    """struct of the eigenvalues of a symmetric matrix, descending, and a row of each one's vector."""
    return _struct(_eigen, "struct<values: array<double>; vectors: array<array<double>>>")(m)


# Fourier transforms of array columns

_COMPLEX = "struct<re: double, im: double>"


def _pairs(z: np.ndarray):
    if z.ndim == 1:
        return [{"re": float(x.real), "im": float(x.imag)} for x in z]
    return [_pairs(x) for x in z]


def _complex(v) -> np.ndarray:
    if len(v) and isinstance(v[0], dict):
        return np.array([complex(x["re"], x["im"]) for x in v])
    return np.array([_complex(x) for x in v])


def _transform(f, returns: str, of=_complex):
    @F.pandas_udf(returns)
    def apply(column: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(of(v)) for v in column], dtype=object)

    return lambda column: apply(F.col(column) if isinstance(column, str) else column)


def _real(v) -> np.ndarray:
    return np.array([np.asarray(x, dtype=float) for x in v]) if len(v) and hasattr(v[0], "__len__") else np.asarray(v, dtype=float)


def fft(z):
    """Of array<struct<re, im>>."""
    return _transform(lambda a: _pairs(np.fft.fft(a)), f"array<{_COMPLEX}>")(z)


def ifft(z):
    return _transform(lambda a: _pairs(np.fft.ifft(a)), f"array<{_COMPLEX}>")(z)


def rfft(x):
    """Of array<double>: the n / 2 + 1 terms that tell the others."""
    return _transform(lambda a: _pairs(np.fft.rfft(a)), f"array<{_COMPLEX}>", _real)(x)


def irfft(z, n: int):
    return _transform(lambda a: np.fft.irfft(a, n).tolist(), "array<double>")(z)


def fft2(z):
    return _transform(lambda a: _pairs(np.fft.fft2(a)), f"array<array<{_COMPLEX}>>")(z)


def ifft2(z):
    return _transform(lambda a: _pairs(np.fft.ifft2(a)), f"array<array<{_COMPLEX}>>")(z)


def rfft2(x):
    return _transform(lambda a: _pairs(np.fft.rfft2(a)), f"array<array<{_COMPLEX}>>", _real)(x)
