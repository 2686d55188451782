"""Signals: one per group, in order. Filters of finite length and wavelets are windows and aggregates; spectra and recursive
filters run in numpy, signal by signal."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.series import per_series, spec
from lumenframe.operators.timeseries import _rows


def window(kind: str, n: int) -> np.ndarray:
    """hann, hamming, blackman, bartlett or rectangular, symmetric."""
    if n == 1:
        return np.ones(1)
    x = 2 * np.pi * np.arange(n) / (n - 1)
    return {"hann": lambda: 0.5 - 0.5 * np.cos(x), "hamming": lambda: 0.54 - 0.46 * np.cos(x), "blackman": lambda: 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x), "bartlett": lambda: 1 - np.abs(np.arange(n) - (n - 1) / 2) / ((n - 1) / 2), "rectangular": lambda: np.ones(n)}[kind]()


def fir(df: DataFrame, column: str, taps: Sequence[float], by: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """Convolution with taps, the signal being 0 before its start: one window pass."""
    w = spec(by, order_by)
    terms = [F.coalesce(F.lag(column, k).over(w) if k else F.col(column), F.lit(0.0)) * t for k, t in enumerate(taps)]
    return df.withColumn(name, sum(terms[1:], terms[0]))


def lowpass(taps: int, cutoff: float) -> np.ndarray:
    """Taps of a windowed-sinc filter; cutoff as a share of the sampling rate."""
    n = np.arange(taps) - (taps - 1) / 2
    h = 2 * cutoff * np.sinc(2 * cutoff * n) * window("hamming", taps)
    return h / h.sum()


def haar(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """(by, pos, approx, detail) of neighbouring pairs; an odd last value is paired with itself."""
    w = spec(by, order_by)
    at = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("pos", F.floor(F.col("_n") / 2))
    pair = at.groupBy(*by, "pos").agg(F.min_by(column, "_n").alias("a"), F.max_by(column, "_n").alias("b"))
    return pair.select(*by, "pos", ((F.col("a") + F.col("b")) / math.sqrt(2)).alias("approx"), ((F.col("a") - F.col("b")) / math.sqrt(2)).alias("detail"))


def inverse_haar(df: DataFrame, by: Sequence[str], name: str = "value") -> DataFrame:
    """(by, pos, value) of (by, pos, approx, detail)."""
    r = math.sqrt(2)
    both = F.array(F.struct((F.col("pos") * 2).alias("pos"), ((F.col("approx") + F.col("detail")) / r).alias(name)), F.struct((F.col("pos") * 2 + 1).alias("pos"), ((F.col("approx") - F.col("detail")) / r).alias(name)))
    return df.select(*by, F.inline(both))


def find_peaks(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], height: float | None = None) -> DataFrame:
    """Rows above both neighbours (and at least `height`)."""
    w = spec(by, order_by)
    rows = df.withColumn("_a", F.lag(column).over(w)).withColumn("_b", F.lead(column).over(w)).filter((F.col(column) > F.col("_a")) & (F.col(column) > F.col("_b")))
    return (rows if height is None else rows.filter(F.col(column) >= height)).drop("_a", "_b")


def lfilter(b: Sequence[float], a: Sequence[float], x: np.ndarray) -> np.ndarray:
    """Recursive filter, direct form II transposed."""
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float), (0, n - len(b))) / a[0], np.pad(np.asarray(a, float), (0, n - len(a))) / a[0]
    state, out = np.zeros(n), np.empty(len(x))
    for i, v in enumerate(x):
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:] * v - a[1:] * y
        out[i] = y
    return out


def iir(df: DataFrame, column: str, b: Sequence[float], a: Sequence[float], by: Sequence[str], order_by: Sequence[str], name: str, zero_phase: bool = False) -> DataFrame:
    f = (lambda x: lfilter(b, a, lfilter(b, a, x)[::-1])[::-1]) if zero_phase else (lambda x: lfilter(b, a, x))
    return per_series(df, by, order_by, column, name, f)


def periodogram(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], rate: float = 1.0) -> DataFrame:
    """(by, frequency, power): squared spectrum of the signal over rate and length, the inner bins doubled."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        p = np.abs(np.fft.rfft(x)) ** 2 / (rate * len(x))
        p[1 : -1 if len(x) % 2 == 0 else None] *= 2
        return pd.DataFrame({"frequency": np.fft.rfftfreq(len(x), 1 / rate), "power": p})

    return _rows(df, by, order_by, f, "frequency double, power double")


def stft(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int, hop: int, kind: str = "hann") -> DataFrame:
    """(by, frame, bin, re, im) of windowed frames."""
    taper = window(kind, size)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        frames = [x[i : i + size] * taper for i in range(0, len(x) - size + 1, hop)]
        z = np.fft.rfft(np.array(frames).reshape(-1, size), axis=1)
        k, b = np.indices(z.shape)
        return pd.DataFrame({"frame": k.ravel().astype(np.int32), "bin": b.ravel().astype(np.int32), "re": z.real.ravel(), "im": z.imag.ravel()})

    return _rows(df, by, order_by, f, "frame int, bin int, re double, im double")


def welch(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int, kind: str = "hann") -> DataFrame:
    """(by, bin, power): mean power of half-overlapping frames."""
    taper = window(kind, size)
    spectra = stft(df, column, by, order_by, size, size // 2, kind)
    return spectra.groupBy(*by, "bin").agg((F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / float((taper**2).sum())).alias("power"))


def mel(hz):
    """Hertz on the mel scale."""
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def hertz(m):
    return 700 * (10 ** (np.asarray(m) / 2595) - 1)


def mel_bank(n_mels: int, size: int, rate: float, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a spectrum."""
    edges = hertz(np.linspace(mel(low), mel(high or rate / 2), n_mels + 2))
    f = np.fft.rfftfreq(size, 1 / rate)[None, :]
    up, down = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrogram(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int, hop: int, n_mels: int, rate: float, cepstra: int | None = None) -> DataFrame:
    """(by, frame, band, value): mel-scaled power, or that many cepstral coefficients (orthonormal cosines of its log)."""
    bank, taper = mel_bank(n_mels, size, rate), window("hann", size)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        frames = np.array([x[i : i + size] * taper for i in range(0, len(x) - size + 1, hop)]).reshape(-1, size)
        z = (np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ bank.T
        if cepstra:
            k = np.arange(cepstra)[:, None]
            basis = np.cos(np.pi * k * (2 * np.arange(n_mels) + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))
            z = np.log(np.maximum(z, 1e-10)) @ basis.T
        a, b = np.indices(z.shape)
        return pd.DataFrame({"frame": a.ravel().astype(np.int32), "band": b.ravel().astype(np.int32), "value": z.ravel()})

    return _rows(df, by, order_by, f, "frame int, band int, value double")


def resample(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """(by, pos, value): each signal brought to n samples through its spectrum."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        z = np.fft.rfft(x)
        k = n // 2 + 1
        z = z[:k] if len(z) >= k else np.pad(z, (0, k - len(z)))
        return pd.DataFrame({"pos": np.arange(n), "value": np.fft.irfft(z, n) * n / len(x)})

    return _rows(df, by, order_by, f, "pos long, value double")


def decimate(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], factor: int) -> DataFrame:
    """Every factor-th row after a low-pass filter."""
    smooth = fir(df, column, lowpass(20 * factor + 1, 0.5 / factor).tolist(), by, order_by, "_s")
    at = smooth.withColumn("_n", F.row_number().over(spec(by, order_by)) - 1)
    return at.filter(F.col("_n") % factor == 0).withColumn(column, F.col("_s")).drop("_s", "_n")


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """The integral of y over x."""
    w = Window.partitionBy(*by).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(*by, area.alias("a")).groupBy(*by).agg(F.sum("a").alias("integral"))
