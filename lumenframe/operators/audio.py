"""Audio: files, pitch, chroma, onsets and tempo, signal by signal."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.series import spec
from lumenframe.operators.signal import window
from lumenframe.operators.timeseries import _rows


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, rate, i, value) of PCM files, values in [-1, 1); a file is decoded by one task, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    width, channels, rate, first = f.getsampwidth(), f.getnchannels(), f.getframerate(), 0
                    while raw := f.readframes(50_000):
                        x = _samples(raw, width).reshape(-1, channels)
                        n = len(x)
                        for c in range(channels):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([c] * n, pa.int32()), pa.array([rate] * n, pa.int32()), pa.array(np.arange(first, first + n)), pa.array(x[:, c])], names=["path", "channel", "rate", "i", "value"])
                        first += n

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, channel int, rate int, i long, value double")


def _samples(raw: bytes, width: int) -> np.ndarray:
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23
    return np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)


def wav_bytes(x: np.ndarray, rate: int) -> bytes:
    """16-bit mono."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes((np.clip(x, -1, 1 - 2**-15) * 2**15).round().astype("<i2").tobytes())
    return out.getvalue()


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    return np.array([x[i : i + size] for i in range(0, len(x) - size + 1, hop)]).reshape(-1, size)


def pitch(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], rate: float, size: int, hop: int, threshold: float = 0.15) -> DataFrame:
    """(by, frame, frequency) by the cumulative mean normalised difference function; null where a frame has no pitch."""

    def one(x: np.ndarray) -> float:
        half = len(x) // 2
        d = np.array([((x[:half] - x[t : t + half]) ** 2).sum() for t in range(half)])
        total = np.cumsum(d)
        norm = np.ones(half)
        norm[1:] = d[1:] * np.arange(1, half) / np.where(total[1:] > 0, total[1:], 1)
        for t in range(2, half - 1):
            if norm[t] < threshold and norm[t] <= norm[t + 1]:
                a, b, c = norm[t - 1], norm[t], norm[t + 1]
                bend = a - 2 * b + c
                return rate / (t + ((a - c) / (2 * bend) if bend else 0))
        return np.nan

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [one(x) for x in _frames(pdf[column].to_numpy(float), size, hop)]
        return pd.DataFrame({"frame": np.arange(len(found), dtype=np.int32), "frequency": found})

    return _rows(df, by, order_by, f, "frame int, frequency double")


def chroma(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], rate: float, size: int, hop: int) -> DataFrame:
    """(by, frame, pitch_class, value): spectral power by semitone class (A is 9), each frame's largest being 1."""
    f0 = np.fft.rfftfreq(size, 1 / rate)
    kinds = np.full(len(f0), -1)
    kinds[1:] = np.round(12 * np.log2(f0[1:] / 440) + 69).astype(int) % 12
    fold, taper = np.array([kinds == k for k in range(12)], dtype=float), window("hann", size)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        z = (np.abs(np.fft.rfft(_frames(pdf[column].to_numpy(float), size, hop) * taper, axis=1)) ** 2) @ fold.T
        z = z / np.maximum(z.max(1, keepdims=True), 1e-300)
        a, b = np.indices(z.shape)
        return pd.DataFrame({"frame": a.ravel().astype(np.int32), "pitch_class": b.ravel().astype(np.int32), "value": z.ravel()})

    return _rows(df, by, order_by, f, "frame int, pitch_class int, value double")


def onset_strength(df: DataFrame, column: str, by: Sequence[str], order_by: Sequence[str], size: int, hop: int) -> DataFrame:
    """(by, frame, strength): summed growth of the spectrum's magnitudes from frame to frame."""
    taper = window("hann", size)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.abs(np.fft.rfft(_frames(pdf[column].to_numpy(float), size, hop) * taper, axis=1))
        flux = np.maximum(np.diff(z, axis=0, prepend=z[:1]), 0).sum(1) if len(z) else np.empty(0)
        return pd.DataFrame({"frame": np.arange(len(flux), dtype=np.int32), "strength": flux})

    return _rows(df, by, order_by, f, "frame int, strength double")


def onsets(strength: DataFrame, by: Sequence[str], around: int = 3, factor: float = 1.5) -> DataFrame:
    """Frames that are local maxima and beyond `factor` times the mean around: windows over the envelope."""
    w = spec(by, ["frame"])
    mean = F.avg("strength").over(w.rowsBetween(-around, around))
    peak = (F.col("strength") > F.coalesce(F.lag("strength").over(w), F.lit(0.0))) & (F.col("strength") >= F.coalesce(F.lead("strength").over(w), F.lit(0.0)))
    return strength.withColumn("_on", peak & (F.col("strength") > factor * mean)).filter("_on").drop("_on")


def tempo(strength: DataFrame, by: Sequence[str], frame_rate: float, low: float = 40.0, high: float = 240.0) -> DataFrame:
    """(by, bpm): the lag of the envelope's largest autocorrelation within the range of tempi."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["strength"].to_numpy(float)
        x = x - x.mean()
        lags = np.arange(max(1, int(60 * frame_rate / high)), min(len(x) - 1, int(60 * frame_rate / low)) + 1)
        if not len(lags):
            return pd.DataFrame({"bpm": [np.nan]})
        score = [float(x[k:] @ x[:-k]) for k in lags]
        return pd.DataFrame({"bpm": [60 * frame_rate / lags[int(np.argmax(score))]]})

    return _rows(strength, by, ["frame"], f, "bpm double")


def istft(spectra: DataFrame, by: Sequence[str], size: int, hop: int, kind: str = "hann") -> DataFrame:
    """(by, pos, value) of (by, frame, bin, re, im): overlapped frames over the summed squares of the window."""
    taper = window(kind, size)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = int(pdf["frame"].max()) + 1
        z = np.zeros((frames, size // 2 + 1), complex)
        z[pdf["frame"], pdf["bin"]] = pdf["re"] + 1j * pdf["im"]
        out, weight = np.zeros(size + hop * (frames - 1)), np.zeros(size + hop * (frames - 1))
        for k, x in enumerate(np.fft.irfft(z, size, axis=1)):
            out[k * hop : k * hop + size] += x * taper
            weight[k * hop : k * hop + size] += taper**2
        return pd.DataFrame({"pos": np.arange(len(out)), "value": np.where(weight > 1e-12, out / np.maximum(weight, 1e-12), 0.0)})

    return _rows(spectra, by, ["frame", "bin"], f, "pos long, value double")
