import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import audio, ml, signal, text


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(400) / 7) * 0.8
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x, 8000))
    got = audio.read_wav(spark, str(tmp_path / "a.wav")).orderBy("i").collect()
    assert len(got) == 400 and got[0].rate == 8000 and np.allclose([r.value for r in got], x, atol=2**-15)


@pytest.fixture
def tone(spark):
    return spark.createDataFrame([(0, i, math.sin(2 * math.pi * 440 * i / 8000)) for i in range(2048)], "k int, i int, v double")


def test_pitch_and_chroma(tone):
    assert all(abs(r.frequency - 440) < 3 for r in audio.pitch(tone, "v", ["k"], ["i"], 8000.0, 512, 256).collect())
    top = audio.chroma(tone, "v", ["k"], ["i"], 8000.0, 1024, 512).filter("value = 1").collect()
    assert {r.pitch_class for r in top} == {9}


def test_onsets_and_tempo(spark):
    beat = [(0, i, 1.0 if i % 100 < 5 else 0.0) for i in range(2000)]
    strength = audio.onset_strength(spark.createDataFrame(beat, "k int, i int, v double"), "v", ["k"], ["i"], 20, 10).cache()
    assert 15 <= audio.onsets(strength, ["k"]).count() <= 25
    assert audio.tempo(strength, ["k"], 20.0).first().bpm == pytest.approx(120)


def test_istft_inverts(tone):
    back = audio.istft(signal.stft(tone, "v", ["k"], ["i"], 64, 16), ["k"], 64, 16).orderBy("pos").collect()
    want = [r.v for r in tone.orderBy("i").collect()]
    assert np.allclose([r.value for r in back][32:-32], want[32 : len(back) - 32])


def test_word_pieces_and_tags(spark):
    df = spark.createDataFrame([("Playing unplayed zzz",), (None,)], "t string")
    got = text.wordpieces(df, "t", ["play", "un", "##play", "##ing", "##ed"]).collect()
    assert got[0].pieces == ["play", "##ing", "un", "##play", "##ed", "[UNK]"] and got[1].pieces == []
    rows = [(s, i, w, t) for s in range(5) for i, (w, t) in enumerate([("the", "D"), ("dog", "N"), ("runs", "V"), ("the", "D"), ("race", "N")])]
    model = text.fit_tagger(spark.createDataFrame(rows, "s int, i int, w string, t string"), "s", "i", "w", "t")
    assert text.best_tags(["The", "cat", "runs"], model) == ["D", "N", "V"] and text.best_tags([], model) == []


def test_selection_and_stacking(spark):
    df = spark.range(300).selectExpr("id", "cast(id % 11 as double) AS a", "cast(id % 5 as double) AS b", "cast(id % 3 as double) AS c").withColumn("y", 4 * F.col("a") + F.col("b"))
    assert ml.eliminate(df, ["a", "b", "c"], "y", 2) == ["a", "b"]
    assert ml.select_best(df.withColumn("g", F.col("a") > 5), ["a", "b", "c"], "g", 1) == ["a"]
    _, blend = ml.stack(df, ["linear_regressor", "tree_regressor"], ["a", "b"], "y", "id")
    assert blend[1] > 0.9
    shap = ml.linear_shap(df, ["a", "b"], [4.0, 1.0], "id").groupBy("id").agg(F.sum("shap").alias("s")).join(df, "id").agg(F.max(F.abs(F.col("s") - F.col("y"))), F.min(F.abs(F.col("s") - F.col("y")))).first()
    assert shap[0] == pytest.approx(shap[1])
