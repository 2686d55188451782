import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


def test_thresholds_share_weights_and_order():
    r = np.random.default_rng(1)
    x = r.normal(size=3000)
    z = 2 * x + r.logistic(size=3000)
    grade = (z > -1).astype(int) + (z > 2)
    w, theta = toxicity.fit_ordinal([{0: v} for v in x], grade, 1, ridge=0)
    assert abs(w[0] - 2) < 0.25 and abs(theta[0] + 1) < 0.25 and abs(theta[1] - 2) < 0.25
    p = toxicity.Model({"a": 1.0}, tuple(theta)).above(np.array([-50.0, 0.0, 50.0]))
    assert (np.diff(p, axis=1) <= 0).all() and p[0].max() < 1e-6 and p[2].min() > 1 - 1e-6


def test_planted_words_are_caught_and_clean_texts_left(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = r.choices(words, k=r.randrange(5, 120))
        bad = i % 6 == 0
        for _ in range(r.randrange(1, 6) if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["zorkel", "Zorkelish", "blimfo,"]))
        docs.append((i, " ".join(text), bad))
        if i % 2 == 0:
            labels.append((i, int(bad), "n"))
    docs += [(1000, None, False), (1001, "", False), (1002, "zorkel " * 20_000, True), (None, "blimfo", True)]
    labels += [(None, 1, "n"), (2000, None, "n")]
    d = spark.createDataFrame(docs, "doc_id long, text string, severity boolean")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))
    assert len(model.theta) == 2
    got = toxicity.score(d, model).collect()
    want = {i: b for i, _, b in docs}
    assert sum(x.toxic != want[x.doc_id] for x in got) == 0 and len(got) == len(docs)
    assert all(abs(x.severity) >= 0 and x.grade in (0, 1, 2) for x in got)
    kept = toxicity.clean(d, model)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, b in want.items() if not b}


def test_no_labels_or_one_class(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [(x.severity, x.toxic) for x in toxicity.score(d, model).collect()] == [(0.0, False)] * 2
    assert toxicity.score(d.limit(0), model).collect() == [] and toxicity.clean(d.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = language_id.fit(train)
    truth = {x.doc_id: x.lang for x in docs.select("doc_id", "lang").collect()}
    got = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())


def test_mixtures_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    texts = {x.lang: x.text for x in docs.filter("n_chars > 3000").collect()}
    mixed = texts["en"][:2000] + "\n" + texts["de"][:900]
    odd = spark.createDataFrame([(1, mixed, 9), (2, None, 9), (3, "", 9), (4, "123 %% -", 9), (7, "½ ² Ⅷ ①", 9), (8, "½ é", 9), (5, texts["fr"] * 40, 9), (None, texts["es"], 9), (6, "ß", 9)], "doc_id long, text string, score int")
    got = {x.doc_id: x for x in language_id.predict(odd, model).collect()}
    assert got[1].lang_pred == "en" and got[1].languages == ["de", "en"] and 0.55 < got[1].score < 0.85
    assert [(got[k].lang_pred, got[k].score) for k in (2, 3, 4, 7)] == [("und", 0.0)] * 4 and got[8].lang_pred != "und"
    assert got[5].lang_pred == "fr" and got[None].lang_pred == "es" and got[6].lang_pred in {"de", "en", "es", "fr"}
    none = language_id.fit(docs.limit(0))
    assert {x.lang_pred for x in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), model).collect() == []


def test_em_recovers_proportions():
    r = np.random.default_rng(2)
    p = r.dirichlet(np.full(200, 0.3), 3).T
    n = r.multinomial(40_000, p @ [0.6, 0.0, 0.4]).astype(float)
    chosen, share = language_id.select(p + 1e-9, n)
    assert chosen == [0, 2] and abs(share[0] - 0.6) < 0.02


def test_a_language_of_small_share_is_learned(spark):
    r = random.Random(5)
    text = lambda letters, words: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(words))
    rows = [(i, text("abcdef", 20), "aa") for i in range(2500)] + [(i + 5000, text("ghijkl", 20), "bb") for i in range(2500)] + [(9000, text("mnopqr", 4000), "cc")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(1, text("mnopqr", 60)), (2, text("abcdef", 60)), (3, text("ghijkl", 60))], "doc_id long, text string")
    assert {x.doc_id: x.lang_pred for x in language_id.predict(asked, model).collect()} == {1: "cc", 2: "aa", 3: "bb"}


def test_many_languages_give_the_same_with_and_without_the_full_matrix(monkeypatch):
    r = np.random.default_rng(3)
    n = r.poisson(0.3, (400, 60)) * r.integers(1, 50, (400, 60))
    row, column = np.nonzero(n)
    total = n.sum(0) + 0.5 * language_id.CELLS
    p = language_id.Sparse(0.5 / total, row, column, n[row, column] / total[column], 400)
    assert np.allclose(p.full(), (n + 0.5) / total)
    seen = r.poisson(3 * (n[:, 7] + n[:, 30]) / 10) + 1
    want, share = language_id.select(p.full(), seen)
    monkeypatch.setattr(language_id, "FULL", 0)
    got, sparse = language_id.select(p, seen)
    assert got == want and np.allclose(share, sparse)


def test_language_model_and_shares_against_brute_force(spark):
    """Trigram counts, likelihoods and EM shares, computed again by plain loops."""
    from collections import Counter

    r = random.Random(9)
    rows = [(i, "".join(r.choice("abcdé fg." if i % 2 else "efgh ijk1") for _ in range(r.randrange(1, 200))), "ab"[i % 2]) for i in range(60)] + [(100, None, "a"), (101, "", "b"), (102, "x y", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def cells(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        data = bytes([32, *(32 if b < 97 or 122 < b < 128 else b for b in low), 32])
        codes = [data[k] << 16 | data[k + 1] << 8 | data[k + 2] for k in range(len(data) - 2)]
        return Counter(((c * 2654435769) & 0xFFFFFFFF) >> 16 for c in codes if c != 0x202020)

    counts = {x: sum((cells(t) for _, t, lang in rows if lang == x and t is not None), Counter()) for x in "ab"}
    likelihood = lambda lang, cell: (counts[lang][cell] + 0.5) / (sum(counts[lang].values()) + 0.5 * language_id.CELLS)
    found = {x.doc_id: x for x in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert found[i].lang_pred == "und"
            continue
        own = sorted(cells(text).items())
        p = np.array([[likelihood(x, c) for x in "ab"] for c, _ in own])
        n = np.array([k for _, k in own]) / 3

        def em(p):
            share = np.full(p.shape[1], 1 / p.shape[1])
            for _ in range(30 if p.shape[1] > 1 else 0):
                new = np.array([sum(n[k] * share[j] * p[k, j] / sum(share[m] * p[k, m] for m in range(p.shape[1])) for k in range(len(n))) for j in range(p.shape[1])]) / n.sum()
                done = np.abs(new - share).max() < 1e-4
                share = new
                if done:
                    break
            return share, sum(n[k] * np.log(sum(share[j] * p[k, j] for j in range(p.shape[1]))) for k in range(len(n)))

        share, best = em(p)
        chosen = [0, 1]
        least = int(share.argmin())
        _, alone = em(p[:, [1 - least]])
        if best - alone <= 3 + 0.5 * np.log1p(n.sum()):
            chosen, share = [1 - least], np.ones(1)
        k = int(share.argmax())
        assert found[i].lang_pred == "ab"[chosen[k]] and abs(found[i].score - share[k]) < 1e-9


def test_the_ordinal_fit_is_the_likelihoods_maximum():
    """Against a plain likelihood: no small step in any parameter makes it better."""
    r = np.random.default_rng(8)
    rows = [{int(f): float(v) for f, v in zip(r.choice(4, 2, replace=False), r.random(2) * 2, strict=True)} for _ in range(400)]
    grade = np.array([min(2, int(max(0, 1.5 * x.get(0, 0) - x.get(1, 0) + r.logistic() * 0.7))) for x in rows])
    w, theta = toxicity.fit_ordinal(rows, grade, 4, ridge=1e-2, steps=3000, rate=0.02)

    def cost(w, theta):
        total = 0.0
        for x, g in zip(rows, grade, strict=True):
            z = sum(w[f] * v for f, v in x.items())
            upper = 1.0 if g == 2 else 1 / (1 + np.exp(z - theta[g]))
            lower = 0.0 if g == 0 else 1 / (1 + np.exp(z - theta[g - 1]))
            total -= np.log(upper - lower)
        return total / len(rows) + 0.5e-2 * (w @ w)

    best = cost(w, theta)
    for k in range(4):
        for step in (-0.05, 0.05):
            assert cost(w + step * np.eye(4)[k], theta) > best
    for k in range(2):
        for step in (-0.05, 0.05):
            assert cost(w, theta + step * np.eye(2)[k]) > best
