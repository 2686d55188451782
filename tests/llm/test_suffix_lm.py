import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import suffix_lm as lm

TEXTS = ["The cat sat.  On the\tmat ", "the dog sat on the log", None, "", "  ", "The cat sat.  On the\tmat ", "zebra " * 300, "é à\x1c ü"] + [f"the cat number {i} sat on the mat" for i in range(60)]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def symbols(text):
    return [*" ".join(tokens(text)).encode(), 255]


def brute(texts, train, depth, least):
    """The tree and scores, by plain dictionaries."""
    counts = [Counter() for _ in range(depth + 1)]
    total = 0
    for t in train:
        s = [254] * depth + symbols(t)
        for i in range(depth, len(s)):
            total += 1
            for k in range(depth + 1):
                counts[k][tuple(s[i - k : i]), s[i]] += 1
    sums, kinds = Counter(), Counter()
    for c in counts:
        for (ctx, _), n in c.items():
            sums[ctx] += n
            kinds[ctx] += 1
    states = {()}
    for k in range(1, depth + 1):
        for ctx in {c for c, _ in counts[k]}:
            if sums[ctx] >= least * total:
                gain = sum(n * math.log((n / sums[ctx]) / (counts[k - 1][ctx[1:], x] / sums[ctx[1:]])) for (c, x), n in counts[k].items() if c == ctx)
                if gain > 0.5 * kinds[ctx] * math.log(sums[ctx]):
                    states |= {ctx[i:] for i in range(k + 1)}

    def p(ctx, x):
        if ctx not in states or not sums[ctx]:
            return p(ctx[1:], x) if ctx else 1 / 256
        lower = p(ctx[1:], x) if ctx else 1 / 256
        return (counts[len(ctx)][ctx, x] + kinds[ctx] * lower) / (sums[ctx] + kinds[ctx])

    out = []
    for t in texts:
        s = [254] * depth + symbols(t)
        out.append(sum(math.log10(p(tuple(s[i - depth : i]), s[i])) for i in range(depth, len(s))))
    return out, states, p


@pytest.mark.parametrize("depth", [2, 4])
def test_against_brute_force(spark, depth):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, score int")
    held = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in lm.score(docs, held, depth=depth, least=0.001).collect()}
    train = [t for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 10]
    want, states, p = brute(TEXTS, train, depth, 0.001)
    assert len(states) > 5
    assert sum(p((101,) * 0 + (116, 104)[-depth:], x) for x in range(256)) == pytest.approx(1)
    count = Counter(w for t in train for w in tokens(t))
    count["</end>"] = len(train)
    n = sum(count.values())
    for i, t in enumerate(TEXTS):
        own = [*tokens(t), "</end>"]
        assert got[i].score == pytest.approx(want[i], abs=1e-9), i
        assert (got[i].n_tokens, got[i].train_tokens, got[i].n_known) == (len(own), n, sum(count[w] > 0 for w in own))
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in own))
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_rare_words_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    held = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 10 == 0
    want = lm.score(docs, held, depth=2).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "FREQUENT", 0.05)
    got = lm.score(docs, held, depth=2).orderBy("doc_id").collect()
    assert [(x.doc_id, x.n_known, round(x.base_score, 9)) for x in got] == [(x.doc_id, x.n_known, round(x.base_score, 9)) for x in want]


def test_degenerate_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = lm.score(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 10 == 0).collect()
    assert len(rows) == 2 and not any(r.held_out for r in rows)
    only = lm.score(docs, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in only} == {(3, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert only[0].score == pytest.approx(-np.log10(256) * (4 if only[0].n_tokens == 3 else 1))
    assert lm.score(docs.limit(0), F.lit(False)).collect() == []


def test_contexts_of_a_small_table_stay_in_a_large_one(spark):
    """What a context needs doesn't rise with the corpus: two rows of a rare text, beside ever more of another."""
    rare, score = "qxjv wzkq", {}
    for n in (100, 20_000):
        rows = [(i, rare) for i in (1, 2, 3)] + [(10 + i, "the cat sat on the mat, the dog on the log and the rat on the hat " * 10) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        score[n] = [x.score for x in lm.score(docs, F.col("doc_id") == 3).filter("doc_id = 3").collect()][0]
    assert score[20_000] > -12 and abs(score[20_000] - score[100]) < 5


def test_rare_paths_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    held = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 10 == 0
    want = lm.score(docs, held).orderBy("doc_id").collect()
    monkeypatch.setattr(lm, "PATHS", 0.01)
    got = lm.score(docs, held).orderBy("doc_id").collect()
    assert [x.score for x in got] == pytest.approx([x.score for x in want])
