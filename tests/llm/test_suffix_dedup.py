import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import suffix_dedup as sd


def brute(rows, width=100):
    """rows: (doc_id, text), ordered by id."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.setdefault(doc_id, []).append((len(data), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdeé ü.\n"
    make = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [make(r.randrange(60, 400)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [make(r.randrange(0, 300)) for _ in range(3)]
        parts.insert(1, r.choice(passages)[r.randrange(0, 30) :])
        parts.insert(3, r.choice(passages))
        rows.append((i, "".join(parts)))
    rows += [(60 + i, rows[i][1]) for i in range(6)] + [(70, "ab" * 700), (71, "x" * 1500), (72, "x" * 99), (73, "x" * 100), (74, None), (75, ""), (76, "ba" * 500), (77, "abc " * 400)]
    return rows


def got(spark, rows, **extra):
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, _d int")
    out = {}
    for x in sd.annotate(docs).collect():
        out.setdefault(x.doc_id, []).append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    return out


@pytest.mark.parametrize("period", [1, 2, 4, 17, 60, 99, 100, 101, 300])
def test_one_periodic_text(spark, period):
    r = random.Random(period)
    unit = "".join(r.choice("abcdefgh ") for _ in range(period))
    rows = [(n, (unit * 500)[:n]) for n in (99 + period,)] if period < 5 else [(1, (unit * 40)[: 100 + 2 * period + 7])]
    rows.append((5000, "".join(r.choice("ABCDEFGH") for _ in range(150))))
    assert got(spark, rows) == brute(rows)
    rows = [(k, "".join(r.choice("ABCDEFGH") for _ in range(30)) + "".join(r.choice("XYZ") for _ in range(period)) * k) for k in range(1, 30, 4)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_small_shards_and_runs(monkeypatch):
    """Contexts and merged transforms without Spark, so that the sizes can be set."""
    rows = corpus(5)
    monkeypatch.setattr(sd, "SHARD", 700)
    monkeypatch.setattr(sd, "RUN", 40)
    want, data = brute(rows), [(t or "").encode() for _, t in rows]
    gone = [np.zeros(len(x), bool) for x in data]
    text, start, many, anchor, *_ = sd.contexts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 100)
    for a in np.unique(anchor):
        of = np.flatnonzero(anchor == a)
        of = of[np.lexsort((start[of], text[of]))]
        pieces = [data[text[k]][start[k] : start[k] + many[k] + 99] for k in of]
        begins = np.cumsum([0, *map(len, pieces[:-1])])
        for p in sd.repeats(pieces, 100).tolist():
            c = int(np.searchsorted(begins, p, side="right") - 1)
            at = int(start[of[c]] + p - begins[c])
            gone[text[of[c]]][at : at + 100] = True
    for (doc_id, _), x in zip(rows, gone, strict=True):
        assert int(x.sum()) == want[doc_id][0][1], doc_id


@pytest.mark.parametrize("width", [16, 17, 20, 36, 39, 64, 100])
def test_merge_orders_like_sorting(width):
    r = np.random.default_rng(1)
    shards = [r.integers(97, 100, n).astype(np.uint8) for n in (500, 1, 37, 900)]
    position, differs = sd.merge(shards, width)
    begins = np.cumsum([0, *map(len, shards[:-1])])

    def head(p):
        k = int(np.searchsorted(begins, p, side="right") - 1)
        x = shards[k].tobytes()
        at = int(p - begins[k])
        return (x[at:] + x * (width + 1))[:width]

    heads = [head(p) for p in position]
    assert sorted(position.tolist()) == list(range(sum(map(len, shards))))
    assert heads == sorted(heads)
    assert [bool(x) for x in differs] == [True, *(a != b for a, b in zip(heads[1:], heads, strict=False))]


def test_repeated_ids_nulls_and_strip(spark):
    long_ = "the quick brown fox " * 3 + "jumped over a lazy dog while the rain fell on the plain in é Spain today"
    rows = [(1, "start " + long_), (1, "start " + long_), (None, long_), (2, None), (3, "ok"), (4, long_ + " the end")]
    result = got(spark, rows)
    assert [x[1] for x in sorted(result[1])] == [0, len(("start " + long_).encode())]
    assert result[None][0][1] == len(long_.encode()) and result[2][0][:3] == (0, 0, 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((x.doc_id or 0, x.text) for x in sd.strip(docs).collect() if x.text is not None)
    assert left[0] == (0, "") and (4, " the end") in left and (3, "ok") in left
    assert sd.annotate(docs.limit(0)).collect() == [] and sd.strip(docs.limit(0)).collect() == []


def test_strings_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(sd, "MANY", 2)
    rows = corpus(4)
    assert got(spark, rows) == brute(rows)


def test_a_line_on_very_many_pages(spark):
    r = random.Random(8)
    line = " ".join(f"boiler{i}plate" for i in range(14))
    rows = [(i, f"{r.getrandbits(200):x} {line} {r.getrandbits(200):x}") for i in range(sd.MANY + 1500)]
    assert got(spark, rows) == brute(rows)


def test_strip_keeps_columns_of_any_name(spark):
    text = "passage " * 20
    rows = [(1, text, "a", 7, None), (2, "x" + text, "b", 8, "z"), (3, None, None, 9, "c0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _d string, spans int, c0 string")
    left = sd.strip(docs)
    assert left.columns == docs.columns
    assert sorted((x[0], x[2], x[3], x[4]) for x in left.collect()) == [(i, d, s, c) for i, _, d, s, c in rows]
