import random
import re

import pytest

from lumenframe.llm import minhash
from lumenframe.llm.components import components


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, families=12, copies=14):
    r, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for _ in range(families):
        base = r.choices(vocabulary, k=r.randrange(30, 400))
        for _ in range(copies):
            new = [w if r.random() > r.choice([0, 0.01, 0.03, 0.06]) else r.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(new) + r.choice(["", " \n", "\t"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(900, "One two  THREE"), (901, "one two three"), (902, None), (903, ""), (904, " \t"), (905, "one two three four"), (906, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, node int")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.annotate(docs).collect()}
    assert got == brute(rows)


def test_dedup_keeps_columns_and_the_smallest(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (2, "other text", "z"), (None, "other text", "n"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __node string")
    got = minhash.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((x.doc_id or -1, x.__getitem__("__node") or "") for x in got.collect()) == [(-1, ""), (1, "y"), (2, "z")]
    assert minhash.annotate(docs.limit(0)).collect() == []


def family(n, changed, seed=3):
    """Texts of 200 words, of which each replaces so many by its own."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(200), changed):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_family_below_the_threshold_gives_few_rows(spark, monkeypatch):
    """Pairs of a similarity of 0.6 to 0.76: links are no more than rows, though nearly all pairs are alike by signature."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    written = {}
    plain = minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, name: written.setdefault(name, []).append(out := plain(df, name)) or out)
    sizes = []
    real_drop = minhash.drop
    monkeypatch.setattr(minhash, "drop", lambda df: sizes.extend(x.count() for x in written.get("linked", [])[len(sizes) :]) or real_drop(df))
    rows = family(300, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.annotate(docs).collect()}
    assert got == brute(rows)
    assert len(sizes) == 3 and max(sizes) <= 20 * 300


def test_small_blocks_and_split_buckets(spark, monkeypatch):
    rows = corpus(7, 4, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SHINGLES", 3000)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.annotate(docs).collect()} == brute(rows)


def test_large_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2**62 + 5, text), (2**62 + 9, text + " x"), (None, "lone text here"), (2**63 - 1, "other"), (None, None)]
    got = {(x.doc_id, x.component_id, x.kept) for x in minhash.annotate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2**62 + 5, 2**62 + 5, True), (2**62 + 9, 2**62 + 5, False), (None, None, True), (2**63 - 1, 2**63 - 1, True)}


def test_components_of_a_path_a_star_and_a_clique(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(a, b) for a in range(200, 208) for b in range(a)if b >= 200] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}, **{i: 200 for i in range(201, 208)}}
