import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Hello, World! it's 123 a b c　d <|endoftext|> x\x1cy z\x85w", "a​b é don'T <|startoftext|>x   \x1d q,", "İstanbul ΣΑΣ. ΣΑΣ, x., a!, É, é. .. , .", "",
    "́ ́abc a<|endoftext|>,b. x<|y, A<|startoftext|>.", "ernt*** of%%% a|b c_ _d '' 'S 'sx rock' dogs'. ÀÈ, straße ſ½ x² \x00", "각 가각 ﬁ Ǆ, ŉ, ẞ",
]


def ids(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    words, r = packing.WordIds(PATH), random.Random(2)
    texts = ODD + ["".join(r.choice("abcDEé ,.'<|>12\t\n%|sS \x1f") for _ in range(r.randrange(80))) for _ in range(300)]
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(2):  # new words, then known ones
        for text, got in zip(texts, words.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.WordIds(PATH)
    for k in range(40):
        text = " ".join(f"word{k + j}, Abc{j}." for j in range(6))
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_uses_every_piece_and_few_sequences(seed):
    r, counts = random.Random(seed), defaultdict(int)
    for _ in range(3000 * seed):
        counts[min(256, int(r.lognormvariate(4, 1)) + 1)] += 1
    plan, used = packing.plan(counts, 256), defaultdict(int)
    for lengths, many in plan:
        assert sum(lengths) <= 256
        for x in lengths:
            used[x] += many
    assert used == counts
    assert sum(m for _, m in plan) <= 1.01 * math.ceil(sum(a * b for a, b in counts.items()) / 256) + 1


@pytest.mark.parametrize("seed", range(6))
def test_sums_against_brute_force(seed):
    """A single, pair or triple is found just where one is there, and it fills the gap."""
    r, capacity = random.Random(seed), 30
    left = np.array([0] + [r.choice([0, 0, 1, 2, 3]) for _ in range(capacity)])
    sums = packing.Sums(left)
    for _ in range(200):
        there = [x for x in range(1, capacity + 1) for _ in range(left[x])]
        if not there:
            break
        own = r.choice(there)
        others = list(there)
        others.remove(own)
        gap = r.randrange(1, capacity)
        for k, find in enumerate((sums.single, sums.pair, sums.triple), 1):
            found, exists = find(gap, (own,)), any(sum(c) == gap for c in itertools.combinations(others, k)) if len(others) < 60 or k < 3 else None
            assert exists is None or (found is not None) == exists
            if found:
                rest = list(others)
                for x in found:
                    rest.remove(x)
                assert sum(found) == gap
        left[r.choice(there)] -= 1


def test_few_sequences_against_the_best_there_is():
    """Small cases: as few sequences as any partition, or one more."""
    r = random.Random(11)
    for _ in range(40):
        capacity, pieces = 12, [r.randrange(1, 13) for _ in range(7)]

        def fewest(rest, rooms):
            if not rest:
                return len(rooms)
            x, more = rest[0], rest[1:]
            tries = [fewest(more, [*rooms, capacity - x])]
            for k, room in enumerate(rooms):
                if room >= x:
                    tries.append(fewest(more, [*rooms[:k], room - x, *rooms[k + 1 :]]))
            return min(tries)

        counts = defaultdict(int)
        for x in pieces:
            counts[x] += 1
        assert sum(m for _, m in packing.plan(counts, capacity)) <= fewest(sorted(pieces, reverse=True), []) + 1


def test_plan_edges():
    assert packing.plan({}, 8) == []
    assert sum(m for _, m in packing.plan({4: 5}, 8)) == 3
    assert sum(m for _, m in packing.plan({5: 2, 3: 1, 1: 2}, 8)) == 2
    assert sum(m for _, m in packing.plan({2: 4}, 8)) == 1
    assert sum(m for _, m in packing.plan({1: 17}, 8)) == 3


def test_packed_documents(spark):
    r = random.Random(5)
    texts = ODD + [None, "", "word " * 5000] + [" ".join(r.choices(["ab", "cd,", "e"], k=r.randrange(1, 3000))) for _ in range(60)]
    rows = [(k, t, 3) for k, t in enumerate(texts)] + [(None, "x", 1), (7, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(docs, PATH).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in got:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for doc_id, text, _ in rows:
        want = [*ids(text or ""), 0]
        parts = [(p, k, len(want[k : k + 2048]), zlib.crc32(np.array(want[k : k + 2048], "<u4").tobytes())) for p, k in enumerate(range(0, len(want), 2048))]
        assert set(parts) <= {(x.piece, x.start, x.length, x.ids_crc32) for x in by_doc[doc_id]}
    assert len(got) == sum(max(1, math.ceil((len(ids(t or "")) + 1) / 2048)) for _, t, _ in rows)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x.length for x in got)
    assert len(by_sequence) <= 1.05 * math.ceil(total / 2048) + 1
    assert packing.pack_documents(docs.limit(0), PATH).collect() == []
