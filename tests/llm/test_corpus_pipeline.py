import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_minhash import brute as near_brute
from test_suffix_dedup import brute as _repeats
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import toxicity

SF = "/root/testdata/sf0.001"


def left_of(rows, width=100):
    """Texts without the strings of `width` bytes that start earlier too."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - width + 1):
            if data[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(data[i : i + width])
        out[doc_id] = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    return out


def test_stages_one_by_one_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {x.doc_id: x.text for x in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {x.doc_id for x in toxicity.score(docs, model).collect() if x.toxic}
    kept = {i: t for i, t in rows.items() if i not in toxic}
    state, by_stage = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns
        by_stage.append({x.doc_id: x.text for x in state.collect()})
    assert by_stage[0] == kept
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in first.values()}
    assert by_stage[1] == kept
    kept = {i: kept[i] for i, (_, _, stays) in near_brute(list(kept.items())).items() if stays}
    assert by_stage[2] == kept
    kept = left_of(list(kept.items()))
    assert by_stage[3] == kept
    assert {i: x[0][1] for i, x in _repeats(list(by_stage[2].items())).items()} == {i: len(by_stage[2][i].encode()) - len(t.encode()) for i, t in kept.items()} or any(ord(c) > 127 for t in by_stage[2].values() for c in t)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            want.add((i, p, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))])[:-1].tolist() and sum(n for _, n in parts) <= 2048


def write(spark, folder, rows, labels):
    ddl = "doc_id long, text string, lang string, source string, n_chars int, node string, spans int, _d string, digest string, c0 int"
    full = [(i, t, "en", "s", len(t or ""), f"n{k}", k, None, "x", k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_odd_rows_run_through_all_stages(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(30))
    lead, tail = " ".join(f"lead{i}" for i in range(40)) + " ", " " + " ".join(f"tail{i}" for i in range(40))
    long_ = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(5, None), (None, None), (3, ""), (7, "one  text"), (6, "one text"), (6, "one text"), (None, "one\ttext"), (8, lead + passage), (9, passage + tail), (9, "another text"), (20, long_), (2**62 + 1, "large id")]
    docs, labels = write(spark, tmp_path, rows, [(8, 1, 0), (9, None, None), (None, 1, 1)]), f"{tmp_path}"
    state, left = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.cut(stage(spark, state, labels), "odd")
        assert state.columns == docs.columns
        left.append(sorted(((x.doc_id, x.text) for x in state.collect()), key=str))
    ids = [sorted((i for i, _ in x), key=str) for x in left]
    assert len(left[0]) == len(rows)
    assert ids[1] == sorted([3, 6, 8, 9, 9, 20, 2**62 + 1], key=str)
    assert ids[2] == ids[1] == ids[3]
    assert (8, lead + passage) in left[3] and (9, "another text") in left[3] and any(i == 9 and t.endswith(tail) and len(t) < len(passage) + len(tail) / 2 for i, t in left[3])
    packed = corpus_pipeline.run(spark, f"{tmp_path}").collect()
    assert {x.doc_id for x in packed} == {3, 6, 8, 9, 20, 2**62 + 1}
    assert sum(x.piece > 0 for x in packed) > 10


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}").collect() == []
