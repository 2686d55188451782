import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from lumenframe.llm.sentencepiece import Encoder, Pieces, Viterbi, decode, encode, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(text, pieces, lead=" "):
    """Ids of the best path over the whole text at once."""
    text = lead + text
    best = [(0.0, -1, -1)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            found = pieces.value.get(text[start:end]) or ((-1, pieces.unknown) if end - start == 1 else None)
            if found and best[start] and (best[end] is None or best[start][0] + found[1] >= best[end][0]):
                best[end] = (best[start][0] + found[1], start, found[0])
    out, end = [], len(text)
    while end:
        _, start, i = best[end]
        out.append([i] if i >= 0 else [pieces.byte[b] for b in text[start:end].encode()])
        end = start
    return [i for x in reversed(out) for i in x]


TEXTS = ["Hello  world\n\tx é 你", "a", " ", "   lead and trail   ", "▁ sign ▁▁", "\n\n", "über die Straße \x00 \U0001f600", "x" * 500, "the" * 200, "no-blank-" * 90, "ab\r\n cd", " a  b   c "]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_best_path_and_decode(text):
    encoder = Encoder(PATH)
    ids = encoder.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == brute(text, encoder.pieces)
    assert encoder.decode(ids) == text


def test_random_texts():
    r, encoder = random.Random(3), Encoder(PATH)
    for _ in range(200):
        text = "".join(r.choice("theinga  \n.,é你▁") for _ in range(r.randrange(1, 120)))
        ids = encoder.encode(text)
        assert np.frombuffer(ids, dtype="<u4").tolist() == brute(text, encoder.pieces)
        assert encoder.decode(ids) == text


def test_the_library_agrees(tmp_path):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    pieces, proto = Pieces.of(PATH), pb.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, s in pieces.score.items():
        proto.pieces[i].score = s
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    encoder = Encoder(PATH)
    for text in ["The quick brown fox, jumped over 13 lazy dogs.", "Ein Satz mit Wörtern", "un petit texte é à", "words  apart"]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text)


def test_the_window_stays_small():
    stream = Viterbi(Pieces.of(PATH))
    out = stream.push(" " + "anathemaoftheinner" * 5000)
    assert stream.window < 4 * stream.pieces.longest and len(out) > 1000 and stream.commits > 1000
    encoder = Encoder(PATH)
    encoder.encode("x" * 300_000)
    assert encoder.stream.window < 4 * encoder.pieces.longest and encoder.stream.commits > 1_000


def test_whole_documents_are_committed_as_they_come():
    encoder, r = Encoder(PATH), random.Random(5)
    texts = [x for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if x]
    texts += ["".join(r.choice(["the", "Inner", " ", "xq", "straße", "_", "\n"]) for _ in range(4000)) for _ in range(3)]
    for text in sorted(texts, key=len)[-40:]:
        ids = encoder.encode(text)
        assert encoder.stream.commits >= len(text.split(" ")) and 0 < encoder.stream.window < 4 * encoder.pieces.longest
        if len(text) < 5_000:
            assert np.frombuffer(ids, dtype="<u4").tolist() == brute(text, encoder.pieces)


def test_pushed_in_any_parts():
    r, pieces = random.Random(6), Pieces.of(PATH)
    for _ in range(30):
        text = "".join(r.choice("theinga.é") for _ in range(400))
        stream, out, k = Viterbi(pieces), [], 0
        while k < len(text):
            n = r.randrange(1, 60)
            out += stream.push(text[k : k + n])
            k += n
        assert out + stream.close() == brute(text, pieces, lead="")


def test_tables(spark):
    rows = [(1, "a b", "z"), (2, None, "z"), (None, "", None), (1, "a b", "z"), (3, "é" * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = round_trip(docs, PATH).collect()
    assert len(got) == 5 and all(x.exact for x in got)
    back = decode(encode(docs, PATH), PATH).collect()
    assert sorted((x.doc_id or 0, x.text) for x in back) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert round_trip(docs.limit(0), PATH).collect() == []
    with pytest.raises(ValueError):
        Encoder(PATH).decode(np.array([1], dtype="<u4").tobytes())
