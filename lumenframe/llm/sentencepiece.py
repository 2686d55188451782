"""SentencePiece encoding by streaming Viterbi, and decoding.

A text is encoded with a leading blank, blanks written as the piece sign U+2581, into the pieces whose scores sum highest; a
character that no piece holds becomes its UTF-8 bytes' ids. All text goes through one streaming pass. It keeps best scores and
backpointers of the characters since the last commit. Once the backpointer paths of all live positions (ends of pieces that
begin before the last position settled) meet in one boundary, what lies before it can't change: its ids are committed and
forgotten. The window is what is held: at most `longest` characters that are not settled yet, a step of as many more, and what
is settled but still open - a few pieces, as paths meet at the first place that no live piece crosses.

Paths always meet before a blank that follows another character, and around a line end (if no piece holds one): no piece crosses
these seams, so one position is live there. From a seam to the next the ids hang on nothing else, so the pass remembers the spans
it committed between seams, and commits a span it knows without going through its characters again.

Scores: the model file's pieces in their order, `zipf` scoring the r-th as -log(r + 2) rounded to 1/64 (so sums are exact and
ties are the same everywhere), `model` taking the file's own scores. Of equal paths the one with the later start of its last
piece wins at each position (so in a text that repeats itself, what is left over stands at the end, and paths meet). Decoding joins the pieces' bytes and drops the leading blank; decode(encode(x)) == x for every text.

Defined results: a null or empty text has no ids and decodes to an empty one; ids outside the model raise ValueError in decode;
null doc_id, repeated rows and further columns don't matter; a very long text, blanks or none in it, takes the window and its
ids; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import arrow_schema, whole_text

BLANK = "▁"
#: Spans a worker remembers, of a generation; longer ones than KEPT characters are gone through each time.
REMEMBERED, KEPT = 300_000, 256
_SPANS = re.compile(r" *[^ ]+| +")


class Pieces:
    """The pieces of a model file, their scores and bytes."""

    made: dict[tuple[str, str], Pieces] = {}

    def __init__(self, path: str, scores: str = "zipf"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {i: round(-math.log(r + 2) * 64) / 64 if scores == "zipf" else model.get_score(i) for r, i in enumerate(normal)}
        #: Blanks are kept as blanks here; a U+2581 in a text is an unknown character and goes by its bytes.
        self.id = {names[i].replace(BLANK, " "): i for i in normal}
        self.value = {p: (i, self.score[i]) for p, i in self.id.items()}
        #: Pieces with id and score, and what pieces begin with, without.
        self.begun = {p[:k]: None for p in self.id for k in range(1, len(p))} | self.value
        self.longest = max(map(len, self.id))
        self.byte = {int(names[i][1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = min(self.score.values()) - 10
        self.bytes: list[bytes | None] = [None] * size
        for p, i in self.id.items():
            self.bytes[i] = p.encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.line_ends = not any("\n" in p for p in self.id)
        self.blanks_lead = not any(" " in p.lstrip(" ") for p in self.id)

    @classmethod
    def of(cls, path: str, scores: str = "zipf") -> Pieces:
        if (path, scores) not in cls.made:
            cls.made[path, scores] = cls(path, scores)
        return cls.made[path, scores]


class Viterbi:
    """Ids of a stream of characters: push() as they come, close() at the end. Both return the ids committed by then."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.text = ""  # since the last commit
        self.score: list[float | None] = [0.0]
        self.back: list[tuple[int, int]] = [(-1, -1)]  # start and id of the best last piece; id -1: an unknown character
        self.done = 0  # positions whose pieces onwards have been tried
        self.window = 0  # the most characters that were held at once
        self.commits = 0
        self.patience = 0  # characters at which a wide window is looked through again

    def push(self, more: str, seam: bool = False) -> list[int]:
        """Takes characters; with `seam`, no piece can cross their end."""
        out: list[int] = []
        step = self.pieces.longest
        for k in range(0, len(more), step):
            self.text += more[k : k + step]
            self.window = max(self.window, len(self.text))
            if seam and k + step >= len(more):
                break
            # a position is settled once all pieces that could start there can be seen whole
            self._try(len(self.text) - step)
            if len(self.text) <= 4 * step or len(self.text) >= self.patience:
                out += self._commit()
                self.patience = 2 * len(self.text)
        if seam and self.text:
            # the only live position is the end
            self._try(len(self.text))
            out += self._ids(len(self.text))
            self.text, self.score, self.back, self.done = "", [0.0], [(-1, -1)], 0
            self.commits += 1
        return out

    def close(self) -> list[int]:
        return self.push("", seam=True)

    def _try(self, to: int) -> None:
        text, score, back, begun, longest = self.text, self.score, self.back, self.pieces.begun, self.pieces.longest
        missing = len(text) + 1 - len(score)
        if missing > 0:
            score += [None] * missing
            back += [(-1, -1)] * missing
        size = len(text)
        for i in range(self.done, to):
            base = score[i]
            if base is None:
                continue
            j, single, most = i + 1, False, min(i + longest, size)
            while j <= most:
                found = begun.get(text[i:j], 0)
                if found:
                    if j == i + 1:
                        single = True
                    s = base + found[1]
                    if score[j] is None or s >= score[j]:
                        score[j], back[j] = s, (i, found[0])
                elif found == 0:
                    break
                j += 1
            if not single:
                s = base + self.pieces.unknown
                if score[i + 1] is None or s >= score[i + 1]:
                    score[i + 1], back[i + 1] = s, (i, -1)
        self.done = max(self.done, to)

    def _commit(self) -> list[int]:
        """Ids up to the boundary in which the paths of all live positions meet, if there is one."""
        live = {i for i in range(max(self.done, 0), len(self.text) + 1) if self.score[i] is not None}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last][0])
        meet = live.pop() if live else 0
        if meet <= 0:
            return []
        self.commits += 1
        out, base = self._ids(meet), self.score[meet]
        self.text = self.text[meet:]
        self.score = [None if s is None else s - base for s in self.score[meet:]]
        self.back = [(a - meet, b) for a, b in self.back[meet:]]
        self.done -= meet
        return out

    def _ids(self, end: int) -> list[int]:
        out: list[int] = []  # from the last
        while end > 0:
            start, i = self.back[end]
            if i >= 0:
                out.append(i)
            else:
                out += [self.pieces.byte[b] for b in reversed(self.text[start:end].encode("utf-8", "surrogatepass"))]
            end = start
        return out[::-1]


class Encoder:
    def __init__(self, path: str, scores: str = "zipf"):
        self.pieces = Pieces.of(path, scores)
        #: Ids, number of commits and window of spans.
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.last: dict[str, tuple[bytes, int, int]] = {}  # what was known before that
        self.stream = Viterbi(self.pieces)

    def spans(self, text: str) -> list[str]:
        """The parts of a blank and the text between seams."""
        if not self.pieces.blanks_lead:
            return [" " + text]
        out: list[str] = []
        lines = text.split("\n") if self.pieces.line_ends else [text]
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            else:
                line = " " + line
            words = line.split(" ")
            if "" in words[1:]:
                out += _SPANS.findall(line)
            else:
                if words[0]:
                    out.append(words[0])
                out += [" " + w for w in words[1:]]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers. The stream's `commits` and `window` are those of this text then."""
        stream = self.stream
        stream.commits = stream.window = 0
        if not text:
            return b""
        if len(self.known) > REMEMBERED:
            self.last, self.known = self.known, {}
        known, last, out, commits, window = self.known, self.last, [], 0, 0
        for span in self.spans(text):
            found = known.get(span)
            if found is None:
                found = last.get(span)
                if found is None:
                    stream.commits = stream.window = 0
                    ids = np.array(stream.push(span, seam=True), dtype="<u4").tobytes()
                    found = ids, stream.commits, stream.window
                if len(span) <= KEPT:
                    known[span] = found
            out.append(found[0])
            commits += found[1]
            if found[2] > window:
                window = found[2]
        stream.commits, stream.window = commits, window
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.pieces.bytes
        try:
            data = b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        except (IndexError, TypeError):
            raise ValueError("an id is not that of a piece or byte") from None
        return data[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """doc_id, ids array<int>; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, scores)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(encoder.encode(x.as_py()), dtype="<u4").astype(np.int32) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            texts = [encoder.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """doc_id, n_ids, ids_sha256 (little-endian unsigned 32-bit), decoded_sha256, exact, n_commits, most characters held: whole
    texts encoded, then decoded."""
    ddl = "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean, n_commits long, window int"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, scores)
        for batch in batches:
            rows = []
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = x.as_py()
                ids = encoder.encode(text)
                again = encoder.decode(ids)
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(again.encode()).hexdigest(), again == text, encoder.stream.commits, encoder.stream.window))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, ddl)
