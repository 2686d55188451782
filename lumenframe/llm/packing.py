"""Best-fit packing of tokenised documents into sequences, by exact-complement hashing.

Documents are tokenised and cut into pieces of at most `capacity` tokens; only a document longer than that is cut. How pieces
are combined depends on their lengths alone, of which there are `capacity` at most: the driver plans on that histogram, whose
size does not grow with the data. Pair sums and triple sums of the lengths there are are indexed once. Largest first, each length
looks up its gap among single lengths, pair sums and triple sums, and takes as many exact combinations as the counts allow at once;
what finds no exact complement is packed by best fit, decreasing. A plan is a list of (lengths, how many sequences). Every piece has a rank among the pieces of its length - the
pieces of its length in earlier tasks, plus its rank within its task - and the plan gives each rank its sequence and offset.

Defined results: a null text is empty and still has its end token; a null doc_id or a repeated row is packed like any other;
a very long text is many pieces, of which the last may be short; of pieces of one length (ties) the order within their tasks
decides; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import arrow_schema, cut, remembered, text_chunks, whole_text

#: Words of a generation that a worker remembers the ids of; beyond it, a new one begins, and what the last one holds is
#: taken over as it is met again.
REMEMBERED = 300_000
#: White space as the tokenizer's \s has it: Python's own also has the separators 1C-1F.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Latin letters (but for those whose lower case is two characters), then punctuation.
_TAILED = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([!-/:-@\[-`{-~]*)")
#: Lower-case Latin letters that are one code point however normalised.
_LOWER = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
_OWN = re.compile(r"[\x1c-\x1f]")


class WordIds:
    """Ids of a text by a tokenizer whose normaliser and pre-tokeniser never look across white space and drop it.

    So a text's ids are those of its words, one after another, and a word's ids need computing once. Bytes are ids as
    little-endian unsigned 32-bit numbers. New words are encoded many at a time: those of plain lower-case letters joined by
    blanks, by a copy without normaliser and pattern, which leave them alone - each has one token that ends a word; others joined
    by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self._without_rules(path)
        self.known: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        special = next(iter(sorted(self.tokenizer.get_added_tokens_decoder().items(), reverse=True)), None)
        self.mark, self.mark_id = (special[1].content, special[0]) if special else (None, -1)

    @staticmethod
    def _without_rules(path: str):
        """The same vocabulary, for words that the normaliser and the pattern leave as they are."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        out = Tokenizer.from_file(path)
        out.normalizer = None
        out.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One for each worker and path, as long as the worker packs."""
        return remembered("packing", path, lambda: cls(path))

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [x.split() if not _OWN.search(x) else [w for w in _SPACE.split(x) if w] for x in texts]
        known, last = self.known, self.last
        if len(known) > REMEMBERED:
            self.last, self.known = last, known = known, {}
        found = [list(map(known.get, w)) for w in words]
        gaps = [(w, f, [i for i, x in enumerate(f) if x is None]) for w, f in zip(words, found, strict=True) if None in f]
        new = {w[i] for w, _, at in gaps for i in at}
        self._learn([w for w in new if not self._taken_over(w)])
        for w, f, at in gaps:
            for i in at:
                f[i] = known[w[i]]
        return [b"".join(f) for f in found]

    def _taken_over(self, word: str) -> bool:
        """Whether the last generation knows the word, which is then one of this generation too."""
        ids = self.last.get(word)
        if ids is None:
            return False
        self.known[word] = ids
        return True

    def _learn(self, words: list[str]) -> None:
        # ASCII punctuation right after letters is a token run of its own, and plain letters are lower-cased one by one,
        # whatever stands around
        known, stems, parts = self.known, set(), []
        for w in words:
            stem = w.rstrip(string.punctuation)
            if stem and stem.isascii() and stem.isalpha():  # what the pattern finds in ASCII
                tail, stem = w[len(stem) :], stem.lower()
            elif m := _TAILED.fullmatch(w):
                stem, tail = m[1].lower(), m[2]
            else:
                stem, tail = w, ""
            stems.add(stem)
            if tail:
                stems.add(tail)
            if tail or stem != w:
                parts.append((w, stem, tail))
        todo = [s for s in stems if s not in known and not self._taken_over(s)]
        self._encode(todo)
        for w, stem, tail in parts:
            known[w] = known[stem] + known[tail] if tail else known[stem]

    def _encode(self, words: list[str]) -> None:
        known, letters, others = self.known, [], []
        for w in words:
            (letters if w.isascii() and w.isalpha() and w.islower() or _LOWER.fullmatch(w) else others).append(w)
        for i in range(0, len(letters), 1000):
            some = letters[i : i + 1000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                data, ends = ids.tobytes(), (4 * last).tolist()
                known.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))
            else:
                others += some
        known.update(zip(others, self._encode_any(others), strict=True))

    def _encode_any(self, words: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            if self.mark is None or any(self.mark in w for w in some):
                out += [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(some, add_special_tokens=False)]
                continue
            ids = np.array(self.tokenizer.encode(self.mark.join(some), add_special_tokens=False).ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for end in [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]:
                out.append(data[4 * at : 4 * end])
                at = end + 1
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, _task, _rank) and, if asked for, ids as bytes.

    _rank counts the pieces of that length in that task. Ranks follow the order a task reads its rows in, so the caller
    writes the table before it is used twice.
    """
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long" + ", ids binary" * with_ids
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, ranks = WordIds.of(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            encoded = (x for i, j, _, _ in text_chunks(batch, "text", 1 << 18) for x in words.encode(batch.column(1).slice(i, j - i).to_pylist()))
            for doc_id, data in zip(batch.column(0).to_pylist(), encoded, strict=True):
                data += end
                for k in range(0, len(data), width):
                    part = data[k : k + width]
                    n = len(part) // 4
                    for out, x in zip(columns, (doc_id, k // width, k // 4, n, zlib.crc32(part), task, ranks[n], part), strict=False):
                        out.append(x)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text")).mapInArrow(run, ddl)


class Sums:
    """Pairs and triples of lengths by their sum, consumed as counts run out.

    `left` counts the pieces of each length and only ever falls, so what is found used up is passed over for good.
    """

    def __init__(self, left: np.ndarray):
        self.left, capacity = left, len(left) - 1
        lengths, there = np.flatnonzero(left)[::-1], left > 0
        #: By sum: larger parts of its pairs, descending.
        self.pairs = [lengths[(lengths < s) & (2 * lengths >= s) & there[s - np.minimum(lengths, s)]].tolist() for s in range(capacity + 1)]
        sums = np.array([bool(x) for x in self.pairs])
        #: By sum: parts that leave a sum of a pair, descending.
        self.triples = [lengths[(lengths < s) & sums[s - np.minimum(lengths, s)]].tolist() for s in range(capacity + 1)]
        self.pair_at, self.triple_at = [0] * (capacity + 1), [0] * (capacity + 1)

    def single(self, length: int, used: tuple[int, ...]) -> tuple[int] | None:
        return (length,) if self.left[length] > used.count(length) else None

    def pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair of that sum with the largest part, of pieces that are there beside `used`."""
        left, options, k = self.left, self.pairs[total], self.pair_at[total]
        gone = lambda a: not left[a] or not left[total - a] or 2 * a == total and left[a] < 2
        while k < len(options) and gone(options[k]):
            k += 1
        self.pair_at[total] = k
        for a in options[k:]:
            b = total - a
            if not gone(a) and left[a] > used.count(a) + (a == b) and left[b] > used.count(b):
                return a, b
        return None

    def triple(self, total: int, used: tuple[int, ...]) -> tuple[int, int, int] | None:
        left, options, k = self.left, self.triples[total], self.triple_at[total]
        while k < len(options) and (not left[options[k]] or self.pair_at[total - options[k]] == len(self.pairs[total - options[k]])):
            k += 1
        self.triple_at[total] = k
        for a in options[k:]:
            if left[a] > used.count(a) and (rest := self.pair(total - a, (*used, a))):
                return a, *rest
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just these), for so many pieces of each length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, out, rest = Sums(left), [], {}
    for length in range(capacity, 0, -1):
        gap, own = capacity - length, (length,)
        while left[length]:
            others = (sums.single(gap, own) or sums.pair(gap, own) or sums.triple(gap, own)) if gap else ()
            if others is None:
                rest[length] = int(left[length])
                left[length] = 0
                break
            lengths = own + others
            many = min(int(left[x]) // lengths.count(x) for x in lengths)
            out.append((lengths, many))
            for x in lengths:
                left[x] -= many
    return out + _best_fit(rest, capacity)


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on groups of equal sequences."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by what is free
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            free = min((f for f, groups in room.items() if f >= length and groups), default=None)
            if free is None:
                each = min(capacity // length, n)
                many = n // each
                room[capacity - each * length].append(((length,) * each, many))
                n -= each * many
                continue
            lengths, many = room[free].pop()
            used = min(many, n)
            if many > used:
                room[free].append((lengths, many - used))
            room[free - length].append(((*lengths, length), used))
            n -= used
    return [x for groups in room.values() for x in groups]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where each run of ranks starts, the first rank's sequence, and the offset there."""
    runs, used, first = defaultdict(list), defaultdict(int), 0
    for lengths, many in patterns:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], first, offset))
            used[x] += many
            offset += x
        first += many
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*found, strict=True)) for x, found in runs.items()}


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """cut_pieces (written rows of pieces()) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    by_task = cut_pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {x["length"]: x["n"] for x in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    before = by_task.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).drop("n")
    ranked = cut_pieces.join(before, ["length", "_task"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [c for c in cut_pieces.columns if not c.startswith("_")]
    ranked = ranked.select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                at = length == x
                starts, first, offsets = places.value[x]
                k = np.searchsorted(starts, rank[at], side="right") - 1
                sequence[at], offset[at] = first[k] + rank[at] - starts[k], offsets[k]
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    out = T.StructType([*(cut_pieces.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(pieces(docs, tokenizer, capacity), "pieces"), capacity)
