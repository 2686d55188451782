"""Removal of repeated passages by merging Burrows-Wheeler transforms.

Every byte covered by a string of `width` bytes that also starts earlier (in a document of smaller id, or earlier in its own)
is removed; texts are UTF-8 bytes and strings never cross documents.

1. Each text is cut into contexts: runs of string starts whose strings have the same least 16-byte gram hash. Equal strings
   have the same least gram, so they meet under one anchor. Contexts that are equal under an anchor are put together before and
   after the shuffle: all but the first are repeats whole.
2. Of an anchor that occurs several times, or whose one context may hold a string twice, the first context of each kind gets
   its bytes and is dealt by anchor. Under an anchor of very many different contexts (a line that stands on very many pages) the
   strings are too many of one kind for a task: there each string's least place is a grouped minimum of its 128-bit hash, made
   before and after the shuffle, and met by its other places over salts. So no task holds such an anchor or string alone.
3. A task takes contexts in batches of bounded size, ordered by where they stand. A batch is dealt into shards; each shard's
   rotations are sorted and give its Burrows-Wheeler transform. The transforms are merged by interleave refinement: an
   interleave says which shard the next row comes from; a pass sorts it stably by the symbols before its rows, which orders it by
   one symbol more (here, a symbol is a block of 32 bytes, the first one of what is left of `width`). No suffix is compared with
   another again. Where neighbours still agree after `width` bytes their common prefix is that long: those are the repeated intervals. Of each, the
   least position is the first; the others are repeats.

Defined results: a null text is empty; a null doc_id comes last; rows of one doc_id are separate documents, ordered by text;
texts shorter than `width` lose nothing; a very long text is cut into contexts like any other; an empty table gives none; further
columns don't matter, whatever their names. More than 2^20 rows of one doc_id (or without one) raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, keyed, mix, prefix_hash, real_id, remembered, span_hash, text_chunks

GRAM = 16
#: Starts of a context at most, contexts of an anchor beyond which it is dealt by string, bytes of a batch and of a shard, and
#: of texts looked at in one go.
RUN, MANY, BATCH, SHARD, TEXTS = 512, 5_000, 1 << 19, 1 << 17, 1 << 20
#: Salts over which the places of a very frequent string are dealt, and as many of such strings as are told to all tasks.
SALTS, HOT = 16, 10_000
#: Bytes of a symbol of the transforms.
SYMBOL = 32


def contexts(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of texts in a row: each context's text, first start in it, number of starts, anchor, hash, and whether it may hold a
    string twice.

    Two equal strings of a context, p bytes apart, hold the anchor's gram in the same places; the last one in the first string
    is followed by one p bytes on, which enters at the end of a string after the first. So only where a string that is not the
    first ends in the anchor's gram can there be two.
    """
    n, none = len(data), np.empty(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    eight = np.ndarray((n - 7,), "<u8", data.tobytes(), 0, (1,)).astype(np.uint64)
    grams = mix(eight[: n - GRAM + 1] * np.uint64(0x9FB21C651E98DF25) + mix(eight[GRAM - 8 :]))
    left, span, single = width - GRAM + 1, 1, grams
    while span * 2 <= left:
        grams = np.minimum(grams[:-span], grams[span:])
        span *= 2
    if span < left:
        grams = np.minimum(grams[: len(grams) - (left - span)], grams[left - span :])
    whole = np.zeros(len(grams) + 1, dtype=np.int8)  # starts whose string ends within the text
    lengths = np.diff(offsets)
    long_ = lengths >= width
    np.add.at(whole, offsets[:-1][long_], 1)
    np.add.at(whole, offsets[1:][long_] - width + 1, -1)
    whole = np.cumsum(whole[:-1]) > 0
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | ~whole[:-1]]) & whole
    twice = np.concatenate([[0], np.cumsum((single[left - 1 :] == grams) & whole & ~fresh)])
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(grams))
    stops = np.flatnonzero(whole & ~np.append(whole[1:], False)) + 1
    ends = np.minimum(ends, stops[np.searchsorted(stops, starts, side="right")]) if len(starts) else ends[:0]
    parts = -(-(ends - starts) // RUN)
    if len(parts) and parts.max() > 1:
        again = np.repeat(np.arange(len(starts)), parts)
        number = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = starts[again] + number * RUN, np.minimum(ends[again], starts[again] + (number + 1) * RUN)
    text = np.searchsorted(offsets, starts, side="right") - 1
    hashes = mix(span_hash(prefix_hash(data), starts, ends + width - 1))
    return text, starts - offsets[text], ends - starts, grams[starts], hashes, twice[ends] > twice[starts]


def _joined(document: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents (numbers), overlapping or touching ones put together; sorted."""
    order = np.lexsort((start, document))
    document, start, end = document[order], start[order], end[order]
    if not len(start):
        return document, start, end
    # ends so far within a document: documents are set apart by more than any text's length
    apart = document * np.int64(1 << 40)
    reach = np.maximum.accumulate(end + apart)
    new = np.concatenate([[True], start[1:] + apart[1:] > reach[:-1] + gap])
    first = np.flatnonzero(new)
    return document[first], start[first], np.maximum.reduceat(end, first)


_PLACES = "a long, c long, _d long, p long"


def _pack(copy: np.ndarray, start: np.ndarray, many: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Copy number, start, whether a string may be there twice, and number of starts (RUN at most; 0: a removed span, whose end
    is in c) in one number that sorts so."""
    return (copy << 43) | (start << 11) | (twice.astype(np.int64) << 10) | many


def _anchored(docs: DataFrame, width: int) -> DataFrame:
    """Contexts by anchor; those equal to an earlier one of the same chunk as removed spans, under any anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        for batch in batches:
            ids, copies = (batch.column(k).to_numpy() for k in (0, 1))
            for i, j, data, offsets in text_chunks(batch, most=TEXTS):
                text, start, many, anchor, hashed, twice = contexts(data, offsets, width)
                if not len(text):
                    continue
                document, copy = ids[i:j][text], copies[i:j][text].astype(np.int64)
                place = np.empty(len(text), dtype=np.int64)
                place[np.lexsort((start, copy, document))] = np.arange(len(text))
                kind = mix(anchor ^ mix(hashed))
                order = np.lexsort((place, kind))
                later = np.concatenate([[False], kind[order][1:] == kind[order][:-1]])
                repeat, keep = order[later], order[~later]
                t, s, e = _joined(text[repeat], start[repeat], start[repeat] + many[repeat] + width - 1)
                rows = (
                    np.concatenate([anchor[keep].view(np.int64), mix((ids[i:j][t] + s).astype(np.uint64)).view(np.int64)]),
                    np.concatenate([hashed[keep].view(np.int64), e]),
                    np.concatenate([document[keep], ids[i:j][t]]),
                    np.concatenate([_pack(copy[keep], start[keep], many[keep], twice[keep]), _pack(copies[i:j][t].astype(np.int64), s, np.zeros_like(s), np.zeros(len(s), bool))]),
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["a", "c", "_d", "p"])

    return docs.mapInArrow(run, _PLACES)


def _sifted(anchored: DataFrame, width: int) -> DataFrame:
    """Of contexts dealt and sorted by anchor: removed spans (a null), and the first of each kind under repeated anchors."""
    schema = pa.schema([("a", pa.int64()), ("_d", pa.int64()), ("_c", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        held: list[np.ndarray] | None = None  # the last row, which the next one decides on
        before = (False, False)  # whether the row before that had the same anchor, and the same context

        def sift(x: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal held, before
            a, c, d, p = x
            many = p & 1023
            span = many == 0
            same = (a[1:] == a[:-1]) & ~span[1:] & ~span[:-1]
            same_a = np.concatenate([[before[0]], same])
            same_c = np.concatenate([[before[1]], same & (c[1:] == c[:-1])])
            first = ~same_c & (same_a | np.append(same, False) | (p & 1024 > 0)) & ~span
            out = np.arange(len(a)) if last else np.arange(len(a) - 1)
            held, before = [y[-1:] for y in x], (bool(same_a[-1]), bool(same_c[-1]))
            out = out[(first | same_c | span)[out]]
            start = (p[out] >> 11) & 0xFFFFFFFF
            end = np.where(span[out], c[out], start + many[out] + width - 1)
            return pa.RecordBatch.from_arrays([pa.array(a[out], mask=~first[out]), pa.array(d[out]), pa.array((p[out] >> 43).astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=schema)

        for batch in batches:
            if batch.num_rows:
                x = [batch.column(k).to_numpy() for k in range(4)]
                yield sift(x if held is None else [np.concatenate(y) for y in zip(held, x, strict=True)], False)
        if held is not None:
            yield sift(held, True)

    return anchored.repartition("a").sortWithinPartitions("a", "c", "_d", "p").mapInArrow(run, "a long, _d long, _c int, s int, e int")


def _wanted(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(_d, _c, text, of: the contexts in it)."""
    of = contexts.groupBy("_d", "_c").agg(F.collect_list(F.struct("a", "s", "e")).alias("of"))
    return docs.join(of, ["_d", "_c"]).select("_d", "_c", "text", "of")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Scalar, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: document, copy, text, and the anchors, starts and ends of its contexts."""
    lists = batch.column(3)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    a, s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    ends = ends - ends[0]
    for k, (d, c, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
        own = slice(ends[k], ends[k + 1])
        yield d, c, text, a[own], s[own], e[own]


def _with_bytes(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(a, _d, _c, s, bytes) of contexts."""
    schema = pa.schema([("a", pa.int64()), ("_d", pa.int64()), ("_c", pa.int32()), ("s", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for d, c, text, anchors, starts, ends in _each(batch):
                data = text.as_buffer().to_pybytes()
                for anchor, start, end in zip(anchors.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    for out, x in zip(rows, (anchor, d, c, start, data[start:end]), strict=True):
                        out.append(x)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)
                    rows = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return _wanted(docs, contexts).mapInArrow(run, "a long, _d long, _c int, s int, bytes binary")


def _frequent(docs: DataFrame, contexts: DataFrame, width: int) -> DataFrame:
    """Removed spans (_d, _c, s, e) of contexts whose strings may stand very often: all places of a string but the least."""
    schema = pa.schema([("h", pa.binary()), ("_d", pa.int64()), ("_c", pa.int32()), ("s", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        for batch in batches:
            for d, c, text, _, starts, ends in _each(batch):
                data = text.as_buffer().to_pybytes()
                places = np.concatenate([np.arange(s, e - width + 1) for s, e in zip(starts, ends, strict=True)]).astype(np.int32)
                hashed = [hashlib.blake2b(data[k : k + width], digest_size=16).digest() for k in places.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(hashed, pa.binary()), pa.array([d] * len(places), pa.int64()), pa.array([c] * len(places), pa.int32()), pa.array(places)], schema=schema)

    place = F.struct("_d", "_c", "s")
    # not written: in one query with the other contexts, texts are shuffled once for all
    places = _wanted(docs, contexts).mapInArrow(run, "h binary, _d long, _c int, s int")
    least = places.groupBy("h").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the most frequent strings, HOT of them at most, are dealt over salts; the others' places are few enough for a task
    hot = F.broadcast(least.filter(F.col("n") > MANY).orderBy(F.desc("n")).limit(HOT).select("h", F.lit(True).alias("hot")))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("_d", "_c", "s"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    dealt = places.join(hot, "h", "left").withColumn("salt", salt).drop("hot")
    others = dealt.join(least.join(hot, "h", "left").select("h", "least", salts.alias("salt")), ["h", "salt"]).filter(place != F.col("least"))
    return others.select("_d", "_c", "s", (F.col("s") + width).cast("int").alias("e"))


def _fours(data: np.ndarray) -> np.ndarray:
    """At each position the next four bytes as a number that sorts as they do, going round at the end."""
    return np.ndarray((len(data),), ">u4", np.concatenate([data, np.resize(data, 4)]).tobytes(), 0, (1,)).astype(np.uint64)


def _ranked(high: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of ranks (or of numbers below 2^32), and each one's rank among the different ones."""
    n, bits = len(high), np.uint64(len(high).bit_length())
    wide = np.uint64(int(max(high.max(), low.max())).bit_length()) if low is not None and n else np.uint64(0)
    if low is None or 2 * int(wide) + int(bits) <= 64:  # sorted with their places, which is faster than sorting places
        key = np.sort(((high if low is None else (high << wide) | low) << bits) | np.arange(n, dtype=np.uint64))
        order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key >>= bits
    else:
        key = (high << np.uint64(32)) | low
        order = np.argsort(key)
        key = key[order]
    rank = np.empty(n, dtype=np.uint64)
    new = np.zeros(n, dtype=np.uint64)
    new[1:] = key[1:] != key[:-1]
    rank[order] = np.cumsum(new, dtype=np.uint64)
    return order, rank


def rotations(rank: np.ndarray, seen: int) -> np.ndarray:
    """Where the rotations of a shard start, in their order, from the ranks of their first `seen` bytes: prefixes of twice as
    many bytes until all differ."""
    n = len(rank)
    while True:
        order, rank = _ranked(rank, np.roll(rank, -(seen % n)))
        seen *= 2
        if seen >= n or int(rank[order[-1]]) == n - 1:
            return order


def merge(shards: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in all shards, one after another) in the order of the `width` bytes from there on (going round within the
    shard), and whether each differs in them from the one before it.
    """
    sizes = [len(x) for x in shards]
    begins = np.cumsum([0, *sizes[:-1]])
    slices = [slice(b, b + n) for b, n in zip(begins, sizes, strict=True)]
    ahead = lambda x, k: np.concatenate([np.roll(x[s], -(k % (s.stop - s.start))) for s in slices])
    rank, size = {4: _ranked(np.concatenate([_fours(x) for x in shards]))[1]}, 4
    while size < SYMBOL:
        rank[2 * size] = _ranked(rank[size], ahead(rank[size], size))[1]
        size *= 2
    first = (width - 4) % SYMBOL + 4  # of 4 to 35 bytes, then whole symbols
    size = max(k for k in rank if k <= first)
    opening = rank[size] if size == first else _ranked(rank[size], ahead(rank[size], first - size))[1]
    orders = [rotations(rank[SYMBOL][s], SYMBOL) for s in slices]
    # the transforms: the symbol before each rotation of a shard, in the shard's order
    before = lambda x, k: np.concatenate([x[s][(o - k) % len(o)] for s, o in zip(slices, orders, strict=True)])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    total = len(interleave)
    row, block = np.arange(total, dtype=np.uint64), np.zeros(total, dtype=np.int32)
    differs, symbols = np.zeros(total, dtype=bool), np.empty(total, dtype=np.uint64)
    transforms = [before(opening, first), *[before(rank[SYMBOL], SYMBOL)] * ((width - first) // SYMBOL)]
    for transform in transforms:
        symbols[np.argsort(interleave, kind="stable")] = transform
        key = np.sort((symbols << np.uint64(32)) | row)
        after = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key >>= np.uint64(32)
        interleave, block = interleave[after], block[after]
        differs[0] = True
        np.not_equal(key[1:], key[:-1], out=differs[1:])
        differs[1:] |= block[1:] != block[:-1]
        block = np.cumsum(differs, dtype=np.int32)
    position = np.empty(total, dtype=np.int64)
    position[np.argsort(interleave, kind="stable")] = np.concatenate([o + b for o, b in zip(orders, begins, strict=True)])
    return position, differs


def repeats(texts: list[bytes], width: int) -> np.ndarray:
    """Of contexts in the order of where they stand: numbers of the bytes, counted through all, at which a string starts that
    also starts earlier."""
    # mixed, as contexts in order go on alike after one another where documents are alike, and long prefixes take more passes
    mixed = np.random.default_rng(0).permutation(len(texts))
    lengths = np.array([len(x) for x in texts])
    shift = (np.cumsum(lengths) - lengths)[mixed]
    lengths = lengths[mixed]
    data, ends = np.frombuffer(b"".join(texts[k] for k in mixed.tolist()), np.uint8), np.cumsum(lengths)
    shift = np.repeat(shift - (ends - lengths), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(data)) >= width  # the string lies in one context
    shards, first = [], 0
    for end in ends.tolist():
        if end - first >= SHARD or end == len(data):
            shards.append(data[first:end])
            first = end
    position, differs = merge(shards, width)
    interval = np.flatnonzero(differs)
    own = np.where(room[position], position + shift[position], len(data))
    least = np.minimum.reduceat(own, interval)
    return np.sort(own[(own < len(data)) & (own != least[np.cumsum(differs) - 1])])


def _merged(with_bytes: DataFrame, width: int) -> DataFrame:
    """Removed spans (_d, _c, s, e) among contexts."""
    schema = pa.schema([("_d", pa.int64()), ("_c", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        parts, held = [], 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            d, c, s = (rows[k].to_numpy() for k in ("_d", "_c", "s"))
            order = np.lexsort((s, c, d))
            texts = rows["bytes"].take(pa.array(order)).to_pylist()
            begins = np.cumsum([0, *map(len, texts[:-1])])
            found = repeats(texts, width)
            context = np.searchsorted(begins, found, side="right") - 1
            k, start, end = _joined(context, found - begins[context], found - begins[context] + width)
            own = order[k]
            return pa.RecordBatch.from_arrays([pa.array(d[own]), pa.array(c[own]), pa.array((s[own] + start).astype(np.int32)), pa.array((s[own] + end).astype(np.int32))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            held += batch.column(4).get_total_buffer_size()
            if held < BATCH:
                continue
            rows = pa.Table.from_batches(parts)
            anchors = rows["a"].to_numpy()
            changes = np.flatnonzero(anchors[1:] != anchors[:-1])
            if len(changes):  # whole anchors only
                done = int(changes[-1]) + 1
                lengths = np.cumsum(pa.compute.binary_length(rows["bytes"]).to_numpy()[:done])
                first = 0
                for cut_at in [*np.searchsorted(lengths, np.arange(BATCH, lengths[-1], BATCH)).tolist(), done]:
                    stop = done if cut_at >= done else int(changes[min(np.searchsorted(changes, cut_at), len(changes) - 1)]) + 1
                    if stop > first:
                        yield out(rows.slice(first, stop - first))
                        first = stop
                left = rows.slice(done)
                parts = left.combine_chunks().to_batches()
                held = sum(x.column(4).get_total_buffer_size() for x in parts) if left.num_rows * 200 > BATCH else 0
        if parts:
            yield out(pa.Table.from_batches(parts))

    return with_bytes.repartition("a").sortWithinPartitions("a").mapInArrow(run, "_d long, _c int, s int, e int")


def spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """Removed spans (_d, _c, s, e), which may overlap, of rows (_d, _c, text) as keyed() gives them."""
    if width < GRAM:
        raise ValueError("width is to be a gram at least")
    found = cut(_sifted(_anchored(docs, width), width), "sifted")
    firsts = found.filter("a IS NOT NULL")
    crowded = cut(firsts.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("a"), "crowded")
    removed = found.filter("a IS NULL").drop("a")
    if not crowded.isEmpty():
        removed = removed.unionAll(_frequent(docs, firsts.join(crowded, "a", "left_semi"), width))
        firsts = firsts.join(crowded, "a", "left_anti")
    return removed.unionAll(_merged(_with_bytes(docs, firsts), width))


def _per_document(docs: DataFrame, removed: DataFrame) -> DataFrame:
    listed = removed.groupBy("_d", "_c").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return docs.join(listed, ["_d", "_c"], "left")


def _left(text: bytes, of: list | None) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many spans."""
    if not of:
        return text, 0, 0
    start, end = (np.array(x, dtype=np.int64) for x in zip(*((y["s"], y["e"]) for y in of), strict=True))
    _, start, end = _joined(np.zeros_like(start), start, end)
    kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
    return kept, len(text) - len(kept), len(start)


def annotate(docs: DataFrame, width: int = 100) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        for batch in batches:
            out = []
            for text, of in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, gone, n = _left(data, of.as_py())
                out.append((len(data), gone, n, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["_d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = _per_document(rows, spans(rows, width)).select("_d", "text", "spans").mapInArrow(run, "_d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def strip(docs: DataFrame, width: int = 100) -> DataFrame:
    """docs, with what is left of each text; of a character that was cut, the rest goes too. Rows with nothing left stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names)
    source = plain.select("*", plain[names[docs.columns.index("doc_id")]].alias("doc_id"), plain[names[at]].alias("text"))
    rows = keyed(source.select("doc_id", "text"))
    if source.groupBy("doc_id").count().filter("count > 1").isEmpty():
        wide = source.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_c": F.lit(0)})
    else:
        from pyspark.sql import Window

        order = Window.partitionBy("_d").orderBy(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
        wide = source.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))).withColumn("_c", (F.row_number().over(order) - 1).cast("int"))
    joined = _per_document(wide, spans(rows, width)).select(*names, "spans")
    schema = joined.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_dedup")
        for batch in batches:
            texts = []
            for text, of in zip(batch.column(at), batch.column(len(names)), strict=True):
                kept = _left(text.as_buffer().to_pybytes(), of.as_py())[0] if text.is_valid else None
                texts.append(None if kept is None else kept.decode("utf-8", "ignore"))
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema).toDF(*docs.columns)
