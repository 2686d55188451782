"""Language-model scoring with a probabilistic suffix tree.

The tree is one of variable-length contexts over the symbols of a text: its bytes, A-Z lower-cased, words joined by one blank,
then an end symbol; before the text stand start symbols. So it gives a probability to every sequence of words and end. A
context of up to `depth` symbols is a state if it occurs at least `support` times, whatever the size of the corpus, and its
next symbols diverge from those of the context one shorter: count times Kullback-Leibler divergence over half the number of
next symbols times the log of its count. Suffixes of states are states.
Next symbols are smoothed towards the shorter context (Witten-Bell): p(x|s) = (c(sx) + t p(x|s')) / (c(s) + t), t being the
number of different symbols seen after s, down to the uniform distribution. A symbol is scored by the longest suffix of what
precedes it that is a state.

The tree grows with the corpus and is never held in one place: its paths are tables, probabilities go from each depth to the
next by joins, for every path that occurs in the texts to score. Of the results, frequent paths (PATHS of all symbols and more,
so a bounded number) are looked up in a broadcast table, the symbols of other paths are joined.

Beside it stands the unigram score of words that the model is compared with. Words are counted by a 64-bit hash; frequent ones
(1/1,000,000 of all and more, so at most a million) are looked up in a broadcast table, others are joined.

Defined results: a null or empty text is its end token alone; a null doc_id is never held out; repeated rows are scored and
learned from each; without training documents all symbols are as likely, and base scores are 0; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import counted, cut, distinct, drop, lower_az, mix, remembered, text_chunks, whole_text, words

START, END = 0xFE, 0xFF  # no byte of UTF-8
FREQUENT = 1e-6
PATHS = 5e-7
#: Distinct keys a task holds before it sends its counts on.
HELD = 4_000_000


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row as words joined by one blank, each text ended by END; where each begins."""
    lengths = np.diff(offsets)
    out = np.full(len(data) + len(lengths), END, dtype=np.uint8)
    low = lower_az(data)
    low[(low >= 9) & (low <= 13)] = 32
    out[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = low
    blank = out == 32
    after = np.concatenate([[True], blank[:-1] | (out[:-1] == END)])
    out = out[~(blank & after)]
    out = out[~((out == 32) & np.append(out[1:] == END, False))]
    return out, np.concatenate([[0], np.flatnonzero(out == END) + 1])


def paths(out: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol in the lowest byte, the `depth` symbols before it above, the nearest lowest."""
    texts = len(begins) - 1
    padded = np.full(len(out) + depth * texts + 7, START, dtype=np.uint8)
    at = np.arange(len(out)) + depth * (np.repeat(np.arange(texts), np.diff(begins)) + 1) + 7
    padded[at] = out
    code = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), 0, (1,))[at - 7].astype(np.uint64)
    return code & np.uint64((1 << (8 * (depth + 1))) - 1)


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _count(docs: DataFrame, of_chunk) -> DataFrame:
    """(key, n) over all texts: each task counts the keys of_chunk(data, offsets) gives, then they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_lm")
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, n = counted(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch):
                k, n = distinct(of_chunk(data, offsets))
                keys.append(k), counts.append(n)
                held += len(k)
                if held > HELD:
                    k, n = counted(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD // 2:
                        yield out()
                        keys, counts, held = [], [], 0
        yield out()

    return docs.select(whole_text(docs).alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def log_paths(training: DataFrame, others: DataFrame, depth: int, least: float, support: int) -> tuple[DataFrame, int]:
    """(key, log_p, m): log10 p of the last symbol of each path of either table, learned from training, and how often the path
    occurs in both; and the number of symbols of both."""
    keys = lambda docs: _count(docs, lambda data, offsets: paths(*symbols(data, offsets), depth))
    grams = keys(training).withColumn("m", F.col("n")).unionAll(keys(others).select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("m")))
    grams = cut(grams.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")
    sums = grams.agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    total = sums["n"] or 0
    lowest = lambda symbols: F.expr(f"shiftleft(1L, 8 * ({symbols})) - 1L")
    every = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    every = cut(every.select("k", F.col("key").bitwiseAND(lowest("k + 1")).alias("path"), "n", "m").groupBy("k", "path").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "paths")
    seen = every.filter("n > 0").select("k", "path", F.shiftright("path", 8).alias("context"), "n")
    states = seen.groupBy("k", "context").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("t")).filter((F.col("k") == 0) | (F.col("s") >= max(support, least * total)))
    states = cut(states, "states")
    kept = cut(seen.join(states, ["k", "context"]), "kept")
    # the same symbol after the context one shorter, which is at least as frequent and so kept too
    shorter = kept.select((F.col("k") + 1).alias("k"), F.col("path").alias("suffix"), F.col("n").alias("n1"), F.col("s").alias("s1"))
    gain = kept.filter("k > 0").withColumn("suffix", F.col("path").bitwiseAND(lowest("k"))).join(shorter, ["k", "suffix"])
    gain = gain.groupBy("k", "context", "s", "t").agg(F.sum(F.col("n") * F.log((F.col("n") / F.col("s")) / (F.col("n1") / F.col("s1")))).alias("gain")).filter(F.col("gain") > 0.5 * F.col("t") * F.log("s"))
    chosen = gain.select(F.explode(F.sequence(F.lit(0), "k")).alias("k"), "context").select("k", F.col("context").bitwiseAND(lowest("k")).alias("context")).distinct()
    chosen = cut(states.join(chosen, ["k", "context"], "left_semi").filter("k > 0").unionAll(states.filter("k = 0")), "chosen")
    p = None
    for k in range(depth + 1):
        own = every.filter(F.col("k") == k).select("path", F.shiftright("path", 8).alias("context"), "n", "m")
        own = own.join(chosen.filter(F.col("k") == k).select("context", "s", "t"), "context", "left")
        own = own.withColumn("lower", F.lit(1 / 256)) if p is None else own.withColumn("suffix", F.col("path").bitwiseAND(lowest(str(k)))).join(p, "suffix")
        p = own.select(F.col("path").alias("suffix"), F.coalesce((F.col("n") + F.col("t") * F.col("lower")) / (F.col("s") + F.col("t")), "lower").alias("lower"), *(["m"] if k == depth else []))
    logs = cut(p.select(F.col("suffix").alias("key"), F.log10("lower").alias("log_p"), "m"), "log_paths")
    for table in (grams, every, states, kept, chosen):
        drop(table)
    return logs, sums["m"] or 0


def score(docs: DataFrame, held_out: F.Column, depth: int = 5, least: float = 0.0, support: int = 2) -> DataFrame:
    """One row per row of docs, learned from those that held_out is not true of: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score. A context needs `support` occurrences, and the share `least` of all symbols if given."""
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), whole_text(docs).alias("text"))
    training = given.filter(~F.col("held_out"))
    logs, symbols_met = log_paths(training, given.filter("held_out"), depth, least, support)
    count = cut(_count(training, lambda data, offsets: words(data, offsets)[0]), "words")
    texts = training.count()
    sums = count.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, different = (sums["n"] or 0) + texts, sums["v"] + (texts > 0)
    frequent = count.filter(F.col("n") >= max(1.0, FREQUENT * total)).toArrow()  # at most 1 / FREQUENT rows
    by = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(by)
    below = total + 0.1 * (different + 1)
    hot = logs.filter(F.col("m") >= max(1.0, PATHS * symbols_met)).select("key", "log_p").toArrow()  # at most 1 / PATHS rows
    hot_keys = hot["key"].to_numpy().view(np.uint64)
    hot_order = np.argsort(hot_keys)
    shared = docs.sparkSession.sparkContext.broadcast((hot_keys[hot_order], hot["log_p"].to_numpy()[hot_order], by[order], np.log10((frequent["n"].to_numpy()[order] + 0.1) / below)))
    end, end_known = float(np.log10((texts + 0.1) / below)), int(texts > 0)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("paths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("suffix_lm")
        hot_keys, log_p, keys, logs = shared.value
        row = TaskContext.get().partitionId() << 36
        tree, table = Slots(hot_keys, 22), Slots(keys)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                out, begins = symbols(data, offsets)
                codes = paths(out, begins, depth)
                place, met = tree(codes)
                scores = np.add.reduceat(np.where(met, log_p[place] if len(log_p) else 0.0, 0.0), begins[:-1])
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~met)])[begins].astype(np.int32)), pa.array(codes[~met].view(np.int64)))
                hashed, first = words(data, offsets)
                at, known = table(hashed)
                base = np.concatenate([[0.0], np.cumsum(np.where(known, logs[at] if len(logs) else 0.0, 0.0))])
                sums = np.concatenate([[0], np.cumsum(known)])
                rare, lists = hashed[~known].view(np.int64), first - sums[first]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + j - i)), own.column(0), own.column(1), pa.array(np.diff(first) + 1), pa.array(np.diff(sums[first]) + end_known), pa.array(np.diff(base[first]) + end), pa.array(scores), pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.array(rare)), others], schema=schema
                )
                row += j - i

    scored = cut(given.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, paths array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).join(count, "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(float(below)))).alias("more"), F.count("n").alias("known"))
    # no key of these has a share over PATHS of the symbols, so none is hot
    others = scored.select("row", F.explode("paths").alias("key")).join(logs.select("key", "log_p"), "key").groupBy("row").agg(F.sum("log_p").alias("rest"))
    joined = scored.drop("rare", "paths").join(rare, "row", "left").join(others, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


class Slots:
    """Where keys stand in an ascending array, by a table of hashed slots before the search."""

    def __init__(self, keys: np.ndarray, bits: int = 21):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, dtype=np.int64)
        self.slot[(mix(keys) >> self.shift).astype(np.int64)] = np.arange(len(keys))
        at = self.slot[(mix(keys) >> self.shift).astype(np.int64)] if len(keys) else np.empty(0, np.int64)
        self.crowded = np.zeros(1 << bits, dtype=bool)  # slots that more than one key falls into
        self.crowded[(mix(keys[at != np.arange(len(keys))]) >> self.shift).astype(np.int64)] = True

    def __call__(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        where = (mix(asked) >> self.shift).astype(np.int64)
        at = self.slot[where]
        found = self.keys[at] == asked
        found &= at >= 0
        again = np.flatnonzero(~found & self.crowded[where])
        if len(again):
            at[again], found[again] = _lookup(self.keys, asked[again])
        return np.maximum(at, 0), found
