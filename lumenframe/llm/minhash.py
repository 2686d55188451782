"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, exact confirmation, components.

A document's set is its distinct five-word shingles; documents of one set are one class. Classes that agree in a band are
candidates. A bucket's pairs are looked at in blocks of bounded size, signature against signature, and are not emitted:

1. In passes, each over a part of the buckets: of the alike pairs not in one component yet, each class keeps two, with the
   first surely similar class of its block and with the one most alike. Confirmed on the full sets, these few links connect
   most of what belongs together.
2. In the buckets that hold several components by then, each class that is alike to one of another component goes on, with its
   set, to the same blocks. There its pairs are confirmed on the full sets and united as they are, so that a block gives fewer
   links than it has rows, however many pairs are alike.

Signatures that are compared have 1024 minima, a byte of each, and are made only of classes that share a bucket. Alike are those
that agree as often as they would at the threshold less 4.5 standard errors; surely similar, at two above it.

So every pair of a bucket is compared, ruled out by its signatures, or connected already. Buckets that hold very many classes
are split by a salt where rows meet what is known of their bucket. With 32 bands of 4 minima a pair of
similarity 0.75 shares no bucket with odds of 5e-6, and fails in signature with odds of 3e-6.

Defined results: null or empty texts, or without words, have no shingles and are linked with nothing; a null doc_id sorts after
ids below 2^62, is its own smallest only where none of these is reached, and component_id is null then; rows with one doc_id are
one document as regards links; repeated rows get the same result each; a very long text is a larger set, and blocks are cut by
the size of their sets too; an empty table gives none; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import cut, drop, mix, remembered, text_chunks, whole_text, words
from lumenframe.llm.components import components

BANDS, ROWS, WIDTH = 32, 4, 5
#: Minima of a signature.
HASHES = 1024
#: Classes of a block, and shingles in their sets: pairs within a bucket are looked at block by block.
BLOCK, SHINGLES = 2048, 1 << 21
#: Buckets of BLOCK classes and more are split by so many salts; as many of them as are told to all tasks.
SALTS, HOT = 64, 1000
#: Passes of the first part.
PASSES = 2
#: Documents without an id get one from here on, by their text.
NAMELESS = 2**62
_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_A, _B = _seeds[::2] | np.uint64(1), _seeds[1::2]
_P = np.array([pow(0xD1342543DE82EF95, k, 2**64) for k in range(WIDTH + 1)], dtype=np.uint64)


def node(docs: DataFrame) -> F.Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(whole_text(docs)).bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, as ascending 64-bit hashes."""
    hashed, first = words(data, offsets)
    n = len(hashed)
    runs = np.zeros(max(0, n - WIDTH + 1), dtype=np.uint64)
    for k in range(WIDTH if len(runs) else 0):
        runs += hashed[k : k + len(runs)] * _P[k]
    runs = mix(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        elif b > a:  # the whole sequence, apart from any five words
            out.append(mix((hashed[a:b] * _P[: b - a]).sum(keepdims=True) ^ _P[WIDTH:] * np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The high half of each of the first universal hashes' minimum over a set."""
    least, a, b = np.full(hashes, 2**64 - 1, dtype=np.uint64), _A[:hashes], _B[:hashes]
    step = (1 << 17) // hashes
    for k in range(0, len(shingles), step):
        np.minimum(least, (shingles[k : k + step, None] * a + b).min(0), out=least)
    return least >> np.uint64(32)


def sketches(docs: DataFrame) -> DataFrame:
    """node, named (it is a doc_id), n_shingles, h1, h2 (128 bits that stand for the set), bands."""
    schema = pa.schema([("node", pa.int64()), ("named", pa.bool_()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("minhash")
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                sets = shingle_sets(data, offsets)
                h1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                h2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                grouped = np.array([minima(s, BANDS * ROWS) if len(s) else np.zeros(BANDS * ROWS, np.uint64) for s in sets], dtype=np.uint64).reshape(j - i, BANDS, ROWS)
                bands = mix((grouped * _P[1 : ROWS + 1]).sum(2, dtype=np.uint64) ^ salt).view(np.int64)
                lists = [b if len(s) else [] for b, s in zip(bands, sets, strict=True)]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    return docs.select(node(docs).alias("node"), whole_text(docs).alias("text"), docs["doc_id"].isNotNull().alias("named")).mapInArrow(run, "node long, named boolean, n_shingles long, h1 long, h2 long, bands array<long>")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, shingles, signature) of the documents that are in some bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("minhash")
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                sets = shingle_sets(data, offsets)
                signatures = [(minima(s, HASHES) & np.uint64(255)).astype(np.uint8).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(signatures, pa.binary())], names=["node", "shingles", "signature"])

    return docs.select(node(docs).alias("node"), whole_text(docs).alias("text")).join(members.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node long, shingles binary, signature binary")


def _cells(members: DataFrame) -> DataFrame:
    """Members (band, node, component, blocks) by cells of bounded size: a bucket's blocks against each other, the larger number
    of the two first."""
    own = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return own.select("band", F.greatest("own", "other").alias("i"), F.least("own", "other").alias("j"), "own", "node", "component")


def _pairs(rows: pa.Table, label: np.ndarray, agree: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (numbers of rows) of a cell with different labels that agree in `agree` minima at least, and in how many. Labels may
    change between the pairs."""
    band, i, j, own = (rows[c].to_numpy() for c in ("band", "i", "j", "own"))
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(-1, HASHES)
    new = np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    cell, alive, step = np.cumsum(new), np.arange(len(band)), 0
    while True:
        step += 1
        alive = alive[alive + step < len(band)]
        alive = alive[cell[alive] == cell[alive + step]]
        if not len(alive):
            return
        x, y = alive, alive + step
        # two blocks of a bucket meet in one cell, the pairs within each in another
        good = (label[x] != label[y]) & ((own[x] != own[y]) | (i[x] == j[x]))
        x, y = x[good], y[good]
        for k in range(0, len(x), 4096):
            u, v = x[k : k + 4096], y[k : k + 4096]
            same = (signature[u] == signature[v]).sum(1)
            likely = same >= agree
            if likely.any():
                yield u[likely], v[likely], same[likely]


def _cell_by_cell(cells: DataFrame, of_cells, ddl: str) -> DataFrame:
    """What of_cells gives for tables of whole cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("minhash")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            key = np.stack([rows[c].to_numpy() for c in ("band", "i", "j")])
            changes = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            done = int(changes[-1]) + 1 if len(changes) else 0  # the last cell may go on
            if done:
                yield of_cells(rows.slice(0, done))
            held = rows.slice(done).combine_chunks().to_batches()
        if held:
            yield of_cells(pa.Table.from_batches(held))

    return cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node").mapInArrow(run, ddl)


def _best(cells: DataFrame, agree: int, sure: int) -> DataFrame:
    """(p, m): of each class of a cell the pairs with the most alike one before it, and with the first that agrees in `sure`
    minima, of those in different components that agree in `agree` at least."""

    def of_cells(rows: pa.Table) -> pa.RecordBatch:
        node, component = rows["node"].to_numpy(), rows["component"].to_numpy()
        found = list(_pairs(rows, component, agree))
        u, v, same = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        chosen = [np.empty(0, np.int64)]
        for order in (np.lexsort((u, same < sure, v)), np.lexsort((u, -same, v))) if len(u) else ():
            own = v[order]
            chosen.append(order[np.concatenate([[True], own[1:] != own[:-1]])])
        chosen = np.unique(np.concatenate(chosen))
        a, b = node[u[chosen]], node[v[chosen]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["p", "m"])

    return _cell_by_cell(cells, of_cells, "p long, m long")


def _with_partners(cells: DataFrame, agree: int) -> DataFrame:
    """The rows of cells that are alike to one of another component there."""
    names = ["band", "i", "j", "own", "node", "component"]

    def of_cells(rows: pa.Table) -> pa.RecordBatch:
        some = np.zeros(rows.num_rows, dtype=bool)
        for u, v, _ in _pairs(rows, rows["component"].to_numpy(), agree):
            some[u] = some[v] = True
        return rows.select(names).filter(pa.array(some)).combine_chunks().to_batches()[0] if some.any() else pa.RecordBatch.from_pylist([], rows.select(names).schema)

    return _cell_by_cell(cells, of_cells, "band long, i int, j int, own int, node long, component long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of ascending sets: 100 * |both| >= percent * |either|."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _united(cells: DataFrame, agree: int, percent: int) -> DataFrame:
    """Links (u, v) of cells that carry the sets: fewer than rows, as what is united already isn't looked at again."""

    def of_cells(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        _, first = np.unique(rows["component"].to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
        parent, label, links = list(range(len(node))), first.copy(), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for u, v, _ in _pairs(rows, label, agree):
            before = len(links)
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                a, b = root(int(first[x])), root(int(first[y]))
                if a != b and _similar(sets[x], sets[y], percent):
                    parent[b] = a
                    links.append((x, y))
            if len(links) > before:
                label[:] = np.array([root(x) for x in range(first.max() + 1)])[first]
        x, y = (np.array(z, dtype=np.int64) for z in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["u", "v"])

    return _cell_by_cell(cells, of_cells, "u long, v long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    p, m = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "pm")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("minhash")
        for batch in batches:
            keep = [_similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in both), percent) for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(m, "m").join(p, "p").select("p", "m", "sp", "sm").mapInArrow(run, "u long, v long")


def _labelled(rows: DataFrame, labels: DataFrame | None, key: str = "node", name: str = "component") -> DataFrame:
    """rows with the component of their node, which is its own until it is linked."""
    if labels is None:
        return rows.withColumn(name, F.col(key))
    found = labels.select(F.col("node").alias(key), F.col("component").alias(name))
    return rows.join(found, key, "left").withColumn(name, F.coalesce(name, key))


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Components (node, component) of the classes, without the smallest of each; None if no two are linked."""
    band = classes.select(F.explode("bands").alias("band"), "node", "n_shingles")
    shared = cut(band.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("band", "n"), "shared")
    hot = [x["band"] for x in shared.filter(F.col("n") >= BLOCK).orderBy(F.desc("n")).limit(HOT).select("band").collect()]  # others are small, or not many times larger than a task's share
    salt = F.when(F.col("band").isin(hot), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int") if hot else F.lit(0)
    salts = F.explode(F.when(F.col("band").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if hot else F.lit(0)
    members = cut(band.withColumn("salt", salt).join(shared.select("band", salts.alias("salt")), ["band", "salt"]), "members")
    drop(shared)
    if members.isEmpty():
        return None
    sets = cut(_sets(docs, members), "sets")
    signatures = sets.select("node", "signature")
    share = percent / 100
    error = (HASHES * share * (1 - share)) ** 0.5
    agree, sure = int(HASHES * share - 4.5 * error), int(HASHES * share + 2 * error)
    links, labels = None, None

    def live(some: DataFrame) -> DataFrame:
        """Cells of the buckets that hold several components."""
        known = _labelled(some, labels)
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / SHINGLES)).cast("int")
        several = known.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), blocks.alias("blocks")).filter("a < b")
        return _cells(known.join(several.select("band", "blocks", salts.alias("salt")), ["band", "salt"]))

    def link(new: DataFrame) -> None:
        nonlocal links, labels
        new = cut(new, "linked")
        if not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            labels = components(links)

    for k in range(PASSES):
        link(_linked(_best(live(members.filter(F.pmod("band", F.lit(PASSES)) == k)).join(signatures, "node"), agree, sure).distinct(), sets, percent))
    link(_united(_with_partners(live(members).join(signatures, "node"), agree).join(sets, "node"), agree, percent))
    drop(sets)
    drop(members)
    return labels


def annotate(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and the keys node and component."""
    sketch = cut(sketches(docs), "sketches")
    classes = cut(sketch.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("node").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")), "classes")
    found = _labelled(classes.select("h1", "h2", "node"), _links(docs, classes, percent)).select("h1", "h2", "component")
    joined = sketch.select("node", "named", "n_shingles", "h1", "h2").join(found, ["h1", "h2"], "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("node")))
    of_id = F.col("component") < NAMELESS
    large = sketch.filter(F.col("named") & (F.col("node") >= NAMELESS)).select(F.col("node").alias("component"), F.lit(True).alias("large")).distinct()
    if not large.isEmpty():  # ids in the range of those that stand for null
        joined = joined.join(large, "component", "left")
        of_id = of_id | F.col("large").isNotNull()
    return joined.select(F.when(F.col("named"), F.col("node")).alias("doc_id"), "n_shingles", F.when(of_id, F.col("component")).alias("component_id"), (F.col("node") == F.col("component")).alias("kept"), "node", "component")


def dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that are kept, one document of each component, with all their columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    named = plain.select("*", plain[names[docs.columns.index("doc_id")]].alias("doc_id"), plain[names[docs.columns.index("text")]].alias("text"))
    gone = annotate(named.select("doc_id", "text"), percent).filter("NOT kept").select(F.col("node").alias("__node")).distinct()
    return named.withColumn("__node", node(named)).join(gone, "__node", "left_anti").select(*names).toDF(*docs.columns)
