"""Language identification as a mixture of languages.

Each language has a distribution of byte trigrams (folded into 2^16 cells), counted over all training documents. A document is
a mixture: expectation-maximisation finds the proportions of languages that make its trigrams likeliest, and the set of
languages is chosen by penalised likelihood - from all languages, the one of least share is dropped as long as the likelihood
lost is below the penalty of a language. As trigrams overlap, a third of their number counts as observations.

Defined results: `und` with score 0 for a null text, one without letters (signs and number forms such as a half are none), or
where nothing was learned; ties go to the language first in the alphabet; training ignores a null lang and a null text; every
other language of the training documents is learned, whatever its share; whole texts are used for training and prediction,
however long. A null doc_id and repeated rows are predicted like any other; an empty table gives none; further columns don't matter.

The model holds 12 bytes for each pair of a cell and a language that occurs. A document's likelihoods are a full matrix where that
is small (FULL), else only what occurs and one value a language for the rest, which gives the same proportions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import counted, distinct, lower_az, remembered, text_chunks

CELLS = 1 << 16
#: Cells of a document times languages up to which its likelihoods are a full matrix.
FULL = 1 << 20
#: Pairs of language and cell a task holds before it sends its counts on.
HELD = 2_000_000
#: Letters, and a few signs and number forms that are none.
_LIKELY = re.compile(r"[^\W\d_]")


def _cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of the trigram that starts at each byte but the last two, and whether it counts (not all blank).

    ASCII other than letters is taken as blank.
    """
    low = lower_az(data)
    low = np.where((low < 97) | (low > 122) & (low < 128), np.uint8(32), low).astype(np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    cell = (code * np.uint32(2654435769)) >> np.uint32(16)
    return cell.astype(np.int64), code != 0x202020


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LIKELY.finditer(text))


def _padded(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    blank = np.array([32], dtype=np.uint8)
    return [np.concatenate([blank, data[a:b], blank]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@dataclass
class Sparse:
    """Likelihoods of observations by languages: `rest` of each language, and what pairs (row, column) have beyond it."""

    rest: np.ndarray
    row: np.ndarray
    column: np.ndarray
    more: np.ndarray
    rows: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.rows, len(self.rest)

    def mixed(self, share: np.ndarray) -> np.ndarray:
        return self.rest @ share + np.bincount(self.row, self.more * share[self.column], self.rows)

    def summed(self, weight: np.ndarray) -> np.ndarray:
        return self.rest * weight.sum() + np.bincount(self.column, self.more * weight[self.row], len(self.rest))

    def of(self, columns: list[int]) -> Sparse | np.ndarray:
        place = np.full(len(self.rest), -1)
        place[columns] = np.arange(len(columns))
        own = place[self.column] >= 0
        fewer = Sparse(self.rest[columns], self.row[own], place[self.column[own]], self.more[own], self.rows)
        return fewer.full() if self.rows * len(columns) <= FULL else fewer

    def full(self) -> np.ndarray:
        p = np.tile(self.rest, (self.rows, 1))
        p[self.row, self.column] += self.more
        return p


@dataclass
class Model:
    """By cell, from `begins` on: the languages that have it and their likelihoods beyond the language's `rest`."""

    languages: list[str]
    rest: np.ndarray
    begins: np.ndarray
    column: np.ndarray
    more: np.ndarray

    def of(self, cells: np.ndarray) -> Sparse | np.ndarray:
        first, n = self.begins[cells], self.begins[cells + 1] - self.begins[cells]
        row = np.repeat(np.arange(len(cells)), n)
        at = np.arange(len(row)) + np.repeat(first - np.cumsum(n) + n, n)
        p = Sparse(self.rest, row, self.column[at], self.more[at], len(cells))
        return p.full() if len(cells) * len(self.rest) <= FULL else p


def fit(docs: DataFrame) -> Model:
    """From the text and lang of all of docs."""
    given = docs.select(docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text")).dropna()
    languages = [x["lang"] for x in given.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([], np.empty(0), np.zeros(CELLS + 1, np.int64), np.empty(0, np.int32), np.empty(0))
    numbers = docs.sparkSession.sparkContext.broadcast({x: i for i, x in enumerate(languages)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("language_id")
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, n = counted(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array((k >> 16).astype(np.int32)), pa.array((k & (CELLS - 1)).astype(np.int32)), pa.array(n)], names=["lang", "cell", "n"])

        for batch in batches:
            langs = np.array([numbers.value[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            for i, j, data, offsets in text_chunks(batch, "text"):
                texts, own = _padded(data, offsets), langs[i:j]
                cell, is_one = _cells(np.concatenate(texts))
                text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                is_one &= text[:-2] == text[2:]  # none reaches from one text into the next
                k, n = distinct((own[text[:-2][is_one]] << 16) | cell[is_one])
                keys.append(k), counts.append(n)
                held += len(k)
                if held > HELD:
                    k, n = counted(keys, counts)
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD // 2:
                        yield out()
                        keys, counts, held = [], [], 0
        if keys:
            yield out()

    table = given.mapInArrow(run, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # pairs that occur
    cell, column, n = (table[c].to_numpy() for c in ("cell", "lang", "n"))
    order = np.lexsort((column, cell))
    cell, column, n = cell[order], column[order], n[order]
    total = np.bincount(column, n, len(languages)) + 0.5 * CELLS
    return Model(languages, 0.5 / total, np.searchsorted(cell, np.arange(CELLS + 1)), column, n / total[column])


def proportions(p: Sparse | np.ndarray, n: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Shares of the columns of p (likelihoods of observations) and the log likelihood; n: weights of the observations."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds if p.shape[1] > 1 else 0):
        if isinstance(p, Sparse):
            new = share * p.summed(n / p.mixed(share)) / total
        else:
            joint = p * share
            new = (n / joint.sum(1)) @ joint / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p.mixed(share) if isinstance(p, Sparse) else p @ share))


def select(p: Sparse | np.ndarray, n: np.ndarray, penalty: float = 3.0) -> tuple[list[int], np.ndarray]:
    """The languages of a document, by penalised likelihood, and their shares. A language costs penalty + log(observations) / 2."""
    n = n / 3
    cost = penalty + 0.5 * np.log1p(n.sum())
    chosen = list(range(p.shape[1]))
    share, best = proportions(p, n)
    while len(chosen) > 1:
        order = share.argsort(kind="stable")
        # those that hold next to nothing go together, else the least goes alone
        gone = [i for i in order[:-1].tolist() if share[i] * n.sum() < 0.5] or order[:1].tolist()
        fewer = [c for i, c in enumerate(chosen) if i not in gone]
        less, likelihood = proportions(p.of(fewer) if isinstance(p, Sparse) else p[:, fewer], n)
        if best - likelihood > cost * len(gone):
            break
        chosen, share, best = fewer, less, likelihood
    return chosen, share


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of that language in the text), languages (those found); one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("language_id")
        model = shared.value
        languages = model.languages
        for batch in batches:
            preds, scores, sets = [], [], []
            letters = [bool(languages) and has_letter(x.as_py()) for x in batch.column(1)]
            for i, j, data, offsets in text_chunks(batch, "text"):
                for text, ok in zip(_padded(data, offsets), letters[i:j], strict=True):
                    if not ok:
                        preds.append("und"), scores.append(0.0), sets.append([])
                        continue
                    cell, counted = _cells(text)
                    cell, n = np.unique(cell[counted], return_counts=True)
                    chosen, share = select(model.of(cell), n)
                    k = int(share.argmax())
                    preds.append(languages[chosen[k]]), scores.append(float(min(1.0, share[k]))), sets.append([languages[c] for c in chosen])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], schema=schema)

    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")
