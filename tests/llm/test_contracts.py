"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

import duckdb
import pytest
from test_minhash import brute as near_brute
from test_suffix_dedup import brute as repeat_brute

from lumenframe.llm import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(r[columns.index(c)] for c in df.columns) for r in want.fetchall()]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_duplicates(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op1_minhash_near_dedup"](spark, SF).collect()}
    assert got == near_brute(rows)


def test_repeated_passages(spark, rows):
    got = {r.doc_id: [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] for r in QUERIES["op7_suffix_array_dedup"](spark, SF).collect()}
    assert got == repeat_brute(rows)


COLUMNS = {
    "op3_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_toxicity": {"doc_id": "bigint", "severity": "double", "grade": "int", "p_toxic": "double", "toxic": "boolean"},
    "op6_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_sentencepiece": {"doc_id": "bigint", "n_ids": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "exact": "boolean"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, rows, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    got = df.collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    if name == "op3_lm_scoring":
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) * 1.5
    if name == "op8_sentencepiece":
        assert all(r.exact for r in got)
    if name == "op10_language_id":
        truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.95
