import hashlib
import re
from collections import defaultdict

from lumenframe.llm import exact_dedup as ed


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    out = []
    for sha, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = min(real) if real else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), first, sha))
            first = False
    return out


ROWS = [(5, "a  b"), (3, "a\tb"), (3, "a\tb"), (9, "a b "), (None, None), (7, ""), (None, "lone"), (None, "lone"), (2, "é x"), (1, "é x"), (11, "z " * 100_000), (10, "z\n" * 100_000)]
key = lambda x: tuple(str(y) for y in x)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "c") for i, t in ROWS], "doc_id long, text string, digest string")
    got = [(x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in ed.annotate(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)
    assert ed.annotate(docs.limit(0)).collect() == []


def test_dedup_keeps_rows_whole(spark):
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, __id int, c0 string")
    got = ed.dedup(docs)
    assert got.columns == docs.columns
    kept = sorted((x.doc_id for x in got.collect()), key=str)
    assert kept == sorted([r[0] for r in brute(ROWS) if r[3]], key=str)


def test_a_hot_digest_and_a_second_batch(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    index = ed.DigestIndex(spark)
    first = ed.annotate(docs, index).filter("kept").count()
    assert first == 2001 and index.rows().count() == 2001
    again = ed.annotate(docs.limit(500).unionAll(spark.createDataFrame([(99999, "brand new")], "doc_id long, text string")), index)
    assert [x.doc_id for x in again.filter("kept").collect()] == [99999]
    assert index.rows().count() == 2002
    detail = {x.col_name: x.data_type for x in spark.sql(f"DESCRIBE TABLE EXTENDED {index.name}").collect()}
    assert detail["Num Buckets"] == "24" and "digest" in detail["Bucket Columns"] and "digest" in detail["Sort Columns"]


def test_batches_and_a_named_index_found_again(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('t', id % 600) AS text")
    for batches in (1, 2, 5):
        got = {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in ed.annotate(docs, batches=batches).collect()}
        assert got == {i: (i % 600, 2 if i % 600 < 400 else 1, i < 600) for i in range(1000)}
    name = "digests_of_a_test"
    assert ed.annotate(docs, ed.DigestIndex(spark, name, 8)).filter("kept").count() == 600
    index = ed.DigestIndex(spark, name)
    assert index.buckets == 8 and ed.annotate(docs, index).filter("kept").count() == 0
    index.drop()
    assert not index.exists()


def test_the_anti_join_reads_the_index_by_its_buckets(spark):
    index = ed.DigestIndex(spark, buckets=8)
    index.create(0)
    own = spark.range(10).selectExpr("cast(id AS string) AS digest", "id AS keep").repartition(8, "digest").groupBy("digest").agg({"keep": "min"})
    plan = own.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = ed.annotate(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
