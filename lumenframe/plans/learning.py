"""Preparation, metrics, selection, neighbours, clustering, models and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import scalar as S
from lumenframe.operators import ml as M
from lumenframe.operators import text as T
from lumenframe.plans.registry import Registry
from lumenframe.plans.statistics import rounded
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("standard_scaler", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def _(spark, d):
    return rounded(M.standard_scaler(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@query("minmax_scaler", "SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ())::DOUBLE, 8) AS p_size FROM part")
def _(spark, d):
    return rounded(M.minmax_scaler(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"]), 8)


@query("label_encode", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def _(spark, d):
    return M.label_encode(table(spark, d, "customer"), "c_mktsegment", "code").select("c_custkey", "code")


@query("one_hot", "SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'A')::INTEGER AS \"l_returnflag_A\", (l_returnflag = 'N')::INTEGER AS \"l_returnflag_N\", (l_returnflag = 'R')::INTEGER AS \"l_returnflag_R\" FROM lineitem")
def _(spark, d):
    return M.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query("binary_encode", "SELECT n_nationkey, (n_nationkey // 4 % 2)::INTEGER AS k_2, (n_nationkey // 8 % 2)::INTEGER AS k_1, (n_nationkey // 16 % 2)::INTEGER AS k_0, (n_nationkey // 2 % 2)::INTEGER AS k_3, (n_nationkey % 2)::INTEGER AS k_4 FROM nation")
def _(spark, d):
    return M.binary_encode(table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").alias("k")), "k", 5).drop("k")


@query("target_encode", "WITH m AS (SELECT avg(o_totalprice) AS a FROM orders), g AS (SELECT o_orderpriority, (sum(o_totalprice) + 10 * any_value(a)) / (count(*) + 10) AS e FROM orders, m GROUP BY 1) SELECT o_orderkey, round(e, 4) AS e FROM orders JOIN g USING (o_orderpriority)")
def _(spark, d):
    return M.target_encode(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", 10.0, "e").select("o_orderkey", F.round("e", 4).alias("e"))


@query("polynomial_features", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax, round(l_quantity * l_quantity, 6) AS \"l_quantity*l_quantity\", round(l_quantity * l_tax, 6) AS \"l_quantity*l_tax\", round(l_tax * l_tax, 6) AS \"l_tax*l_tax\" FROM lineitem")
def _(spark, d):
    got = M.polynomial(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return rounded(got, 6, keep=("l_quantity", "l_tax"))


_LABELLED = "(SELECT l.quality AS t, (d.n_chars > 800)::INTEGER AS p FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("t"), (F.col("n_chars") > 800).cast("int").alias("p"))


@query(
    "classification_metrics",
    f"""WITH c AS (SELECT count(*) FILTER (t = p)::DOUBLE AS ok, count(*) AS n, count(*) FILTER (t = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 1 AND p = 0) AS fn FROM {_LABELLED}), r AS (SELECT ok / n AS a, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c)
        SELECT round(a, 8) AS accuracy, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1 FROM r""",
)
def _(spark, d):
    return rounded(M.classification_metrics(_labelled(spark, d), "t", "p"), 8)


@query("confusion_matrix", f"SELECT t AS truth, p AS predicted, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2")
def _(spark, d):
    return M.confusion_matrix(_labelled(spark, d), "t", "p")


@query("regression_metrics", "WITH e AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem) SELECT round(avg(power(t - p, 2)), 2) AS mse, round(sqrt(avg(power(t - p, 2))), 6) AS rmse, round(avg(abs(t - p)), 6) AS mae, round(1 - sum(power(t - p, 2)) / (var_pop(t) * count(*)), 8) AS r2 FROM e")
def _(spark, d):
    got = M.regression_metrics(table(spark, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p")
    return got.select(F.round("mse", 2).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 8).alias("r2"))


def _f_sql(c):
    return f"""SELECT '{c}' AS feature, round(((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))), 5) AS f FROM (SELECT l_returnflag, count(*) AS n, sum({c}) AS s, sum({c} * {c}) AS q FROM lineitem GROUP BY 1)"""


@query("f_classif", " UNION ALL ".join(map(_f_sql, ("l_quantity", "l_discount"))))
def _(spark, d):
    return rounded(M.f_scores(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag"), 5)


def _chi_sql(c):
    return f"SELECT '{c}' AS feature, round(sum(power(s - w, 2) / w), 5) AS chi2 FROM (SELECT s, sum(s) OVER () * n / sum(n) OVER () AS w FROM (SELECT l_linestatus, count(*) AS n, sum({c}) AS s FROM lineitem GROUP BY 1))"


@query("chi2_score", " UNION ALL ".join(map(_chi_sql, ("l_quantity", "l_tax"))))
def _(spark, d):
    return rounded(M.chi2_scores(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_linestatus"), 5)


@query("train_test_split")
def _(spark, d):
    return M.split(table(spark, d, "orders"), "o_orderkey", 0.25).groupBy("test").agg(F.count(F.lit(1)).alias("n"))


@query("k_fold")
def _(spark, d):
    return M.folds(table(spark, d, "orders"), "o_orderkey", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


_KNN = {
    "l2": "sqrt(list_sum(list_transform(list_zip(q.v, r.v), lambda z: power(z[1] - z[2], 2))))",
    "l1": "list_sum(list_transform(list_zip(q.v, r.v), lambda z: abs(z[1] - z[2])))",
    "cosine": "1 - list_inner_product(q.v, r.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(r.v, r.v))",
    "dot": "-list_inner_product(q.v, r.v)",
}

for _name, _expr in _KNN.items():

    @query(
        f"knn_{_name}",
        f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT min(vec_id) AS query, label, arg_min(v, vec_id) AS v FROM v GROUP BY label), p AS (SELECT query, r.vec_id AS id, {_expr} AS d FROM q, v r),
            n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS n FROM p) SELECT query, id, round(d, 6) AS distance FROM n WHERE n <= 5""",
    )
    def _(spark, d, name=_name):
        rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
        first = rows.groupBy("label").agg(F.min("id").alias("id"), F.min_by("vector", "id").alias("vector"))  # a query a label
        return rounded(M.nearest(rows, first, 5, name))


_CENTERS = [[10.0, 0.02], [25.0, 0.05], [40.0, 0.08]]


@query(
    "kmeans_assign",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(list_min([{'d': power(l_quantity - 10, 2) + power(l_discount - 0.02, 2), 'i': 0}, {'d': power(l_quantity - 25, 2) + power(l_discount - 0.05, 2), 'i': 1}, {'d': power(l_quantity - 40, 2) + power(l_discount - 0.08, 2), 'i': 2}]).i AS INTEGER) AS cluster FROM lineitem",
)
def _(spark, d):
    return M.assign(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], _CENTERS).select("l_orderkey", "l_linenumber", "l_partkey", "cluster")


@query("kmeans_fit")
def _(spark, d):
    centers = M.kmeans(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], _CENTERS)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centers)], "cluster int, l_quantity double, l_discount double")


@query(
    "gaussian_nb_fit",
    "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 5) AS var_l_quantity, round(avg(l_tax), 6) AS mean_l_tax, round(var_pop(l_tax), 8) AS var_l_tax, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 8) AS prior FROM lineitem GROUP BY 1",
)
def _(spark, d):
    digits = {"mean_l_quantity": 6, "var_l_quantity": 5, "mean_l_tax": 6, "var_l_tax": 8, "prior": 8}
    got = M.gaussian_nb(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag")
    return got.select("l_returnflag", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("gaussian_nb_predict")
def _(spark, d):
    line = table(spark, d, "lineitem").withColumn("key", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    model = M.gaussian_nb(line, ["l_quantity", "l_tax"], "l_returnflag")
    return M.predict_nb(line, model, ["l_quantity", "l_tax"], "l_returnflag", "key")


@query("ridge_regression")
def _(spark, d):
    beta = M.ridge(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 1.0)
    return spark.createDataFrame([(n, float(b)) for n, b in zip(["intercept", "l_quantity", "l_discount", "l_tax"], beta, strict=True)], "term string, coefficient double")


@query("pca")
def _(spark, d):
    parts, variances = M.pca(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 2)
    return spark.createDataFrame([(i, float(v), [float(x) for x in p]) for i, (p, v) in enumerate(zip(parts, variances, strict=True))], "component int, variance double, loadings array<double>")


for _kind in ("logistic_classifier", "tree_classifier", "forest_classifier", "boosting_classifier", "tree_regressor", "forest_regressor", "boosting_regressor", "linear_regressor", "svm_classifier"):

    @query(_kind)
    def _(spark, d, kind=_kind):
        rows = table(spark, d, "lineitem").withColumn("label", (F.col("l_extendedprice") > 40_000).cast("double") if "classifier" in kind else F.col("l_extendedprice"))
        columns = ["l_quantity", "l_discount", "l_tax"]
        params = {"seed": 7} if kind.split("_")[0] in ("forest", "boosting") else {}
        params |= {"maxIter": 5} if "boosting" in kind else {"numTrees": 10} if "forest" in kind else {}
        train = M.vectors(rows, columns).select("features", "label")
        return M.estimator(kind, **params).fit(train).transform(train).groupBy("label" if "classifier" in kind else F.lit(0).alias("all")).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"))


# text


@query("token_counts", "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY 1, 2")
def _(spark, d):
    return T.token_counts(table(spark, d, "documents"), "doc_id", "text")


@query("document_frequency", "SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY 1")
def _(spark, d):
    return T.document_frequency(T.token_counts(table(spark, d, "documents"), "doc_id", "text"))


@query(
    "tfidf",
    """WITH c AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) GROUP BY 1, 2), f AS (SELECT token, count(*) AS df FROM c GROUP BY 1), a AS (SELECT count(*) AS n FROM documents),
       w AS (SELECT doc_id, token, c.n * (ln((1 + a.n) / (1 + df)) + 1) AS w FROM c JOIN f USING (token), a), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1) SELECT doc_id, token, round(w / l, 6) AS weight FROM w JOIN l USING (doc_id)""",
)
def _(spark, d):
    return rounded(T.tfidf(table(spark, d, "documents"), "doc_id", "text"))


@query("word_bigrams", "WITH t AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents) SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM t) GROUP BY 1")
def _(spark, d):
    return T.tokens(table(spark, d, "documents"), "text").select(F.explode(S.ngrams(F.col("tokens"), 2)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("char_trigrams", "SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS g FROM part) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(S.char_ngrams(F.col("p_name"), 3)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("stopword_filter", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: t NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS) + ")))::BIGINT AS n FROM documents")
def _(spark, d):
    return T.tokens(table(spark, d, "documents"), "text").select("doc_id", F.size(T.remove_stopwords("tokens")).cast("long").alias("n"))


@query("normalize_text", "SELECT doc_id, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N} ]', '', 'g')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalize(F.col("text"))).alias("h"))


def _lexicon(words):
    return "len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + ")))::BIGINT"


@query("sentiment", f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents), c AS (SELECT doc_id, {_lexicon(T.POSITIVE)} AS positive, {_lexicon(T.NEGATIVE)} AS negative FROM t) SELECT doc_id, positive, negative, CASE WHEN positive + negative = 0 THEN 0 ELSE round((positive - negative) / (positive + negative), 8) END::DOUBLE AS score FROM c")
def _(spark, d):
    return rounded(T.sentiment(table(spark, d, "documents"), "text").select("doc_id", "positive", "negative", "score"), 8)


@query(
    "similar_texts",
    """WITH t AS (SELECT doc_id, n_chars, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents), f AS (SELECT n_chars, min(doc_id) AS first, arg_min(t, doc_id) AS f FROM t GROUP BY 1)
       SELECT doc_id, first, round(len(list_intersect(t, f)) / greatest(len(list_distinct(list_concat(t, f))), 1), 8) AS jaccard FROM t JOIN f USING (n_chars) WHERE doc_id <> first""",
)
def _(spark, d):
    return T.best_similar(table(spark, d, "documents"), "doc_id", "text", ["n_chars"]).select("doc_id", "first", F.round("jaccard", 8).alias("jaccard"))


@query("edit_similarity", "WITH f AS (SELECT p_brand, min(p_name) AS f FROM part GROUP BY 1) SELECT p_partkey, levenshtein(p_name, f)::INTEGER AS distance, round(1 - levenshtein(p_name, f) / greatest(length(p_name), length(f)), 8) AS similarity FROM part JOIN f USING (p_brand)")
def _(spark, d):
    part = table(spark, d, "part")
    joined = part.join(part.groupBy("p_brand").agg(F.min("p_name").alias("f")), "p_brand")
    return joined.select("p_partkey", F.levenshtein("p_name", "f").alias("distance"), F.round(S.edit_similarity(F.col("p_name"), F.col("f")), 8).alias("similarity"))


@query("porter_stems")
def _(spark, d):
    return T.stems(T.token_counts(table(spark, d, "documents").filter("lang = 'en'"), "doc_id", "text"))


@query("whitespace_and_char_tokens", "SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words, length(text) AS characters FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(T.whitespace_tokens(F.col("text"))).cast("long").alias("words"), F.size(T.char_tokens(F.col("text"))).cast("long").alias("characters"))


@query("named_entities", "SELECT doc_id, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))::BIGINT AS dates, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'))::BIGINT AS emails, len(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+'))::BIGINT AS links, len(regexp_extract_all(text, '[0-9]+%'))::BIGINT AS shares FROM documents")
def _(spark, d):
    patterns = {"dates": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "emails": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "links": "https?://[A-Za-z0-9./_-]+", "shares": "[0-9]+%"}
    got = T.gazetteer(table(spark, d, "documents"), "text", {"Paris": "place", "New York": "place", "Berlin": "place"}, patterns)
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == F.lit(k))).cast("long")
    return got.select("doc_id", *[count(k).alias(k) for k in patterns])


@query("lda_topics")
def _(spark, d):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    rows = T.tokens(table(spark, d, "documents"), "text").select("doc_id", "tokens")
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=2**31 - 1, minDF=1).fit(rows).transform(rows)  # every word
    return LDA(k=4, maxIter=5, seed=1).fit(counts).describeTopics(8)


@query("word2vec")
def _(spark, d):
    from pyspark.ml.feature import Word2Vec

    rows = T.tokens(table(spark, d, "benchmark"), "text").select("tokens")
    return Word2Vec(vectorSize=16, minCount=2, inputCol="tokens", outputCol="v", seed=1, maxIter=2).fit(rows).getVectors().selectExpr("word")
