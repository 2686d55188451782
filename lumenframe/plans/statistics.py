"""Descriptive statistics, correlation, tests, survival and series analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import stats as S
from lumenframe.operators import timeseries as TS
from lumenframe.plans.registry import Registry
from lumenframe.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def rounded(df, digits=6, keep=()):
    """Doubles rounded, as sums differ in their last digits with the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


_M = "avg(value) AS m, sum(power(value - mu, 2)) / count(*) AS m2, sum(power(value - mu, 3)) / count(*) AS m3, sum(power(value - mu, 4)) / count(*) AS m4"


@query(
    "describe",
    f"""WITH c AS (SELECT *, avg(value) OVER (PARTITION BY event_type) AS mu FROM events), g AS (SELECT event_type, {_M}, stddev_samp(value) AS sd FROM c GROUP BY 1)
        SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median,
        round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max, round(any_value(m3 / power(sd, 3)), 6) AS skewness, round(any_value(m4 / power(sd, 4) - 3), 6) AS kurtosis FROM events JOIN g USING (event_type) GROUP BY 1""",
)
def _(spark, d):
    return rounded(S.describe(table(spark, d, "events"), "value", ["event_type"]))


@query("quantiles", "SELECT event_type, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS p, round(unnest(quantile_cont(value, [0.1, 0.5, 0.9])), 6) AS value FROM events GROUP BY 1")
def _(spark, d):
    return rounded(S.quantiles(table(spark, d, "events"), "value", [0.1, 0.5, 0.9], ["event_type"]))


@query("corr_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(S.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]))


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("corr_spearman", f"SELECT round(corr(a, b), 6) AS r FROM (SELECT {_rank_sql('p_size')} AS a, {_rank_sql('p_retailprice')} AS b FROM part)")
def _(spark, d):
    return rounded(S.spearman(table(spark, d, "part"), "p_size", "p_retailprice"))


@query(
    "corr_kendall",
    """WITH t AS (SELECT l_linenumber AS a, l_discount AS b FROM lineitem), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
       p AS (SELECT sum(x.n * y.n * sign(x.a - y.a) * sign(x.b - y.b)) / 2 AS s FROM n x, n y), z AS (SELECT sum(n) * (sum(n) - 1) / 2 AS e FROM n),
       ta AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM n GROUP BY a)), tb AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM n GROUP BY b))
       SELECT round(s / sqrt((e - ta.v) * (e - tb.v)), 6) AS tau FROM p, z, ta, tb""",
)
def _(spark, d):
    return rounded(S.kendall(table(spark, d, "lineitem"), "l_linenumber", "l_discount"))


_C3 = ["l_quantity", "l_extendedprice", "l_tax"]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _C3 for b in _C3))
def _(spark, d):
    return rounded(S.corr_matrix(table(spark, d, "lineitem"), _C3))


_TWO = "WITH s AS (SELECT count(value) FILTER (event_type = 'view')::DOUBLE AS na, count(value) FILTER (event_type = 'click')::DOUBLE AS nb, avg(value) FILTER (event_type = 'view') AS ma, avg(value) FILTER (event_type = 'click') AS mb, var_samp(value) FILTER (event_type = 'view') AS va, var_samp(value) FILTER (event_type = 'click') AS vb FROM events)"


def _p_known(df, *exact):
    """Rounded, without the p-value: DuckDB has no distributions; tests compare p-values with published constants."""
    return rounded(df.drop("p_value"))


@query("t_test_welch", _TWO + " SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS statistic, round(power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 6) AS df FROM s")
def _(spark, d):
    return _p_known(S.t_test_welch(table(spark, d, "events"), "value", "event_type", "view", "click"))


@query("t_test_one_sample", "SELECT round((avg(value) - 49) / (stddev_samp(value) / sqrt(count(value))), 6) AS statistic, (count(value) - 1)::DOUBLE AS df FROM events")
def _(spark, d):
    return _p_known(S.t_test_one_sample(table(spark, d, "events"), "value", 49.0))


@query("effect_sizes", _TWO + ", e AS (SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d, (ma - mb) / sqrt(vb) AS g, na + nb - 2 AS f FROM s) SELECT round(d, 6) AS cohens_d, round(d * (1 - 3 / (4 * f - 1)), 6) AS hedges_g, round(g, 6) AS glass_delta FROM e")
def _(spark, d):
    return rounded(S.effect_sizes(table(spark, d, "events"), "value", "event_type", "view", "click"))


@query(
    "anova",
    """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, sum(value) AS s FROM events GROUP BY 1), t AS (SELECT avg(value) AS mu, count(*) AS n FROM events), b AS (SELECT sum(g.n * power(m - mu, 2)) AS ssb, count(*) - 1 AS dfb FROM g, t),
       w AS (SELECT sum(power(value - m, 2)) AS ssw, count(*) - count(DISTINCT event_type) AS dfw FROM events JOIN g USING (event_type))
       SELECT dfb::DOUBLE AS df_between, dfw::DOUBLE AS df_within, round((ssb / dfb) / (ssw / dfw), 5) AS statistic, round(ssb / (ssb + ssw), 6) AS eta_squared, round((ssb - dfb * ssw / dfw) / (ssb + ssw + ssw / dfw), 6) AS omega_squared FROM b, w""",
)
def _(spark, d):
    got = S.anova(table(spark, d, "events"), "value", "event_type").drop("p_value")
    return got.select("df_between", "df_within", F.round("statistic", 5).alias("statistic"), F.round("eta_squared", 6).alias("eta_squared"), F.round("omega_squared", 6).alias("omega_squared"))


@query("chi_square", "WITH c AS (SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1), t AS (SELECT sum(n) AS a FROM c) SELECT round(sum(power(n - a / 5, 2) / (a / 5)), 6) AS statistic, 4.0::DOUBLE AS df, round(sqrt(sum(power(n / a - 0.2, 2) / 0.2)), 6) AS w FROM c, t")
def _(spark, d):
    return _p_known(S.chi_square(table(spark, d, "customer"), "c_mktsegment"))


@query(
    "cramers_v",
    """WITH c AS (SELECT event_type AS a, user_id % 4 AS b, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x, sum(n) OVER () AS t FROM c),
       s AS (SELECT sum(power(n - x, 2) / x) AS q, any_value(t) AS t, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM e) SELECT round(q, 5) AS statistic, ((ka - 1) * (kb - 1))::DOUBLE AS df, round(sqrt(q / t / least(ka - 1, kb - 1)), 6) AS cramers_v FROM s""",
)
def _(spark, d):
    got = S.contingency(table(spark, d, "events").withColumn("g", F.col("user_id") % 4), "event_type", "g")
    return got.select(F.round("statistic", 5).alias("statistic"), "df", F.round("cramers_v", 6).alias("cramers_v"))


@query(
    "mann_whitney_u",
    f"""WITH t AS (SELECT event_type, {_rank_sql('value')} AS r FROM events WHERE event_type IN ('view', 'click')), s AS (SELECT sum(r) FILTER (event_type = 'view') AS ra, count(*) FILTER (event_type = 'view')::DOUBLE AS na, count(*) FILTER (event_type = 'click')::DOUBLE AS nb FROM t)
        SELECT ra - na * (na + 1) / 2 AS u, round((ra - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb * (na + nb + 1) / 12), 6) AS z FROM s""",
)
def _(spark, d):
    return _p_known(S.mann_whitney(table(spark, d, "events"), "value", "event_type", "view", "click"))


@query(
    "ks_test",
    """WITH t AS (SELECT value, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'click') AS b FROM events WHERE event_type IN ('view', 'click') GROUP BY 1), c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM t WINDOW w AS (ORDER BY value))
       SELECT round(max(abs(fa - fb)), 9) AS statistic FROM c""",
)
def _(spark, d):
    return rounded(S.ks_test(table(spark, d, "events"), "value", "event_type", "view", "click"), 9)


@query("point_biserial", "SELECT round(corr((event_type = 'purchase')::INTEGER, value), 6) AS r FROM events")
def _(spark, d):
    return rounded(S.point_biserial(table(spark, d, "events"), F.col("event_type") == "purchase", "value"))


_Z = "1.959963984540054"


@query("ci_mean", f"SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - {_Z} * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + {_Z} * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM events GROUP BY 1")
def _(spark, d):
    return rounded(S.ci_mean(table(spark, d, "events"), "value", by=["event_type"]))


@query("ci_proportion", f"WITH s AS (SELECT avg((event_type = 'error')::INTEGER) AS p, count(*) AS n FROM events) SELECT round(p, 6) AS p, round(p - {_Z} * sqrt(p * (1 - p) / n), 6) AS low, round(p + {_Z} * sqrt(p * (1 - p) / n), 6) AS high FROM s")
def _(spark, d):
    return rounded(S.ci_proportion(table(spark, d, "events"), F.col("event_type") == "error"))


_PV = "(SELECT s_suppkey, (s_suppkey * 37 % 100 + 1) / 1000.0::DOUBLE AS p FROM supplier)"


def _pvalues(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 100 + 1) / 1000.0).alias("p"))


@query("bonferroni", f"SELECT s_suppkey, p, round(least(p * count(*) OVER (), 1), 9) AS adjusted FROM {_PV}")
def _(spark, d):
    return rounded(S.bonferroni(_pvalues(spark, d), "p"), 9, keep=("p",))


@query("benjamini_hochberg", f"WITH r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, s_suppkey) AS q FROM {_PV}) SELECT s_suppkey, p, round(least(min(q) OVER (ORDER BY p, s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS adjusted FROM r")
def _(spark, d):
    return rounded(S.benjamini_hochberg(_pvalues(spark, d), "p", "s_suppkey"), 9, keep=("p",))


@query("ols_line", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def _(spark, d):
    got = S.ols(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return got.select("l_returnflag", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


_LIFE = "(SELECT user_id % 2 AS g, floor(value)::BIGINT AS t, (event_type <> 'error')::INTEGER AS e FROM events)"


def _life(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 2).alias("g"), F.floor("value").alias("t"), (F.col("event_type") != "error").cast("int").alias("e"))


@query(
    "kaplan_meier",
    f"""WITH t AS (SELECT g, t AS time, count(*) AS n, sum(e) AS events FROM {_LIFE} GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY time DESC) AS at_risk FROM t), k AS (SELECT * FROM r WHERE events > 0)
        SELECT g, time, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(product(1 - events / at_risk) OVER w, 8) AS survival, round(product(1 - events / at_risk) OVER w * sqrt(sum(events / nullif(at_risk * (at_risk - events), 0)) OVER w), 8) AS std_error FROM k WINDOW w AS (PARTITION BY g ORDER BY time)""",
)
def _(spark, d):
    return rounded(S.kaplan_meier(_life(spark, d), "t", "e", ["g"]), 8)


@query(
    "log_rank",
    f"""WITH t AS (SELECT t, count(*) AS n, count(*) FILTER (g = 0) AS na, sum(e)::DOUBLE AS d, sum(e) FILTER (g = 0)::DOUBLE AS da FROM {_LIFE} GROUP BY 1), r AS (SELECT d, da, sum(n) OVER (ORDER BY t DESC)::DOUBLE AS r, sum(na) OVER (ORDER BY t DESC)::DOUBLE AS ra FROM t)
        SELECT round(power(sum(coalesce(da, 0)) - sum(d * ra / r), 2) / sum(CASE WHEN r > 1 THEN d * ra / r * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END), 6) AS statistic FROM r WHERE d > 0""",
)
def _(spark, d):
    return _p_known(S.log_rank(_life(spark, d), "t", "e", "g", 0))


# series


@query("acf", "WITH s AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), v AS (SELECT user_id, sum(x * x) AS d FROM s GROUP BY 1) SELECT a.user_id, k::INTEGER AS lag, round(sum(a.x * coalesce(b.x, 0)) / any_value(d), 8) AS acf FROM range(0, 6) t(k) CROSS JOIN s a LEFT JOIN s b ON b.user_id = a.user_id AND b.i = a.i + k JOIN v ON v.user_id = a.user_id GROUP BY 1, 2")
def _(spark, d):
    return TS.acf(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 5).select("user_id", "lag", F.round("acf", 8).alias("acf"))


@query("zscore_anomaly", "SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def _(spark, d):
    return TS.zscore(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 11).select("event_id", F.round("z", 6).alias("z"))


@query(
    "seasonal_decompose",
    """WITH s AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       t AS (SELECT *, CASE WHEN i >= 2 AND i < n - 2 THEN avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS trend FROM s),
       p AS (SELECT user_id, i % 5 AS ph, avg(value - trend) AS m FROM t GROUP BY 1, 2), c AS (SELECT *, m - avg(m) OVER (PARTITION BY user_id) AS season FROM p)
       SELECT t.event_id, round(trend, 6) AS trend, round(season, 6) AS seasonal, round(value - trend - season, 6) AS residual FROM t JOIN c ON t.user_id = c.user_id AND t.i % 5 = c.ph""",
)
def _(spark, d):
    return rounded(TS.decompose(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 5).select("event_id", "trend", "seasonal", "residual"))


@query(
    "ts_features",
    """WITH s AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS w, event_id FROM events), c AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, w ORDER BY event_id) AS diff FROM s)
       SELECT user_id, w::BIGINT AS w, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(sum(value * value), 4) AS energy, round(avg(abs(diff)), 6) AS mean_abs_change FROM c GROUP BY 1, 2 HAVING count(*) = 10""",
)
def _(spark, d):
    got = TS.features(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 10)
    return got.select("user_id", "w", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max", F.round("energy", 4).alias("energy"), F.round("mean_abs_change", 6).alias("mean_abs_change"))


@query("exponential_smoothing", "WITH RECURSIVE p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, event_id, n, value AS level FROM p WHERE n = 1 UNION ALL SELECT p.user_id, p.event_id, p.n, 0.4 * p.value + 0.6 * e.level FROM e JOIN p ON p.user_id = e.user_id AND p.n = e.n + 1) SELECT event_id, round(level, 6) AS level FROM e")
def _(spark, d):
    return TS.smooth(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 0.4, "level").select("event_id", F.round("level", 6).alias("level"))


@query("kalman_filter")
def _(spark, d):
    return TS.kalman(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 0.5, 4.0, "estimate").select("event_id", "estimate")


@query("pacf")
def _(spark, d):
    return TS.pacf(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 5)


@query("arima_forecast")
def _(spark, d):
    return TS.forecast_ar(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 2, 1, 3)


@query("garch_volatility")
def _(spark, d):
    return TS.garch(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 1.0, 0.1, 0.8, "variance").select("event_id", "variance")


@query("adf_test")
def _(spark, d):
    return TS.adf(table(spark, d, "events"), "value", ["user_id"], ["event_id"], 1)


@query("granger_causality")
def _(spark, d):
    ev = table(spark, d, "events").withColumn("other", F.lag("value", 2, 0.0).over(TS.spec(["user_id"], ["event_id"])))
    return TS.granger(ev, "value", "other", ["user_id"], ["event_id"], 2)
