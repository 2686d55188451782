"""Descriptive statistics, correlation, tests and survival, as aggregates and windows.

Every function is one or two passes of partial aggregates; ranks are windows over the compared values. p-values come from the
numeric functions in lumenframe.functions.special, on the one row an aggregate leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import special
from lumenframe.operators.frame import running_sums, with_row_number
from lumenframe.operators.lineage import cut


def _f64(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def moments(c: Column) -> dict[str, Column]:
    """n, mean, sample std, and skewness and excess kurtosis on the sample std, in one pass over powers of the values."""
    n, s1, s2, s3, s4 = F.count(c), F.sum(c), F.sum(c * c), F.sum(c * c * c), F.sum(c * c * c * c)
    mean = s1 / n
    m2 = s2 / n - mean * mean
    m3 = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean * mean * s2 / n - 3 * mean * mean * mean * mean
    sd = F.sqrt(F.greatest(m2, F.lit(0.0)) * n / F.nullif(n - 1, F.lit(0)))
    return {"n": n, "mean": mean, "std": sd, "skewness": m3 / F.nullif(sd * sd * sd, F.lit(0.0)), "kurtosis": m4 / F.nullif(sd * sd * sd * sd, F.lit(0.0)) - 3}


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (sample), min, q25, median, q75, max, skewness and excess kurtosis (about the sample std)."""
    c = _f64(column)
    m = moments(c)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(m["n"].alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"), m["skewness"].alias("skewness"), m["kurtosis"].alias("kurtosis"))
    return out.select(*by, "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max", "skewness", "kurtosis")


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p, value), linearly interpolated."""
    got = df.groupBy(*by).agg(F.percentile(_f64(column), F.array(*[F.lit(float(p)) for p in probabilities])).alias("v"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), F.col("v").alias("value"))
    return got.select(*by, F.inline(pairs).alias("p", "value"))


def ranks(column: str, by: Sequence[str] = ()) -> Column:
    """Average ranks, ties sharing theirs."""
    w = Window.partitionBy(*by).orderBy(column)
    ties = Window.partitionBy(*by, column)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(_f64(a), _f64(b)).alias("r"))


def mean_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank) of the distinct values: the mean of their rows' places, numbered over range partitions."""
    placed = with_row_number(df.select(column).filter(F.col(column).isNotNull()), [F.col(column).asc()], "_at")
    return placed.groupBy(column).agg((F.avg("_at") + 1).alias("rank"))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Groups are ranked by windows; a whole table by mean ranks joined back, so that no task sees all rows."""
    if by:
        return df.withColumn("_ra", ranks(a, by)).withColumn("_rb", ranks(b, by)).groupBy(*by).agg(F.corr("_ra", "_rb").alias("r"))
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    joined = both.join(mean_ranks(both, a).withColumnRenamed("rank", "_ra"), a).join(mean_ranks(both, b).withColumnRenamed("rank", "_rb"), b)
    return joined.agg(F.corr("_ra", "_rb").alias("r"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b over the rows in which neither column is null; null where a column has one value only.

    Concordant pairs are counted bit by bit of b's rank: two values of b first differ in one bit, so every pair is met in one
    half-open block, where the rows below it in a are a running sum. All bits are one sort of the distinct (a, b) times the bits.
    """
    cells = cut(df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n")))
    codes = with_row_number(cells.select("b").distinct(), [F.col("b").asc()], "code")
    bits = max(1, (codes.count() - 1).bit_length())
    dealt = cells.join(codes, "b").select("a", "n", "code", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    upper = F.expr("shiftright(code, bit) & 1") == 1
    blocks = dealt.groupBy("bit", F.expr("shiftright(code, bit + 1)").alias("block"), "a").agg(F.sum(F.when(upper, 0.0).otherwise(F.col("n"))).alias("low"), F.sum(F.when(upper, F.col("n")).otherwise(0.0)).alias("high"))
    run = running_sums(blocks, [F.col("bit").asc(), F.col("block").asc(), F.col("a").asc()], {"low": "run"}).withColumn("below", F.col("run") - F.col("low"))
    per_block = run.groupBy("bit", "block").agg((F.sum(F.col("high") * F.col("below")) - F.sum("high") * F.min("below")).alias("c"))
    pairs = lambda t: F.col(t) * (F.col(t) - 1) / 2
    ties = lambda c, k: cells.groupBy(*c).agg(F.sum("n").alias("t")).agg(F.coalesce(F.sum(pairs("t")), F.lit(0.0)).alias(k))
    one = per_block.agg(F.sum("c").alias("c")).crossJoin(cells.agg(F.sum("n").alias("n")))
    for c, k in ((["a"], "ta"), (["b"], "tb"), (["a", "b"], "tab")):
        one = one.crossJoin(ties(c, k))
    untied = pairs("n") - F.col("ta") - F.col("tb") + F.col("tab")
    scale = F.sqrt((pairs("n") - F.col("ta")) * (pairs("n") - F.col("tb")))
    return one.select(((2 * F.col("c") - untied) / F.nullif(scale, F.lit(0.0))).alias("tau"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) of all ordered pairs, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*[F.corr(_f64(a), _f64(b)).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def _sides(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    c, g = _f64(column), F.col(group)
    out = []
    for k, value in (("a", a), ("b", b)):
        x = F.when(g == value, c)
        out += [F.count(x).alias(f"n{k}"), F.avg(x).alias(f"m{k}"), F.var_samp(x).alias(f"v{k}")]
    return df.agg(*out)


def t_test_welch(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """statistic, df, p_value of the two-sided test that two groups have one mean."""
    s = _sides(df, column, group, a, b)
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    got = s.select(((F.col("ma") - F.col("mb")) / F.sqrt(qa + qb)).alias("statistic"), ((qa + qb) * (qa + qb) / (qa * qa / (F.col("na") - 1) + qb * qb / (F.col("nb") - 1))).alias("df"))
    return got.withColumn("p_value", special.t_two_sided(F.col("statistic"), F.col("df")))


def t_test_one_sample(df: DataFrame, column: str, mean: float) -> DataFrame:
    c = _f64(column)
    got = df.agg(((F.avg(c) - mean) / (F.stddev_samp(c) / F.sqrt(F.count(c)))).alias("statistic"), (F.count(c) - 1).cast("double").alias("df"))
    return got.withColumn("p_value", special.t_two_sided(F.col("statistic"), F.col("df")))


def anova(df: DataFrame, column: str, group: str) -> DataFrame:
    """statistic (F), df_between, df_within, p_value, eta_squared and omega_squared of one-way analysis of variance."""
    c = _f64(column)
    groups = df.groupBy(group).agg(F.count(c).alias("n"), F.sum(c).alias("s"), F.sum(c * c).alias("q"))
    one = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    correction = F.col("s") * F.col("s") / F.col("n")
    one = one.select((F.col("k") - 1).cast("double").alias("df_between"), (F.col("n") - F.col("k")).cast("double").alias("df_within"), (F.col("b") - correction).alias("between"), (F.col("q") - F.col("b")).alias("within"))
    within = F.col("within") / F.col("df_within")
    got = one.select("df_between", "df_within", ((F.col("between") / F.col("df_between")) / within).alias("statistic"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"), ((F.col("between") - F.col("df_between") * within) / (F.col("between") + F.col("within") + within)).alias("omega_squared"))
    return got.withColumn("p_value", special.f_upper(F.col("statistic"), F.col("df_between"), F.col("df_within")))


def chi_square(df: DataFrame, column: str, expected: dict | None = None) -> DataFrame:
    """statistic, df, p_value and Cohen's w of the counts of column against expected shares, or against equal shares of all
    its values."""
    if expected is None:
        one = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).cast("double").alias("k"), (F.sum(F.col("n") * F.col("n")) * F.count(F.lit(1))).alias("q"))
        got = one.select((F.col("q") / F.col("all") - F.col("all")).alias("statistic"), (F.col("k") - 1).alias("df"), F.sqrt(F.col("q") / (F.col("all") * F.col("all")) - 1).alias("w"))
        return got.withColumn("p_value", special.chi2_upper(F.col("statistic"), F.col("df")))
    total = sum(expected.values())
    shares = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(v / total))])
    counts = df.filter(F.col(column).isin(list(expected))).groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.withColumn("share", shares[F.col(column)]).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n") / F.col("share")).alias("q"))
    got = one.select((F.col("q") / F.col("all") - F.col("all")).alias("statistic"), F.lit(float(len(expected) - 1)).alias("df"), F.sqrt(F.col("q") / (F.col("all") * F.col("all")) - 1).alias("w"))
    return got.withColumn("p_value", special.chi2_upper(F.col("statistic"), F.col("df")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, df, p_value of independence, and Cramer's V."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, columns = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in ("a", "b"))
    sums = cells.join(rows, "a").join(columns, "b").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    got = sums.select((F.col("all") * (F.col("q") - 1)).alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double").alias("df"), F.sqrt((F.col("q") - 1) / F.least(F.col("ka") - 1, F.col("kb") - 1)).alias("cramers_v"))
    return got.withColumn("p_value", special.chi2_upper(F.col("statistic"), F.col("df")))


def mann_whitney(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """u (of group a) and z by the normal approximation, with p_value."""
    g = F.col(group)
    both = df.filter(g.isin(a, b)).select(_f64(column).alias("x"), (g == a).alias("mine")).filter("x IS NOT NULL")
    counts = both.groupBy("x").agg(F.count_if("mine").alias("a"), F.count(F.lit(1)).alias("n"))
    one = counts.join(mean_ranks(both, "x"), "x").agg(F.sum(F.col("rank") * F.col("a")).alias("ra"), F.sum("a").cast("double").alias("na"), F.sum(F.col("n") - F.col("a")).cast("double").alias("nb"))
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    got = one.select(u.alias("u"), ((u - F.col("na") * F.col("nb") / 2) / F.sqrt(F.col("na") * F.col("nb") * (F.col("na") + F.col("nb") + 1) / 12)).alias("z"))
    return got.withColumn("p_value", special.normal_two_sided(F.col("z")))


def ks_test(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """statistic: the largest gap of the two groups' empirical distributions."""
    g = F.col(group)
    values = df.filter(g.isin(a, b)).groupBy(_f64(column).alias("x")).agg(F.count_if(g == a).alias("a"), F.count_if(g == b).alias("b"))
    run = running_sums(values, [F.col("x").asc()], {"a": "ra", "b": "rb"}).crossJoin(values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    return run.agg(F.max(F.abs(F.col("ra") / F.col("na") - F.col("rb") / F.col("nb"))).alias("statistic"))


def effect_sizes(df: DataFrame, column: str, group: str, a, b) -> DataFrame:
    """Cohen's d (pooled std), Hedges' g, Glass's delta (std of b)."""
    s = _sides(df, column, group, a, b)
    freedom = F.col("na") + F.col("nb") - 2
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / freedom)
    d = (F.col("ma") - F.col("mb")) / pooled
    return s.select(d.alias("cohens_d"), (d * (1 - 3 / (4 * freedom - 1))).alias("hedges_g"), ((F.col("ma") - F.col("mb")) / F.sqrt("vb")).alias("glass_delta"))


def point_biserial(df: DataFrame, flag: Column, column: str) -> DataFrame:
    return df.agg(F.corr(flag.cast("double"), _f64(column)).alias("r"))


def ci_mean(df: DataFrame, column: str, z: float = 1.959963984540054, by: Sequence[str] = ()) -> DataFrame:
    """mean and its interval at `z` standard errors."""
    c = _f64(column)
    half = z * F.stddev_samp(c) / F.sqrt(F.count(c))
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), (F.avg(c) - half).alias("low"), (F.avg(c) + half).alias("high"))


def ci_proportion(df: DataFrame, flag: Column, z: float = 1.959963984540054) -> DataFrame:
    p, n = F.avg(flag.cast("double")), F.count(F.lit(1))
    half = z * F.sqrt(p * (1 - p) / n)
    return df.agg(p.alias("p"), (p - half).alias("low"), (p + half).alias("high"))


def bonferroni(df: DataFrame, p: str, name: str = "adjusted") -> DataFrame:
    return df.crossJoin(df.agg(F.count(p).alias("_n"))).withColumn(name, F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")


def benjamini_hochberg(df: DataFrame, p: str, key: str, name: str = "adjusted") -> DataFrame:
    """Adjusted p-values: least of p * n / rank over the larger ones. A list of tests is small: one task ranks it."""
    w = Window.orderBy(p, key)
    scaled = df.withColumn("_q", F.col(p) * F.count(p).over(Window.partitionBy()) / F.row_number().over(w))
    return scaled.withColumn(name, F.least(F.min("_q").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_q")


def ols(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept and r2 of a line."""
    a, b = _f64(y), _f64(x)
    return df.groupBy(*by).agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2"))


def ols_many(df: DataFrame, y: str, xs: Sequence[str]) -> list[float]:
    """Intercept and coefficients by the normal equations: one aggregate of sums, then a small solve on the driver."""
    import numpy as np

    columns = [F.lit(1.0), *[_f64(x) for x in xs]]
    k = len(columns)
    sums = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(c * _f64(y)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    return np.linalg.solve(a, np.array([sums[f"b{i}"] for i in range(k)])).tolist()


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(time, at_risk, events, survival, std_error) at each time with an event. Rows are reduced to distinct times first."""
    times = df.groupBy(*by, F.col(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    w = Window.partitionBy(*by).orderBy("time")
    at_risk = F.sum("n").over(w.rowsBetween(0, Window.unboundedFollowing))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    known = times.withColumn("at_risk", at_risk).filter("events > 0")
    term = F.col("events") / F.nullif(F.col("at_risk") * (F.col("at_risk") - F.col("events")), F.lit(0))
    known = known.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(run)).withColumn("_g", F.sum(term).over(run))
    return known.select(*by, "time", "at_risk", "events", "survival", (F.col("survival") * F.sqrt("_g")).alias("std_error"))


def log_rank(df: DataFrame, time: str, event: str, group: str, a) -> DataFrame:
    """statistic and p_value: group a's events against those expected, over the times of both groups."""
    mine = F.col(group) == a
    times = df.groupBy(F.col(time).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(mine).alias("na"), F.sum(F.col(event).cast("long")).alias("d"), F.sum(F.when(mine, F.col(event).cast("long")).otherwise(0)).alias("da"))
    risk = running_sums(times, [F.col("t").desc()], {"n": "r", "na": "ra"}).filter("d > 0")
    share = F.col("ra") / F.col("r")
    one = risk.agg(F.sum("da").alias("o"), F.sum(F.col("d") * share).alias("e"), F.sum(F.when(F.col("r") > 1, F.col("d") * share * (1 - share) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)).alias("v"))
    got = one.select(((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("v")).alias("statistic"))
    return got.withColumn("p_value", special.chi2_upper(F.col("statistic"), F.lit(1.0)))
