"""Tests of normality as columns: order statistics are ranks, normal scores a function of the rank, the rest sums.

Each series is ranked once and summed once; nothing of it is collected. r: date, asset and a value column; rows without
a value are left out. Series with fewer than MIN_N values or without variance have null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import half_log_tail, normal_quantile, normal_sf

MIN_N = 12
#: Royston's (1995) polynomials in 1 / sqrt(n) of the two largest coefficients, without their last terms, and
#: in log n of the mean and the log of the spread of log(1 - W).
LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
CENTRE = (0.0038915, -0.083751, -0.31082, -1.5861)
SPREAD = (0.0030302, -0.082676, -0.4803)
#: D'Agostino and Stephens' (1986) approximation of p, exp(a + b s + c s^2) from a least value of s on, or 1 less that.
PIECES = ((0.6, (1.2937, -5.709, 0.0186), False), (0.34, (0.9177, -4.279, -1.38), False), (0.2, (-8.318, 42.796, -59.938), True), (None, (-13.436, 101.14, -223.73), True))
CERTAIN = 153.467


def _polynomial(x: Column, coefficients: tuple[float, ...], end: Column | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out if end is None else out * x + end


def _score(i: Column, n: Column) -> Column:
    return normal_quantile((i - 0.375) / (n + 0.25))


def ranked(r: DataFrame, value: str = "x") -> DataFrame:
    """asset, x, i (place in order), n, mean, sd and var (divisor n) of each value."""
    base = r.filter(F.col(value).isNotNull())
    whole = base.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_pop(value).alias("var"))
    placed = base.select("asset", F.col(value).alias("x"), F.row_number().over(Window.partitionBy("asset").orderBy(value, "date")).alias("i"))
    return placed.join(whole.filter((F.col("n") >= MIN_N) & (F.col("var") > 0)), "asset")


def anderson_darling_p(a: Column) -> Column:
    """p of the statistic adjusted for n."""
    value = F.when(a >= CERTAIN, 0.0)
    for least, (c0, c1, c2), rising in PIECES:
        tail = F.exp(F.lit(c0) + F.lit(c1) * a + F.lit(c2) * a * a)
        tail = 1 - tail if rising else tail
        value = value.when(a >= least, tail) if least is not None else value.otherwise(tail)
    return value


def with_kurtosis(sums: DataFrame) -> DataFrame:
    """sums (n, b2) with k_z, the statistic of the fourth standardised moment being a normal's (Anscombe and Glynn 1983)."""
    n = F.col("n")
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    skew = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    s, a, t = F.col("k_skew"), F.col("k_a"), F.col("k_t")
    # a column each: what is written out several times is computed several times
    sums = sums.withColumn("k_skew", skew).withColumn("k_a", 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s))))
    sums = sums.withColumn("k_t", (1 - 2 / a) / (1 + (F.col("b2") - mean) / F.sqrt(var) * F.sqrt(2 / (a - 4))))
    return sums.withColumn("k_z", (1 - 2 / (9 * a) - F.signum(t) * F.pow(F.abs(t), F.lit(1 / 3))) / F.sqrt(2 / (9 * a)))


def tests(r: DataFrame, value: str = "x") -> DataFrame:
    """asset, test, stat, p of Shapiro and Wilk, Anderson and Darling, and the kurtosis test, for each series."""
    n, i, z, score = F.col("n").cast("double"), F.col("i"), F.col("z"), F.col("score")
    x = ranked(r, value).withColumn("z", (F.col("x") - F.col("mean")) / F.col("sd")).withColumn("score", _score(i, n))
    x = x.withColumn("u", F.abs("z") / 2**0.5).withColumn("near", half_log_tail(F.col("u"))).withColumn("far", F.log1p(-F.exp("near")))
    below, above = F.when(z <= 0, F.col("near")).otherwise(F.col("far")), F.when(z >= 0, F.col("near")).otherwise(F.col("far"))
    sums = x.groupBy("asset", n.alias("n"), "mean", "var").agg(
        F.sum((2 * i - 1) * below + (2 * n - 2 * i + 1) * above).alias("tails"),
        F.sum(score * score).alias("mm"),
        # the two places at each end have coefficients of their own
        F.sum(F.when((i > 2) & (i < n - 1), score * F.col("x"))).alias("inner"),
        *(F.max(F.when(i == k, F.col("x"))).alias(f"low{k}") for k in (1, 2)),
        *(F.max(F.when(i == n - k + 1, F.col("x"))).alias(f"high{k}") for k in (1, 2)),
        F.max(F.when(i == n, score)).alias("m1"), F.max(F.when(i == n - 1, score)).alias("m2"),
        F.avg(F.pow(F.col("x") - F.col("mean"), F.lit(4.0))).alias("m4"),
    )
    n, mm, m1, m2, a1, a2 = (F.col(c) for c in ("n", "mm", "m1", "m2", "a1", "a2"))
    u = 1 / F.sqrt(n)
    sums = sums.withColumns({"a1": _polynomial(u, LAST, m1 / F.sqrt(mm)), "a2": _polynomial(u, NEXT, m2 / F.sqrt(mm))})
    phi = (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    b = F.col("inner") / F.sqrt(phi) + a1 * (F.col("high1") - F.col("low1")) + a2 * (F.col("high2") - F.col("low2"))
    sums = sums.withColumns({"b": b, "ad": -n - F.col("tails") / n, "b2": F.col("m4") / (F.col("var") * F.col("var"))})
    sums = sums.withColumn("w", F.col("b") * F.col("b") / (n * F.col("var")))
    v = F.log(n)
    sums = with_kurtosis(sums).withColumn("w_z", (F.log(1 - F.col("w")) - _polynomial(v, CENTRE)) / F.exp(_polynomial(v, SPREAD)))
    sums = sums.withColumn("ad_a", F.col("ad") * (1 + 0.75 / n + 2.25 / (n * n)))
    rows = {"shapiro": ("w", normal_sf(F.col("w_z"))), "anderson": ("ad", anderson_darling_p(F.col("ad_a"))), "kurtosis": ("k_z", 2 * normal_sf(F.abs("k_z")))}
    return sums.select("asset", F.inline(F.array(*(F.struct(F.lit(t).alias("test"), F.col(c).alias("stat"), p.alias("p")) for t, (c, p) in rows.items()))))
