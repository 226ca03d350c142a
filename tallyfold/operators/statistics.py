"""Distribution and dependence statistics of returns, one row per asset, in single passes over long tables.

Input: date, asset and a value column without nulls to count.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf, student5_quantile

TRANSFORMS: dict[str, Column] = {"raw": F.col, "absolute": F.abs, "squared": lambda c: F.col(c) * F.col(c)}


def describe(r: DataFrame, value: str = "x") -> DataFrame:
    """Moments (skewness and excess kurtosis with divisor n), quantile skew and Jarque-Bera."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    base = r.groupBy("asset").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), q.alias("q"),
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    tail = (F.col("q")[2] + F.col("q")[0] - 2 * F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0])
    n = F.col("n")
    return base.select(
        "asset", "n", "mean", "sd", "min", "max", "skew", "kurt", tail.alias("q_skew"), jb.alias("jb"), F.exp(-jb / 2).alias("jb_p"),
        F.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3))).alias("skew_se"),
    )


def tail_quantiles(r: DataFrame, value: str = "x", levels: tuple[float, ...] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    """Empirical and normal quantile at each level, and the ratio of their distances from the mean."""
    base = r.groupBy("asset").agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), *(F.percentile(value, F.lit(p)).alias(f"q{k}") for k, p in enumerate(levels)))
    rows = F.explode(F.array(*(F.struct(F.lit(p).alias("level"), F.lit(NormalDist().inv_cdf(p)).alias("z"), F.col(f"q{k}").alias("empirical")) for k, p in enumerate(levels))))
    normal = F.col("m") + F.col("z") * F.col("s")
    return base.select("asset", "m", "s", rows.alias("t")).select("asset", "m", "s", "t.*").select("asset", "level", "empirical", normal.alias("normal"), ((F.col("empirical") - F.col("m")) / (normal - F.col("m"))).alias("ratio"))


def exceedances(r: DataFrame, value: str = "x", sigmas: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Days beyond k standard deviations, and how many a normal would have."""
    w = Window.partitionBy("asset")
    z = F.abs(F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)
    base = r.filter(F.col(value).isNotNull()).withColumn("z", z).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("z") > k).alias(f"c{k}") for k in sigmas))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("sigma"), F.col(f"c{k}").alias("observed"), (F.col("n") * (2 * NormalDist().cdf(-k))).alias("expected")) for k in sigmas)))
    return base.select("asset", rows.alias("t")).select("asset", "t.*")


def lag_moments(r: DataFrame, lags: int, value: str = "x", transforms: tuple[str, ...] = ("raw",)) -> DataFrame:
    """asset, transform, lag, n, and sums over t of a demeaned transform d: ss of squares, cross of d_t d_(t-lag), cross2 of its square.

    One sort of each series serves all lags and transforms: a window hands every value the lags values before it, and
    what is spread out from there is summed before it is shuffled.
    """
    w = Window.partitionBy("asset")
    base = r.filter(F.col(value).isNotNull()).select("date", "asset", *(TRANSFORMS[t](value).alias(t) for t in transforms))
    d = base.select("date", "asset", F.count(F.lit(1)).over(w).alias("n"), *((F.col(t) - F.avg(t).over(w)).alias(t) for t in transforms))
    now = F.array(*(F.col(t) for t in transforms))
    before = F.reverse(F.collect_list(now).over(w.orderBy("date").rowsBetween(-lags, -1)))
    # lag 0, for the sum of squares, stands first
    lined = d.select("asset", "n", now.alias("now"), before.alias("before"))
    spread = lined.select("asset", "n", "now", F.posexplode(F.concat(F.array("now"), "before")).alias("lag", "then"))
    sums = [f(F.pow(F.col("now")[k] * F.col("then")[k], F.lit(float(p)))).alias(f"{t}_{p}") for k, t in enumerate(transforms) for f, p in ((F.sum, 1), (F.sum, 2))]
    wide = spread.groupBy("asset", "n", "lag").agg(*sums)
    long = wide.select("asset", "n", "lag", F.explode(F.array(*(F.struct(F.lit(t).alias("transform"), F.col(f"{t}_1").alias("cross"), F.col(f"{t}_2").alias("cross2")) for t in transforms))).alias("m")).select("asset", "n", "lag", "m.*")
    ss = F.max(F.when(F.col("lag") == 0, F.col("cross"))).over(Window.partitionBy("asset", "transform"))
    return long.withColumn("ss", ss).filter("lag > 0").select("asset", "transform", F.col("lag").cast("int").alias("lag"), "n", "ss", "cross", "cross2")


def acf(r: DataFrame, lags: int, value: str = "x") -> DataFrame:
    """Autocorrelation of raw, absolute and squared values with the iid band and the robust band of the raw ones."""
    m = lag_moments(r, lags, value, tuple(TRANSFORMS))
    gamma = F.col("ss") / F.col("n")
    robust = 1.96 * F.sqrt(F.col("cross2") / (F.col("n") - F.col("lag")) / (gamma * gamma) / F.col("n"))
    of = lambda t, c: F.max(F.when(F.col("transform") == t, c))
    return m.groupBy("asset", "lag").agg(
        *(of(t, F.col("cross") / F.col("ss")).alias(t) for t in TRANSFORMS), of("raw", 1.96 / F.sqrt("n")).alias("band"), of("raw", robust).alias("robust_band")
    )


def robust_portmanteau(r: DataFrame, lags: tuple[int, ...], value: str = "x") -> DataFrame:
    """Heteroskedasticity-robust Q and its p at each number of lags."""
    m = lag_moments(r, max(lags), value)
    return _at_lags(m, lags, F.col("cross") * F.col("cross") / F.col("cross2")).drop("transform")


def ljung_box(r: DataFrame, lags: tuple[int, ...], value: str = "x") -> DataFrame:
    """Ljung-Box Q of raw, absolute and squared values and its p at each number of lags."""
    m = lag_moments(r, max(lags), value, tuple(TRANSFORMS))
    rho = F.col("cross") / F.col("ss")
    return _at_lags(m, lags, F.col("n") * (F.col("n") + 2) * rho * rho / (F.col("n") - F.col("lag")))


def _at_lags(m: DataFrame, lags: tuple[int, ...], term: Column) -> DataFrame:
    q = m.groupBy("asset", "transform").agg(*(F.sum(F.when(F.col("lag") <= k, term)).alias(f"q{k}") for k in lags))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("lags"), F.col(f"q{k}").alias("q"), chi2_sf(F.col(f"q{k}"), k).alias("p")) for k in lags)))
    return q.select("asset", "transform", rows.alias("t")).select("asset", "transform", "t.*")


def stress_sensitivity(r: DataFrame, lo: str, hi: str, value: str = "x") -> DataFrame:
    """Moments and Pearson lag-1 autocorrelation with and without the dates lo..hi."""
    inside = F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    both = r.select("*", F.lit("full").alias("sample")).unionByName(r.filter(~inside).select("*", F.lit("excluding").alias("sample")))
    lagged = both.filter(F.col(value).isNotNull()).withColumn("prev", F.lag(value).over(Window.partitionBy("asset", "sample").orderBy("date")))
    return lagged.groupBy("asset", "sample").agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), F.corr(value, "prev").alias("autocorr"))


def historical_var(r: DataFrame, value: str = "x", level: float = 0.05, threshold: float = -0.02) -> DataFrame:
    """Quantile loss as log and as simple return, the mean beyond it, and the share at or below a threshold."""
    base = r.groupBy("asset").agg(F.percentile(value, F.lit(level)).alias("q"), F.avg(F.when(F.col(value) <= threshold, 1.0).otherwise(0.0)).alias("ecdf"))
    beyond = r.join(base, "asset").filter(F.col(value) <= F.col("q")).groupBy("asset").agg(F.avg(value).alias("mean_beyond"))
    return base.join(beyond, "asset").select("asset", (-F.col("q")).alias("var_log"), (-F.expm1("q")).alias("var_simple"), (-F.col("mean_beyond")).alias("cvar"), "ecdf")


def autocovariance(r: DataFrame, lags: int, value: str = "x") -> DataFrame:
    """Autocovariance with divisor n."""
    return lag_moments(r, lags, value).select("asset", "lag", (F.col("cross") / F.col("n")).alias("autocov"))


def qq_points(r: DataFrame, value: str = "x") -> DataFrame:
    """Place, probability (i - 0.5) / n and standardised value of each observation in order."""
    w = Window.partitionBy("asset")
    z = (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)
    ranked = r.filter(F.col(value).isNotNull()).select("asset", F.row_number().over(w.orderBy(value, "date")).alias("i"), F.count(F.lit(1)).over(w).alias("n"), z.alias("z"))
    return ranked.select("asset", "i", ((F.col("i") - 0.5) / F.col("n")).alias("prob"), "z")


def histogram(r: DataFrame, value: str = "x") -> DataFrame:
    """Counts and densities of clip(1.5 sqrt(n), 20, 120) bins between each asset's extremes."""
    s = r.groupBy("asset").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).withColumn("bins", F.least(F.greatest(F.floor(1.5 * F.sqrt("n")), F.lit(20)), F.lit(120)).cast("int"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1).cast("int")
    return r.filter(F.col(value).isNotNull()).join(s, "asset").withColumn("bin", place).groupBy("asset", "bin", "n", "bins", "lo", "hi").agg(F.count(F.lit(1)).alias("c")).select("asset", "bin", "c", (F.col("c") / F.col("n") * F.col("bins") / (F.col("hi") - F.col("lo"))).alias("density"))


def box_stats(r: DataFrame, value: str = "x") -> DataFrame:
    """Quartiles and the furthest values within 1.5 times their distance."""
    q = r.groupBy("asset").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    return r.join(q, "asset").groupBy("asset").agg(F.first("q")[0].alias("q1"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("outliers"))


def with_student(points: DataFrame) -> DataFrame:
    """qq_points() with the quantile of Student's distribution of 5 degrees of freedom, plain and scaled to unit variance."""
    t = student5_quantile(F.col("prob"))
    return points.select("asset", "i", "z", t.alias("student"), (t * (3 / 5) ** 0.5).alias("unit_student"))


def white_noise(rows: DataFrame, label: str = "noise") -> DataFrame:
    """date, asset, x: standard normal noise on the rows (date, asset, session), by Box and Muller from a hash of label, asset and session."""
    h = F.md5(F.concat_ws(":", F.lit(label), F.col("asset"), F.col("session").cast("string")).cast("binary"))
    u, v = ((F.conv(F.substring(h, k, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for k in (1, 14))
    return rows.select("date", "asset", (F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)).alias("x"))
