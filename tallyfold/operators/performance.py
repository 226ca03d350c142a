"""Performance of each run and summaries across experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry
from .panel import block

CUSHION = 0.10
_run = ("experiment", "strategy", "basis")


def falls(returns: DataFrame) -> DataFrame:
    """returns with fall, the wealth of each run over the highest it had so far, 1 at the start, less 1."""
    path = carry.paths(returns, _run, "pos", F.year("date"), F.log1p("ret"))
    return path.withColumn("fall", F.expm1(F.col("grown") - F.greatest(F.lit(0.0), F.col("peak")))).drop("grown", "peak")


def run_metrics(returns: DataFrame, rf: DataFrame, periods: int) -> DataFrame:
    """Annualised return, volatility, Sharpe, Sortino, maximum drawdown, Calmar and Sterling of each run.

    returns: experiment, strategy, basis, pos, date, ret; rf: date, rf for a period.
    """
    e = F.col("ret") - F.col("rf")
    a = falls(returns).join(rf.select("date", "rf"), "date", "left").groupBy(*_run).agg(
        F.count("ret").alias("n"), F.sum(F.log1p("ret")).alias("grown"), F.stddev_samp("ret").alias("sd"),
        F.avg(e).alias("em"), F.stddev_samp(e).alias("es"), F.avg(F.pow(F.least(e, F.lit(0.0)), F.lit(2.0))).alias("ed"), F.least(F.min("fall"), F.lit(0.0)).alias("max_dd"),
    )
    year, root = float(periods), float(periods) ** 0.5
    grew = F.expm1(F.col("grown") * year / F.col("n"))
    return a.select(
        *_run, "n", grew.alias("ann_return"), (F.col("sd") * root).alias("ann_vol"),
        F.try_divide(F.col("em") * year, F.col("es") * root).alias("sharpe"),
        F.try_divide(F.col("em") * year, F.sqrt("ed") * root).alias("sortino"),
        "max_dd", F.try_divide(grew, F.abs("max_dd")).alias("calmar"), (grew / (F.abs("max_dd") + CUSHION)).alias("sterling"),
    )


def against(metrics: DataFrame, benchmark: str = "EW") -> DataFrame:
    """Each run beside the benchmark's of the same experiment and basis; the benchmark's own rows are left out."""
    b = metrics.filter(F.col("strategy") == benchmark).select("experiment", "basis", *(F.col(c).alias(f"b_{c}") for c in ("sharpe", "ann_return", "ann_vol", "max_dd")))
    return metrics.filter(F.col("strategy") != benchmark).join(b, ["experiment", "basis"])


def _share(condition: Column) -> Column:
    """Share of rows for which the condition holds; unknown counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100


def win_rates(metrics: DataFrame, benchmark: str = "EW") -> DataFrame:
    return against(metrics, benchmark).groupBy("strategy", "basis").agg(_share(F.col("sharpe") > F.col("b_sharpe")).alias("beats_pct"))


def headline(metrics: DataFrame) -> DataFrame:
    cols = ("ann_return", "ann_vol", "sharpe", "max_dd", "sterling")
    return metrics.groupBy("strategy", "basis").agg(*((F.median(c) * (100 if c in ("ann_return", "ann_vol", "max_dd") else 1)).alias(c) for c in cols))


def dispersion(metrics: DataFrame, metric: str = "sharpe") -> DataFrame:
    q = F.percentile(metric, F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    return metrics.groupBy("strategy", "basis").agg(q.alias("q")).select("strategy", "basis", F.col("q")[2].alias("median"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.col("q")[0].alias("p10"), F.col("q")[4].alias("p90"))


def cost_impact(metrics: DataFrame, low: str = "gross", high: str = "net") -> DataFrame:
    """Medians of both bases and of the differences of each experiment."""
    a = metrics.filter(F.col("basis") == low).select("experiment", "strategy", F.col("sharpe").alias("s0"), F.col("ann_return").alias("r0"))
    b = metrics.filter(F.col("basis") == high).select("experiment", "strategy", F.col("sharpe").alias("s1"), F.col("ann_return").alias("r1"))
    j = a.join(b, ["experiment", "strategy"])
    return j.groupBy("strategy").agg(F.median("s0").alias("sharpe_before"), F.median("s1").alias("sharpe_after"), F.median(F.col("s1") - F.col("s0")).alias("difference"), (F.median(F.col("r0") - F.col("r1")) * 1e4).alias("drag_bp"))


def paired(metrics: DataFrame, benchmark: str = "EW") -> DataFrame:
    """Medians of paired differences, and shares of experiments in which the strategy is better."""
    return against(metrics, benchmark).groupBy("strategy", "basis").agg(
        F.median(F.col("sharpe") - F.col("b_sharpe")).alias("d_sharpe"),
        _share(F.col("sharpe") > F.col("b_sharpe")).alias("beats_pct"),
        (F.median(F.col("ann_return") - F.col("b_ann_return")) * 100).alias("d_return_pp"),
        (F.median(F.col("ann_vol") - F.col("b_ann_vol")) * 100).alias("d_vol_pp"),
        _share(F.col("ann_vol") < F.col("b_ann_vol")).alias("lower_vol_pct"),
        (F.median(F.col("max_dd") - F.col("b_max_dd")) * 100).alias("d_dd_pp"),
        _share(F.col("max_dd") > F.col("b_max_dd")).alias("shallower_pct"),
    )


def representative(metrics: DataFrame) -> DataFrame:
    """The experiment of the lower median Sharpe of each strategy and basis."""
    w = Window.partitionBy("strategy", "basis")
    ranked = metrics.withColumn("nth", F.row_number().over(w.orderBy("sharpe", "experiment"))).withColumn("of", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("nth") == F.floor((F.col("of") - 1) / 2) + 1).select("strategy", "basis", "experiment", "sharpe")


def regimes(metrics: DataFrame, benchmark: str = "EW", basis: str = "net") -> DataFrame:
    """Experiments by the tercile of the benchmark's Sharpe: quantile edges, closed on the right."""
    own = metrics.filter((F.col("strategy") == benchmark) & (F.col("basis") == basis)).select("experiment", "sharpe")
    edges = own.agg(F.percentile("sharpe", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    return own.crossJoin(F.broadcast(edges)).select("experiment", "sharpe", F.when(F.col("sharpe") <= F.col("q")[0], "low").when(F.col("sharpe") <= F.col("q")[1], "middle").otherwise("high").alias("regime"))  # one row


def replication_metrics(returns: DataFrame, periods: int) -> DataFrame:
    """The second implementation's conventions: arithmetic return, positive drawdown, Sterling over the mean drawdown."""
    a = falls(returns).groupBy(*_run).agg(
        (F.avg("ret") * periods).alias("ann_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("ann_vol"), (-F.least(F.min("fall"), F.lit(0.0))).alias("max_dd"),
        F.avg(F.when(F.col("fall") < 0, F.col("fall"))).alias("mean_fall"), _share(F.col("ret") > 0).alias("win_pct"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
    )
    return a.select(*_run, "ann_return", "ann_vol", F.try_divide("ann_return", "ann_vol").alias("sharpe"), "max_dd", F.try_divide("ann_return", "max_dd").alias("calmar"), F.try_divide(F.col("ann_return"), -F.col("mean_fall")).alias("sterling"), "win_pct", "skew", "kurt")


def annual_table(panel: DataFrame, periods: int) -> DataFrame:
    """Arithmetic annual return, volatility and Sharpe of each asset. panel: asset, s."""
    a = panel.filter("s is not null").groupBy("asset").agg((F.avg("s") * periods).alias("ret"), (F.stddev_samp("s") * F.sqrt(F.lit(float(periods)))).alias("vol"))
    return a.withColumn("sharpe", F.try_divide("ret", "vol"))


def downside_table(panel: DataFrame, level: float = 0.05) -> DataFrame:
    """Semi-deviation over all rows, value at risk, the mean beyond it, and the drawdown of summed (not compounded) returns."""
    s = panel.filter("s is not null").select("asset", "session", "s")
    s = carry.paths(s, ("asset",), "session", block(), F.col("s")).withColumn("fall", F.col("peak") - F.col("grown"))
    s = s.join(s.groupBy("asset").agg(F.avg("s").alias("m")), "asset")
    a = s.groupBy("asset").agg(F.sqrt(F.avg(F.pow(F.least(F.col("s") - F.col("m"), F.lit(0.0)), F.lit(2.0)))).alias("semi_dev"), F.percentile("s", F.lit(level)).alias("q"), F.max("fall").alias("max_dd"))
    beyond = s.join(a.select("asset", "q"), "asset").filter("s <= q").groupBy("asset").agg((-F.avg("s")).alias("cvar"))
    return a.join(beyond, "asset").select("asset", "semi_dev", (-F.col("q")).alias("var"), "cvar", "max_dd")


def turnover_by(turnovers: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """Median turnover of each strategy within groups of experiments."""
    return turnovers.join(groups, "experiment").groupBy("strategy", column).agg(F.median("turnover").alias("turnover"), F.count(F.lit(1)).alias("n"))


#: Whether more of a metric is better.
HIGHER = {"ann_return": True, "ann_vol": False, "sharpe": True, "max_dd": False, "calmar": True, "sterling": True, "win_pct": True}


def benchmark_wins(metrics: DataFrame, benchmark: str = "EW", directions: dict[str, bool] = HIGHER) -> DataFrame:
    """Runs compared, mean difference and share of wins of each strategy and metric, rows without both values left out."""
    long = metrics.unpivot(["experiment", "strategy", "basis"], list(directions), "metric", "value")
    b = long.filter(F.col("strategy") == benchmark).select("experiment", "basis", "metric", F.col("value").alias("theirs"))
    j = long.filter(F.col("strategy") != benchmark).join(b, ["experiment", "basis", "metric"]).filter("value is not null and theirs is not null")
    sign = F.when(F.col("metric").isin(*(m for m, up in directions.items() if up)), 1.0).otherwise(-1.0)
    d = F.col("value") - F.col("theirs")
    return j.groupBy("strategy", "basis", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_d"), _share(d * sign > 0).alias("win_pct"))


#: The second implementation's metrics in the order of its table.
SECOND_METRICS = ("ann_return", "cum_return", "ann_vol", "sharpe", "sortino", "calmar", "sterling", "mean_dd", "max_dd", "win_pct", "skew", "kurt", "var95", "cvar95")
Z95 = -1.6448536269514729


def second_metrics(returns: DataFrame, periods: int) -> DataFrame:
    """The 14 metrics of the second implementation for each run, without a risk-free rate.

    Value at risk is the normal quantile at the run's mean and deviation, the conditional one the mean of what is below
    it (else the quantile); Calmar is over compounded growth; the win rate counts days that moved; skewness and kurtosis
    are the unbiased sample forms; the median calendar-year return stands beside them.
    """
    limits = returns.groupBy(*_run).agg((F.avg("ret") + F.lit(Z95) * F.stddev_samp("ret")).alias("limit"))
    path = falls(returns).join(limits, [*_run])
    year = float(periods)
    a = path.groupBy(*_run).agg(
        F.count("ret").cast("double").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.sum(F.log1p("ret")).alias("grown"),
        F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))).alias("down"), F.least(F.min("fall"), F.lit(0.0)).alias("worst"), F.avg(F.when(F.col("fall") < 0, F.col("fall"))).alias("mean_fall"),
        (100 * F.count_if(F.col("ret") > 0) / F.count_if(F.col("ret") != 0)).alias("win_pct"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"),
        (-F.first("limit")).alias("var95"), (-F.coalesce(F.avg(F.when(F.col("ret") < F.col("limit"), F.col("ret"))), F.first("limit"))).alias("cvar95"),
    )
    years = returns.groupBy(*_run, F.year("date").alias("year")).agg(F.expm1(F.sum(F.log1p("ret"))).alias("grown")).groupBy(*_run).agg(F.median("grown").alias("median_year"))
    n, ret = F.col("n"), F.col("m") * year
    made = a.select(
        *_run, ret.alias("ann_return"), F.expm1("grown").alias("cum_return"), (F.col("sd") * year**0.5).alias("ann_vol"), F.try_divide(F.col("m"), F.col("sd")).alias("s"),
        F.try_divide(F.col("m") * year**0.5, F.sqrt("down")).alias("sortino"), F.try_divide(F.expm1(F.col("grown") * year / n), -F.col("worst")).alias("calmar"),
        F.try_divide(ret, -F.col("mean_fall")).alias("sterling"), F.coalesce(-F.col("mean_fall"), F.lit(0.0)).alias("mean_dd"), (-F.col("worst")).alias("max_dd"), "win_pct",
        (F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"), "var95", "cvar95",
    )
    return made.withColumn("sharpe", F.col("s") * year**0.5).join(years, [*_run]).select(*_run, *SECOND_METRICS, "median_year")


def across_runs(metrics: DataFrame, names: tuple[str, ...] = SECOND_METRICS) -> DataFrame:
    """Mean and median of each metric over the runs of a strategy and basis, one row a metric."""
    long = metrics.unpivot(["experiment", "strategy", "basis"], list(names), "metric", "value")
    return long.groupBy("strategy", "basis", "metric").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


def win_table(wins: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """benchmark_wins() with a column for each metric."""
    return wins.groupBy("strategy", "basis").agg(*(F.max(F.when(F.col("metric") == m, F.col("win_pct"))).alias(m) for m in names))


def fee_cost(returns: DataFrame, free: str, fees: tuple[str, ...], periods: int) -> DataFrame:
    """Mean arithmetic annual return lost to each fee level against the free basis, one row a strategy."""
    a = returns.groupBy(*_run).agg((F.avg("ret") * periods).alias("a"))
    base = a.filter(F.col("basis") == free).select("experiment", "strategy", F.col("a").alias("best"))
    lost = a.join(base, ["experiment", "strategy"]).withColumn("lost", F.col("best") - F.col("a"))
    return lost.groupBy("strategy").agg(*(F.avg(F.when(F.col("basis") == f, F.col("lost"))).alias(f"cost_{f}") for f in fees))
