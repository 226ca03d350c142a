"""Weights of each strategy at each trade: relational ones in SQL, solved ones by a grouped map over windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import fanned, written
from . import dependence, eigen, kernels
from .sampler import Schedule

SOLVED = ("GMV", "MV", "MSR", "ERC", "MDP", "MDC")
SCHEMA = "experiment int, strategy string, k int, asset string, w double, error string"


def estimation_rows(windows: DataFrame, trades: DataFrame) -> DataFrame:
    """experiment, k, asset, pos, s: the returns behind each trade."""
    w = windows.filter("pos >= 1").select("experiment", "asset", "pos", "s")
    return w.join(trades.select("experiment", "k", "first", "formation"), "experiment").filter("pos between first and formation")


def estimates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("experiment", "k", "asset").agg(F.avg("s").alias("mean"), F.stddev_samp("s").alias("sd"), F.count("s").alias("n"))


def pair_covariances(rows: DataFrame) -> DataFrame:
    """experiment, k, a, b, cov, corr of all ordered pairs of an experiment's assets."""
    key = ("experiment", "k")
    return dependence.moments(dependence.pair_sums(rows, key, "pos", "asset", "s"), key).select(*key, "a", "b", "cov", "corr")


def relational(est: DataFrame) -> DataFrame:
    """EW, IV, QNT (best fifth by mean return), GMRP (the best one)."""
    by = Window.partitionBy("experiment", "k")
    n, rank = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(F.desc("mean"), "asset"))
    fifth = F.greatest(F.floor(n / 5), F.lit(1))
    wide = est.select(
        "experiment", "k", "asset",
        (1.0 / n).alias("EW"),
        F.try_divide(F.try_divide(F.lit(1.0), F.col("sd")), F.sum(F.try_divide(F.lit(1.0), F.col("sd"))).over(by)).alias("IV"),
        F.when(rank <= fifth, 1.0 / fifth).otherwise(0.0).alias("QNT"),
        F.when(rank == 1, 1.0).otherwise(0.0).alias("GMRP"),
    )
    long = F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("w")) for s in ("EW", "IV", "QNT", "GMRP")))).alias("t")
    return wide.select("experiment", "k", "asset", long).select("experiment", "t.strategy", "k", "asset", "t.w", F.lit(None).cast("string").alias("error"))


def solved(rows: DataFrame, schedule: Schedule, rf: DataFrame | None = None, names: tuple[str, ...] = SOLVED, aversion: float = 3.0, shrink: bool = False, custom: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """Weights by solvers, one task group for each (experiment, k); a failure is a row with its error and null weights.

    rf: experiment, pos, rf (per period). custom: more strategies, functions of a T x n window.
    """
    joined = rows if rf is None else rows.join(rf, ["experiment", "pos"], "left")
    periods = schedule.periods

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="pos", columns="asset", values="s").sort_index()
        r, assets = wide.to_numpy(), list(wide.columns)
        rate = float(pdf.drop_duplicates("pos")["rf"].mean() * periods) if "rf" in pdf else 0.0
        made = {name: (lambda name=name: kernels.window_weights(r, name, periods, rate, aversion, shrink)) for name in names}
        made |= {name: (lambda f=f: f(r)) for name, f in (custom or {}).items()}
        w, errors = np.full((len(made), len(assets)), np.nan), []
        for row, weights in zip(w, made.values()):
            try:
                row[:] = weights()
                errors.append(None)
            except (ValueError, np.linalg.LinAlgError) as e:
                errors.append(f"{type(e).__name__}: {e}")
        n = len(assets)
        return pd.DataFrame({"experiment": pdf["experiment"].iloc[0], "strategy": np.repeat(list(made), n), "k": pdf["k"].iloc[0], "asset": assets * len(made), "w": w.ravel(), "error": np.repeat(np.array(errors, object), n)})

    return validated(fanned(joined, "experiment", "k").groupBy("experiment", "k").applyInPandas(run, SCHEMA))


def validated(weights: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Weights made exactly long-only and fully invested; those that aren't within tol fail, with null weights."""
    by = Window.partitionBy("experiment", "strategy", "k")
    finite = F.col("w").isNotNull() & ~F.isnan("w") & (F.abs("w") < float("inf"))
    least, total = F.min("w").over(by), F.sum("w").over(by)
    found = (
        F.when(~F.every(finite).over(by), F.lit("ValueError: weights are not finite"))
        .when(least < -tol, F.format_string("ValueError: a weight of %.2e is short", least))
        .when(F.abs(total - 1) > tol, F.format_string("ValueError: weights sum to %.6f", total))
    )
    checked = weights.withColumn("error", F.coalesce("error", found)).withColumn("w", F.greatest("w", F.lit(0.0)))
    return checked.withColumn("w", F.when(F.col("error").isNull(), F.col("w") / F.sum("w").over(by)))


def risk_contributions(weights: DataFrame, covs: DataFrame) -> DataFrame:
    """experiment, strategy, k, asset, share of the portfolio's variance."""
    w = weights.filter("w is not null").select("experiment", "k", "strategy", "asset", "w")
    pairs = w.withColumnRenamed("asset", "a").join(covs, ["experiment", "k", "a"]).join(w.select("experiment", "k", "strategy", F.col("asset").alias("b"), F.col("w").alias("wb")), ["experiment", "k", "strategy", "b"])
    part = pairs.groupBy("experiment", "k", "strategy", "a").agg(F.sum(F.col("w") * F.col("wb") * F.col("cov")).alias("part"))
    return part.select("experiment", "strategy", "k", F.col("a").alias("asset"), (F.col("part") / F.sum("part").over(Window.partitionBy("experiment", "k", "strategy"))).alias("share"))


def distances(weights: DataFrame) -> DataFrame:
    """Mean over trades of half the absolute weight difference of each pair of strategies, and how often they coincide."""
    a = weights.filter("w is not null").select("experiment", "k", "asset", F.col("strategy").alias("a"), F.col("w").alias("wa"))
    b = weights.filter("w is not null").select("experiment", "k", "asset", F.col("strategy").alias("b"), F.col("w").alias("wb"))
    d = a.join(b, ["experiment", "k", "asset"]).filter("a < b").groupBy("a", "b", "experiment", "k").agg((F.sum(F.abs(F.col("wa") - F.col("wb"))) / 2).alias("d"))
    return d.groupBy("a", "b").agg(F.avg("d").alias("distance"), F.avg(F.when(F.col("d") < 1e-4, 1.0).otherwise(0.0)).alias("coincide"))


def quintiles(est: DataFrame) -> DataFrame:
    """Best fifth (rounded) by mean, by mean over variance and by mean over deviation, equally weighted."""
    by = Window.partitionBy("experiment", "k")
    n = F.count(F.lit(1)).over(by)
    size = F.greatest(F.rint(n / 5.0), F.lit(1.0))
    scores = {"mean": F.col("mean"), "mean_var": F.try_divide(F.col("mean"), F.col("sd") * F.col("sd")), "mean_sd": F.try_divide(F.col("mean"), F.col("sd"))}
    ranked = est.select("experiment", "k", "asset", size.alias("size"), *(F.row_number().over(by.orderBy(F.desc(c), "asset")).alias(s) for s, c in scores.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(f"QNT {s}").alias("strategy"), F.when(F.col(s) <= F.col("size"), 1 / F.col("size")).otherwise(0.0).alias("w")) for s in scores))).alias("t")
    return ranked.select("experiment", "k", "asset", rows).select("experiment", "t.strategy", "k", "asset", "t.w", F.lit(None).cast("string").alias("error"))


def conditioning(rows: DataFrame) -> DataFrame:
    """Condition number of the correlations, largest correlation and its pair of each estimation window."""
    corr = written(pair_covariances(rows))
    ends = eigen.extremes(fanned(eigen.matrices(corr, ("experiment", "k"), "corr"), "experiment", "k"))
    most = corr.filter("a < b").groupBy("experiment", "k").agg(F.max("corr").alias("max_corr"), F.max_by(F.concat_ws("/", "a", "b"), "corr").alias("pair"))
    return ends.join(most, ["experiment", "k"]).select("experiment", "k", F.try_divide("largest", "smallest").alias("condition"), "max_corr", "pair")


def shrinkage(rows: DataFrame) -> DataFrame:
    """Ledoit-Wolf intensity towards constant correlation of each estimation window, from moments of standardised returns."""
    by = Window.partitionBy("experiment", "k", "asset")
    z = rows.select("experiment", "k", "asset", "pos", F.var_pop("s").over(by).alias("v"), ((F.col("s") - F.avg("s").over(by)) / F.stddev_pop("s").over(by)).alias("z"))
    a, b = (z.select("experiment", "k", "pos", F.col("asset").alias(c), F.col("v").alias(f"v{c}"), F.col("z").alias(f"z{c}")) for c in "ab")
    cross = F.col("za") * F.col("zb")
    m = a.join(b, ["experiment", "k", "pos"]).groupBy("experiment", "k", "a", "b").agg(
        (F.first("va") * F.first("vb")).alias("scale"), F.avg(cross).alias("r"), F.avg(cross * cross).alias("both"), F.avg(F.col("za") * F.col("za") * cross).alias("third"), F.count(F.lit(1)).alias("t"),
    )
    off = F.col("a") != F.col("b")
    m = m.withColumn("mean", F.avg(F.when(off, F.col("r"))).over(Window.partitionBy("experiment", "k")))
    missed = F.sum(F.when(off, F.col("scale") * (F.col("mean") - F.col("r")) * (F.col("mean") - F.col("r"))))
    noise = F.sum(F.col("scale") * (F.col("both") - F.col("r") * F.col("r")))
    common = F.sum(F.when(off, F.col("mean") * F.col("scale") * (F.col("third") - F.col("r"))).otherwise(F.col("scale") * (F.col("both") - 1)))
    share = F.coalesce(F.try_divide(noise - common, missed * F.first("t")), F.lit(0.0))
    return m.groupBy("experiment", "k").agg(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("intensity"))


def optimality(weights: DataFrame, covs: DataFrame) -> DataFrame:
    """For each (experiment, strategy, k): sum, smallest weight, portfolio variance and that of equal weights."""
    w = weights.filter("w is not null").select("experiment", "k", "strategy", "asset", "w")
    b = w.select("experiment", "k", "strategy", F.col("asset").alias("b"), F.col("w").alias("wb"))
    pairs = w.withColumnRenamed("asset", "a").join(covs, ["experiment", "k", "a"]).join(b, ["experiment", "k", "strategy", "b"])
    var = pairs.groupBy("experiment", "strategy", "k").agg(F.sum(F.col("w") * F.col("wb") * F.col("cov")).alias("variance"), F.avg("cov").alias("equal_variance"))
    return var.join(w.groupBy("experiment", "strategy", "k").agg(F.sum("w").alias("total"), F.min("w").alias("least")), ["experiment", "strategy", "k"])


def kkt(weights: DataFrame, est: DataFrame, covs: DataFrame, periods: int, aversion: float = 3.0) -> DataFrame:
    """Whether the weights of GMV, MV, MDP, MDC and ERC meet the conditions of their optimum, by (experiment, strategy, k).

    A quadratic program's gradient, over the coefficient of its budget, is least and equal on what is held; ERC's risk
    shares are equal. Of the scale-free strategies the weights before normalisation are meant, which are in proportion.
    """
    key = ["experiment", "k"]
    w = weights.filter("w is not null").join(est.select(*key, "asset", "mean", "sd"), [*key, "asset"])
    other = w.select("strategy", *key, F.col("asset").alias("b"), F.col("w").alias("wb"), F.col("sd").alias("sdb"))
    pairs = w.withColumnRenamed("asset", "a").join(covs.select(*key, "a", "b", "cov"), [*key, "a"]).join(other, ["strategy", *key, "b"])
    corr = F.col("cov") / (F.col("sd") * F.col("sdb"))
    pull = pairs.groupBy("strategy", *key, "a").agg(F.first("w").alias("w"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.sum(F.col("wb") * F.col("cov")).alias("cw"), F.sum(F.col("wb") * corr).alias("rw"))
    gradient = (
        F.when(F.col("strategy") == "GMV", F.col("cw") * periods)
        .when(F.col("strategy") == "MV", (F.col("cw") * aversion - F.col("mean")) * periods)
        .when(F.col("strategy") == "MDP", F.col("cw") / F.col("sd"))
        .when(F.col("strategy") == "MDC", F.col("rw"))
        .when(F.col("strategy") == "ERC", F.col("cw") * F.col("w"))
    )
    g = pull.withColumn("g", gradient).groupBy("experiment", "strategy", "k").agg(
        F.sum("w").alias("total"), F.min("w").alias("least"), F.min("g").alias("floor"), F.max(F.abs("g")).alias("size"), F.max(F.when(F.col("w") > 1e-9, F.col("g"))).alias("top"),
    )
    return g.select("experiment", "strategy", "k", (F.abs(F.col("total") - 1) < 1e-9).alias("invested"), (F.col("least") >= 0).alias("long_only"), (F.col("top") - F.col("floor") <= 1e-6 * F.greatest("size", F.lit(1e-12))).alias("optimal"))


def gap_by_correlation(weights: DataFrame, covs: DataFrame) -> DataFrame:
    """One row: mean distance of IV and ERC weights, and its correlation over windows with the spread of correlations."""
    wide = weights.filter(F.col("strategy").isin("IV", "ERC")).groupBy("experiment", "k", "asset").agg(*(F.max(F.when(F.col("strategy") == s, F.col("w"))).alias(s) for s in ("IV", "ERC")))
    gap = wide.groupBy("experiment", "k").agg((F.sum(F.abs(F.col("IV") - F.col("ERC"))) / 2).alias("gap"))
    own = covs.filter("a <> b").groupBy("experiment", "k", "a").agg(F.avg("corr").alias("mean")).groupBy("experiment", "k").agg(F.stddev_samp("mean").alias("spread"))
    return gap.join(own, ["experiment", "k"]).agg(F.count(F.lit(1)).alias("windows"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.corr("gap", "spread").alias("corr"))
