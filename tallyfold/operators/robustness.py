"""Robustness: cost ranking, splits by crisis, sector and asset, concentration and exposure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .performance import _share, against, win_rates


def cost_ranking(metrics: DataFrame) -> DataFrame:
    """Rank by median Sharpe (ties share the best) on each basis, with the win rate."""
    m = metrics.groupBy("strategy", "basis").agg(F.median("sharpe").alias("median_sharpe"))
    ranked = m.withColumn("rank", F.rank().over(Window.partitionBy("basis").orderBy(F.desc("median_sharpe"))))
    return ranked.join(win_rates(metrics), ["strategy", "basis"], "left").select("strategy", "basis", "rank", "median_sharpe", "beats_pct")


def rank_gaps(metrics: DataFrame) -> DataFrame:
    """Distance of each strategy's median Sharpe to the next better one."""
    m = metrics.groupBy("strategy", "basis").agg(F.median("sharpe").alias("median_sharpe"))
    return m.withColumn("gap", F.lag("median_sharpe").over(Window.partitionBy("basis").orderBy(F.desc("median_sharpe"), "strategy")) - F.col("median_sharpe"))


def crisis_groups(windows: DataFrame, estimation: int, lo: str, hi: str) -> DataFrame:
    """experiment, crisis: whether the dates lo..hi touch the evaluation, else the estimation, else neither."""
    days = windows.select("experiment", "pos", "date").distinct()
    inside = F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    span = days.groupBy("experiment").agg(
        F.min(F.when(F.col("pos") > estimation, F.col("date"))).alias("e0"), F.max("date").alias("e1"),
        F.min(F.when(F.col("pos") >= 1, F.col("date"))).alias("s0"), F.max(F.when(F.col("pos") <= estimation, F.col("date"))).alias("s1"), F.count_if(inside).alias("n_inside"),
    )
    low, high = F.lit(lo).cast("date"), F.lit(hi).cast("date")
    return span.select("experiment", F.when((F.col("e0") <= high) & (F.col("e1") >= low), "evaluation").when((F.col("s0") <= high) & (F.col("s1") >= low), "estimation only").otherwise("neither").alias("crisis"))


def split_table(metrics: DataFrame, groups: DataFrame, column: str, benchmark: str = "EW") -> DataFrame:
    """Paired results within each group of experiments, and over all of them."""
    j = against(metrics, benchmark).join(groups, "experiment")
    both = j.withColumn("grp", F.col(column)).unionByName(j.withColumn("grp", F.lit("All")))
    return both.groupBy("basis", "grp", "strategy").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("sharpe") - F.col("b_sharpe")).alias("d_sharpe"), _share(F.col("sharpe") > F.col("b_sharpe")).alias("beats_pct"), _share(F.col("ann_vol") < F.col("b_ann_vol")).alias("lower_vol_pct"))


def asset_effect(metrics: DataFrame, exp_asset: DataFrame, universe: DataFrame, basis: str = "net") -> DataFrame:
    """Share of experiments better than the benchmark with the asset held, less without it, in points."""
    better = against(metrics.filter(F.col("basis") == basis)).select("experiment", "strategy", F.when(F.col("sharpe") > F.col("b_sharpe"), 100.0).otherwise(0.0).alias("better"))
    total = better.groupBy("strategy").agg(F.sum("better").alias("s"), F.count(F.lit(1)).alias("n"))
    held = better.join(exp_asset.select("experiment", "asset"), "experiment").groupBy("strategy", "asset").agg(F.sum("better").alias("hs"), F.count(F.lit(1)).alias("hn"))
    j = held.join(total, "strategy")
    return j.select("strategy", "asset", F.col("hn").alias("n_held"), (F.col("hs") / F.col("hn") - F.try_divide(F.col("s") - F.col("hs"), (F.col("n") - F.col("hn")).cast("double"))).alias("effect_pp"))


def noise_yardstick(effects: DataFrame, n_experiments: int, rates: DataFrame) -> DataFrame:
    """Two standard errors of the difference of two shares at the strategy's overall rate, and which effects exceed it."""
    p = F.col("beats_pct") / 100
    v = p * (1 - p)
    j = effects.join(rates, "strategy")
    band = 200 * F.sqrt(v / F.col("n_held") + F.try_divide(v, n_experiments - F.col("n_held").cast("double")))
    return j.select("strategy", "asset", "effect_pp", band.alias("band_pp"), (F.abs("effect_pp") > band).alias("beyond"))


def top_effects(effects: DataFrame, k: int = 3) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc(F.abs("effect_pp")), "asset"))
    return effects.withColumn("nth", nth).filter(F.col("nth") <= k)


def concentration(weights: DataFrame) -> DataFrame:
    """Mean largest weight, mean effective number of assets, share of closes almost all in one asset."""
    day = weights.groupBy("experiment", "strategy", "pos").agg(F.max("weight").alias("top"), (1 / F.sum(F.col("weight") * F.col("weight"))).alias("eff"))
    return day.groupBy("experiment", "strategy").agg(F.avg("top").alias("max_weight"), F.avg("eff").alias("effective_n"), F.avg(F.when(F.col("top") > 0.99, 1.0).otherwise(0.0)).alias("single_asset"))


def concentration_table(per_run: DataFrame) -> DataFrame:
    return per_run.groupBy("strategy").agg((F.avg("max_weight") * 100).alias("max_weight_pct"), F.avg("effective_n").alias("effective_n"), F.min("effective_n").alias("lowest_n"), (F.avg("single_asset") * 100).alias("single_pct"))


def exposure(weights: DataFrame, values: DataFrame) -> DataFrame:
    """Mean over closes of the weighted sum of a value of each asset (asset, value)."""
    day = weights.join(values, "asset").groupBy("experiment", "strategy", "pos").agg(F.sum(F.col("weight") * F.col("value")).alias("x"))
    return day.groupBy("experiment", "strategy").agg(F.avg("x").alias("exposure"))


def holdings(exp_asset: DataFrame, assets: list[str]) -> DataFrame:
    """One boolean column for each asset: whether the experiment holds it."""
    return exp_asset.groupBy("experiment").pivot("asset", assets).agg(F.count(F.lit(1))).select("experiment", *(F.col(f"`{a}`").isNotNull().alias(a) for a in assets))


def max_pair_correlation(windows: DataFrame, estimation: int, lookback: int) -> DataFrame:
    """Largest correlation of two of an experiment's assets over the lookback that ends the estimation."""
    r = windows.filter((F.col("pos") > estimation - lookback) & (F.col("pos") <= estimation)).select("experiment", "pos", "asset", "s")
    b = r.select("experiment", "pos", F.col("asset").alias("b"), F.col("s").alias("y"))
    pairs = r.join(b, ["experiment", "pos"]).filter("asset < b").groupBy("experiment", "asset", "b").agg(F.corr("s", "y").alias("corr"))
    return pairs.groupBy("experiment").agg(F.max("corr").alias("max_corr"), F.max_by(F.concat_ws("/", "asset", "b"), "corr").alias("pair"))


def stock_association(metrics: DataFrame, exp_asset: DataFrame, basis: str = "net", least: int = 5) -> DataFrame:
    """For each strategy and asset with enough appearances: win rate and mean Sharpe difference with the asset."""
    better = against(metrics.filter(F.col("basis") == basis)).select("experiment", "strategy", (F.col("sharpe") - F.col("b_sharpe")).alias("d"))
    j = better.join(exp_asset.select("experiment", "asset"), "experiment").groupBy("strategy", "asset").agg(F.count(F.lit(1)).alias("n"), _share(F.col("d") > 0).alias("win_pct"), F.avg("d").alias("mean_d"))
    return j.filter(F.col("n") >= least)


def period_association(metrics: DataFrame, windows: DataFrame, estimation: int, basis: str = "net") -> DataFrame:
    """Paired Sharpe differences by the year in which the evaluation starts."""
    years = windows.filter(F.col("pos") == estimation + 1).groupBy("experiment").agg(F.year(F.min("date")).alias("year"))
    j = against(metrics.filter(F.col("basis") == basis)).join(years, "experiment").withColumn("d", F.col("sharpe") - F.col("b_sharpe"))
    return j.groupBy("strategy", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("wins"), F.avg("d").alias("mean_d"), F.median("d").alias("median_d"))


def association_differences(metrics: DataFrame, exp_asset: DataFrame, basis: str = "net", least: int = 5) -> DataFrame:
    """For each strategy and asset held in enough runs: win rate and mean Sharpe difference with it, without it, and the gaps."""
    d = against(metrics.filter(F.col("basis") == basis)).select("experiment", "strategy", (F.col("sharpe") - F.col("b_sharpe")).alias("d")).withColumn("win", F.when(F.col("d") > 0, 100.0).otherwise(0.0))
    total = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("all_n"), F.sum("win").alias("all_win"), F.sum("d").alias("all_d"))
    held = d.join(exp_asset.select("experiment", "asset"), "experiment").groupBy("strategy", "asset").agg(F.count(F.lit(1)).alias("n"), F.sum("win").alias("win"), F.sum("d").alias("d"))
    j = held.filter(F.col("n") >= least).join(total, "strategy")
    rest = F.col("all_n") - F.col("n")
    j = j.select("strategy", "asset", "n", (F.col("win") / F.col("n")).alias("win_with"), F.try_divide(F.col("all_win") - F.col("win"), rest).alias("win_without"), (F.col("d") / F.col("n")).alias("d_with"), F.try_divide(F.col("all_d") - F.col("d"), rest).alias("d_without"))
    return j.withColumn("win_gap", F.col("win_with") - F.col("win_without")).withColumn("d_gap", F.col("d_with") - F.col("d_without"))
