"""Walk-forward backtests as joins and windows.

Between trades a weight drifts with its price, so a segment opened at place e with weights w is worth
sum(w * P(t) / P(e)) at t: no day-by-day loop is needed. A failed trade holds what is there, which extends the segment
before it; a failed opening trade is an equal weighting. Costs scale wealth once at each trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry
from .sampler import Schedule

_run = ("experiment", "strategy")


def effective(weights: DataFrame, trades: DataFrame) -> DataFrame:
    """Targets that are traded, with execution and the end of their segment: failed ones after the first drop out."""
    joined = weights.join(trades.select("experiment", "k", "execution"), ["experiment", "k"])
    equal = 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*_run, "k"))
    filled = joined.withColumn("status", F.when(F.col("w").isNull(), "fallback").otherwise("ok")).withColumn("w", F.when(F.col("w").isNull() & (F.col("k") == 0), equal).otherwise(F.col("w")))
    kept = filled.filter("w is not null")
    return kept.withColumn("until", F.lead("execution").over(Window.partitionBy(*_run, "asset").orderBy("k")))


def segments(targets: DataFrame, windows: DataFrame, schedule: Schedule) -> DataFrame:
    """experiment, strategy, k, asset, pos, date, g (part of the wealth of 1 put in at the segment's start), v (its sum).

    A segment runs from its trade to the next one, both included.
    """
    t = targets.select(*_run, "k", "asset", "w", "execution", F.coalesce("until", F.lit(schedule.window)).alias("until"))
    joined = t.join(windows.select("experiment", "asset", "pos", "date", "price"), ["experiment", "asset"]).filter("pos between execution and until")
    own = Window.partitionBy(*_run, "k", "asset").orderBy("pos")
    grown = joined.withColumn("g", F.col("w") * F.col("price") / F.first("price").over(own))
    return grown.withColumn("v", F.sum("g").over(Window.partitionBy(*_run, "k", "pos"))).select(*_run, "k", "asset", "execution", "until", "pos", "date", "g", "v")


def daily_weights(seg: DataFrame, schedule: Schedule) -> DataFrame:
    """Weights held after any trade at each close, from the opening trade on."""
    held = (F.col("pos") < F.col("until")) | (F.col("pos") == schedule.window)
    return seg.filter(held).select(*_run, "asset", "pos", "date", F.try_divide("g", "v").alias("weight"))


def trade_list(targets: DataFrame, seg: DataFrame, weights: DataFrame, trades: DataFrame, universe: DataFrame) -> DataFrame:
    """experiment, strategy, k, execution, turnover, cost (at 1x), status of every scheduled trade."""
    before = seg.filter("pos = until").select(*_run, "asset", F.col("until").alias("execution"), F.try_divide("g", "v").alias("drifted"))
    moved = targets.join(before, [*_run, "asset", "execution"], "left").join(universe.select("asset", "cost_bp"), "asset", "left")
    size = F.abs(F.col("w") - F.coalesce("drifted", F.lit(0.0)))
    # a missing cost must not pass as free
    bp = F.when(F.col("cost_bp").isNull(), F.raise_error(F.concat(F.lit("no cost for "), "asset"))).otherwise(F.col("cost_bp"))
    done = moved.groupBy(*_run, "k").agg(F.sum(size).alias("turnover"), (F.sum(size * bp) / 1e4).alias("cost"), F.max("status").alias("status"))
    every = weights.select(*_run, "k").distinct().join(trades.select("experiment", "k", "execution", "formation"), ["experiment", "k"])
    return every.join(done, [*_run, "k"], "left").select(*_run, "k", "formation", "execution", F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("status", F.lit("fallback")).alias("status"))


def failures(weights: DataFrame) -> DataFrame:
    """experiment, strategy, k, error, fallback of each failed trade."""
    bad = weights.filter("error is not null").groupBy(*_run, "k").agg(F.first("error").alias("error"))
    return bad.withColumn("fallback", F.when(F.col("k") == 0, "equal weights").otherwise("held weights"))


def daily_returns(seg: DataFrame, traded: DataFrame, schedule: Schedule, multiples: dict[str, float]) -> DataFrame:
    """experiment, strategy, basis, pos, date, ret over the evaluation: gross less costs at each multiple.

    A trade's cost comes off at its close; the opening trade's off the first day after it.
    """
    v = seg.select(*_run, "k", "pos", "date", "execution", "v").distinct()
    gross = v.withColumn("gross", F.try_divide(F.col("v"), F.lag("v").over(Window.partitionBy(*_run, "k").orderBy("pos"))) - 1).filter("pos > execution")
    at = F.when(F.col("k") == 0, F.lit(schedule.estimation + 1)).otherwise(F.col("execution"))
    charged = traded.select(*_run, at.alias("pos"), "cost").groupBy(*_run, "pos").agg(F.collect_list("cost").alias("costs"))
    days = gross.select(*_run, "pos", "date", "gross").join(charged, [*_run, "pos"], "left")
    bases = F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), F.lit(m).alias("multiple")) for b, m in multiples.items()))).alias("b")
    left = F.aggregate(F.coalesce("costs", F.expr("cast(array() as array<double>)")), F.lit(1.0), lambda acc, c: acc * (1 - c * F.col("b.multiple")))
    return days.select(*_run, "pos", "date", "gross", "costs", bases).select(*_run, "b.basis", "pos", "date", (left * (1 + F.col("gross")) - 1).alias("ret"))


def turnover(traded: DataFrame, schedule: Schedule) -> DataFrame:
    """Two-way turnover a year, the opening trade excluded."""
    return traded.groupBy(*_run).agg((F.sum(F.when(F.col("k") > 0, F.col("turnover")).otherwise(0.0)) * schedule.periods / schedule.evaluation).alias("turnover"), F.sum("cost").alias("total_cost"))


def wealth(returns: DataFrame) -> DataFrame:
    """Growth of 1 at each close."""
    grown = carry.running(returns, (*_run, "basis"), "pos", F.year("date"), grown=carry.total(F.log1p("ret")))
    return grown.withColumn("wealth", F.exp("grown")).drop("grown")


def fixed_mix(windows: DataFrame, weights: DataFrame, schedule: Schedule) -> DataFrame:
    """Returns of weights that are the same in every period, with no drift between trades."""
    first = weights.filter("k = 0 and w is not null").select(*_run, "asset", "w")
    inside = windows.filter(F.col("pos") > schedule.estimation)
    return inside.join(first, ["experiment", "asset"]).groupBy(*_run, "pos", "date").agg(F.sum(F.col("w") * F.col("s")).alias("ret"))


def design(exp_asset: DataFrame, cal: DataFrame, schedule: Schedule) -> DataFrame:
    """One row: experiments, distinct subsets, median and largest number of assets two experiments share, and the share
    of the sessions from the first anchor on that some evaluation covers."""
    sets = exp_asset.groupBy("experiment").agg(F.sort_array(F.collect_list("asset")).alias("assets"))  # one subset each
    base = sets.agg(F.count(F.lit(1)).alias("experiments"), F.count_distinct("assets").alias("subsets"))
    pairs = exp_asset.alias("a").join(exp_asset.alias("b"), F.col("a.asset") == F.col("b.asset")).filter("a.experiment < b.experiment").groupBy("a.experiment", "b.experiment").agg(F.count(F.lit(1)).alias("shared"))
    counted = pairs.groupBy("shared").agg(F.count(F.lit(1)).alias("n"))
    # pairs that share nothing meet in no join
    apart = base.select((F.col("experiments") * (F.col("experiments") - 1) / 2).alias("all"))
    none = apart.crossJoin(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))).select(F.lit(0).cast("long").alias("shared"), (F.col("all") - F.col("met")).cast("long").alias("n"))  # one row each
    shared = counted.unionByName(none).filter("n > 0").agg(F.expr("percentile(shared, 0.5, n)").alias("median_shared"), F.max("shared").alias("max_shared"))
    anchors = exp_asset.select("experiment", "anchor").distinct()
    inside = anchors.select(F.explode(F.sequence(F.col("anchor") + schedule.estimation + 1, F.col("anchor") + schedule.window)).alias("session")).distinct()
    known = cal.join(inside.withColumn("covered", F.lit(1.0)), "session", "left").crossJoin(F.broadcast(anchors.agg(F.min("anchor").alias("first"))))  # one row
    coverage = known.filter("session >= first").agg(F.avg(F.coalesce("covered", F.lit(0.0))).alias("coverage"))
    return base.crossJoin(shared).crossJoin(coverage)  # one row each


def inclusion(exp_asset: DataFrame, universe: DataFrame) -> DataFrame:
    """How often each asset is drawn, first, upper-middle and last anchor."""
    drawn = exp_asset.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("anchor")).alias("anchors"))
    joined = universe.select("asset", "sector").join(drawn, "asset", "left")
    middle: Column = F.try_element_at("anchors", (F.floor(F.size("anchors") / 2) + 1).cast("int"))
    return joined.select("asset", "sector", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.try_element_at("anchors", F.lit(1)).alias("first"), middle.alias("middle"), F.try_element_at("anchors", F.lit(-1)).alias("last"))


def flat_fee_returns(seg: DataFrame, traded: DataFrame, fee: float) -> DataFrame:
    """Returns less turnover times a flat fee, taken off the first return after each trade (the second implementation's rule)."""
    v = seg.select(*_run, "k", "pos", "date", "execution", "v").distinct()
    gross = v.withColumn("gross", F.try_divide(F.col("v"), F.lag("v").over(Window.partitionBy(*_run, "k").orderBy("pos"))) - 1).filter("pos > execution")
    charged = traded.select(*_run, (F.col("execution") + 1).alias("pos"), (F.col("turnover") * fee).alias("charge"))
    return gross.join(charged, [*_run, "pos"], "left").select(*_run, "pos", "date", (F.col("gross") - F.coalesce("charge", F.lit(0.0))).alias("ret"))


def one_way_turnover(traded: DataFrame, returns: DataFrame) -> DataFrame:
    """Half the turnover after the opening trade, a year of 365 days between the first and the last return."""
    span = returns.groupBy(*_run).agg((F.datediff(F.max("date"), F.min("date")) / 365.0).alias("years"))
    moved = traded.groupBy(*_run).agg((F.sum(F.when(F.col("k") > 0, F.col("turnover")).otherwise(0.0)) / 2).alias("moved"))
    return moved.join(span, [*_run]).select(*_run, F.try_divide("moved", "years").alias("turnover"))


def benchmark_leg(windows: DataFrame, benchmark: DataFrame, schedule: Schedule) -> DataFrame:
    """experiment, pos, date, ret: the benchmark's return (date, s) on each date that an experiment is evaluated on, null where it has none."""
    dates = windows.filter(F.col("pos") > schedule.estimation).select("experiment", "pos", "date").distinct()
    return dates.join(benchmark.select("date", F.col("s").alias("ret")), "date", "left").select("experiment", "pos", "date", "ret")


def identity(exp_asset: DataFrame, trades: DataFrame) -> DataFrame:
    """Weights of portfolios that each hold one asset of an experiment from its first trade on."""
    a = exp_asset.select("experiment", F.concat(F.lit("BH "), "asset").alias("strategy"), F.col("asset").alias("own"))
    rows = a.join(exp_asset.select("experiment", "asset"), "experiment").join(trades.select("experiment", "k").filter("k = 0"), "experiment")
    return rows.select("experiment", "strategy", "k", "asset", F.when(F.col("asset") == F.col("own"), 1.0).otherwise(0.0).alias("w"), F.lit(None).cast("string").alias("error"))
