"""Returns at several frequencies, rolling measures and wealth paths over long panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.market import period_end
from . import carry
from .panel import BLOCK, block, log_returns


def _by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("session")


def full_window(value: Column, over: Column, width: int) -> Column:
    """value over the trailing width rows, null until all of them are there."""
    trailing = _by_asset().rowsBetween(-(width - 1), Window.currentRow)
    return F.when(F.count(over).over(trailing) == width, value.over(trailing))


def period_returns(panel: DataFrame, freq: str) -> DataFrame:
    """date, asset, log_r, simple_r by period: the sum of what the period has, null if it has nothing."""
    # the calendar's first session, 1, has no return
    summed = log_returns(panel).filter("session > 1").groupBy(period_end(F.col("date"), freq).alias("date"), "asset").agg(F.sum("r").alias("log_r"))
    return summed.withColumn("simple_r", F.expm1("log_r"))


def simple_returns(panel: DataFrame) -> DataFrame:
    return carry.with_before(panel, ("asset",), "session", BLOCK, before=F.col("price")).withColumn("s", F.try_divide(F.col("price"), F.col("before")) - 1).drop("before")


def complete_periods(returns: DataFrame, last_day: str) -> DataFrame:
    """Percent returns without each asset's first period, nor a last one that ends after last_day."""
    numbered = returns.withColumn("nth", F.row_number().over(Window.partitionBy("asset").orderBy("date")))
    return numbered.filter((F.col("nth") > 1) & (F.col("date") <= F.lit(last_day).cast("date"))).select("date", "asset", (F.col("log_r") * 100).alias("r_pct"))


def rolling_vol(panel: DataFrame, width: int, periods: int) -> DataFrame:
    r = log_returns(panel)
    return r.select("date", "asset", (full_window(F.stddev_samp("r"), F.col("r"), width) * F.sqrt(F.lit(float(periods)))).alias("vol"))


def moving_averages(panel: DataFrame, short: int, long: int) -> DataFrame:
    return panel.select("date", "asset", full_window(F.avg("price"), F.col("price"), short).alias("sma_short"), full_window(F.avg("price"), F.col("price"), long).alias("sma_long"))


def normalised(panel: DataFrame) -> DataFrame:
    """Prices over those of the first date that all assets have."""
    complete = panel.withColumn("gap", F.count_if(F.col("price").isNull()).over(Window.partitionBy("date"))).filter("gap = 0")
    base = F.first("price").over(_by_asset().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return complete.select("date", "asset", (F.col("price") / base).alias("growth"))


def yearly(panel: DataFrame) -> DataFrame:
    """Compounded return of each calendar year."""
    s = simple_returns(panel).filter("s is not null")
    return s.groupBy("asset", F.year("date").alias("year")).agg((F.product(1 + F.col("s")) - 1).alias("year_return"))


def wealth_paths(panel: DataFrame) -> DataFrame:
    """Additive and compounded wealth of each asset."""
    s = simple_returns(panel).filter("s is not null").select("session", "date", "asset", "s")
    grown = carry.running(s, ("asset",), "session", block(), simple=carry.total(F.col("s")), logged=carry.total(F.log1p("s")))
    return grown.select("date", "asset", (1 + F.col("simple")).alias("additive"), F.exp("logged").alias("compounded"))


def split_rows(panel: DataFrame, share: float = 0.7) -> DataFrame:
    """The panel's return rows marked train or test by their place."""
    s = simple_returns(panel).filter("s is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    return s.select("date", "asset", "s", F.when(F.row_number().over(_by_asset()) <= F.rint(n * share), "train").otherwise("test").alias("part"))


def inventory(panel: DataFrame, freqs: tuple[str, ...] = ("weekly", "monthly")) -> DataFrame:
    """Periods, complete periods, first and last date at each frequency."""
    out = None
    for freq in freqs:
        by_date = period_returns(panel, freq).groupBy("date").agg(F.count_if(F.col("log_r").isNull()).alias("missing"))
        one = by_date.agg(F.lit(freq).alias("freq"), F.count(F.lit(1)).alias("periods"), F.count_if(F.col("missing") == 0).alias("complete"), F.min("date").alias("first"), F.max("date").alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


def without(returns: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows outside the dates lo..hi, both included in what goes."""
    return returns.filter(~F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def halves(returns: DataFrame) -> DataFrame:
    """Rows with half, 1 before an asset's middle row and 2 from it."""
    n = F.count(F.lit(1)).over(Window.partitionBy("asset"))
    place = F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1
    return returns.withColumn("half", F.when(place < F.floor(n / 2), 1).otherwise(2))
