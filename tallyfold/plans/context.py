"""The panel, experiments and runs that the registered queries share, built lazily for one input folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, panel, performance, sampler, strategies
from ..sources import market
from ..sources.lineage import written

SCHEDULE = sampler.WEEKLY
BASES = {"gross": 0.0, "net": 1.0, "net_2x": 2.0}
N_EXPERIMENTS = 100
RELATIONAL = ("EW", "IV", "QNT")
BENCHMARK, REGION_BENCHMARK = "NATION_0", "ASIA"
STRESS = ("1998-02-15", "1998-05-15")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places (and no negative zero), whole numbers as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, 6) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(f.name))
    return df.select(*out)


class Lab:
    """Observations, experiments and their windows are written once; every branch of a query starts from those."""

    def __init__(self, spark: SparkSession, sf_dir: str, freq: str = "weekly", level: str = "nation", schedule: sampler.Schedule = SCHEDULE, days: DataFrame | None = None):
        self.spark, self.sf_dir, self.freq, self.level, self.schedule, self.days = spark, sf_dir, freq, level, schedule, days
        self.benchmark = REGION_BENCHMARK if level == "region" else BENCHMARK

    @cached_property
    def obs(self) -> DataFrame:
        return written(market.observations(self.spark, self.sf_dir, self.freq, level=self.level, days=self.days))

    @cached_property
    def universe(self) -> DataFrame:
        return market.universe(self.spark, self.sf_dir, self.level)

    @cached_property
    def cal(self) -> DataFrame:
        return panel.calendar(self.obs, self.benchmark if self.freq == "daily" else None)

    @cached_property
    def panel(self) -> DataFrame:
        return written(panel.align(self.obs, self.cal, self.universe))

    @cached_property
    def r(self) -> DataFrame:
        """date, asset, x: percent log returns that are there."""
        return panel.log_returns(self.panel).filter("r is not null").select("date", "asset", (F.col("r") * 100).alias("x"))

    @cached_property
    def rf(self) -> DataFrame:
        series = market.risk_free(self.spark, self.sf_dir, self.freq)
        return panel.align_series(series, self.cal, "rf_pct", None).select("session", "date", (F.col("rf_pct") / 100 / self.schedule.periods).alias("rf"))

    @cached_property
    def exp_asset(self) -> DataFrame:
        return sampler.filled(lambda tries: written(sampler.sample_experiments(self.panel, self.universe, self.schedule, N_EXPERIMENTS, tries=tries)), N_EXPERIMENTS)

    @cached_property
    def windows(self) -> DataFrame:
        return written(sampler.experiment_windows(self.exp_asset, self.panel, self.schedule))

    @cached_property
    def trades(self) -> DataFrame:
        return sampler.rebalances(self.exp_asset, self.schedule)

    @cached_property
    def checked_trades(self) -> DataFrame:
        return sampler.guarded(sampler.with_last_used(self.trades, self.rows))

    @cached_property
    def rows(self) -> DataFrame:
        return strategies.estimation_rows(self.windows, self.trades)

    @cached_property
    def relational(self) -> DataFrame:
        return strategies.relational(strategies.estimates(self.rows)).filter(F.col("strategy").isin(*RELATIONAL))

    @cached_property
    def solved(self) -> DataFrame:
        return self.solve()

    def solve(self, shrink: bool = False) -> DataFrame:
        """Weights of the solved strategies; shrink: from covariances shrunk to constant correlation."""
        rf = self.windows.select("experiment", "pos", "date").distinct().join(self.rf.select("date", "rf"), "date").drop("date")
        return strategies.solved(self.rows, self.schedule, rf, shrink=shrink)


class Runs:
    """What follows from a table of weights: segments, trades, returns and metrics."""

    def __init__(self, lab: Lab, weights: DataFrame, bases: dict[str, float] = BASES):
        self.lab, self.weights, self.bases = lab, weights, bases

    @cached_property
    def targets(self) -> DataFrame:
        return backtest.effective(self.weights, self.lab.checked_trades)

    @cached_property
    def segments(self) -> DataFrame:
        return written(backtest.segments(self.targets, self.lab.windows, self.lab.schedule))

    @cached_property
    def daily_weights(self) -> DataFrame:
        return backtest.daily_weights(self.segments, self.lab.schedule)

    @cached_property
    def traded(self) -> DataFrame:
        return backtest.trade_list(self.targets, self.segments, self.weights, self.lab.trades, self.lab.universe)

    @cached_property
    def returns(self) -> DataFrame:
        return backtest.daily_returns(self.segments, self.traded, self.lab.schedule, self.bases)

    @cached_property
    def metrics(self) -> DataFrame:
        return performance.run_metrics(written(self.returns), self.lab.rf, self.lab.schedule.periods)
