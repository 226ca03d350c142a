"""The hand-computed ledger, and what a backtest must never do."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import backtest, sampler, strategies

#: The hand-computed ledger.
LEDGER = sampler.Schedule(estimation=2, evaluation=4, every=2, lookback=2, lag=1, periods=252)
A = [100, 100, 100, 110, 132, 118.8, 124.74]
B = [100, 100, 100, 95, 95, 104.5, 104.5]


@pytest.fixture(scope="module")
def ledger(spark):
    day = dt.date(2020, 1, 1)
    rows = [(k + 1, day + dt.timedelta(k), a, float(p)) for a, ps in (("A", A), ("B", B)) for k, p in enumerate(ps)]
    panel = spark.createDataFrame(rows, "session int, date date, asset string, price double")
    exp = spark.createDataFrame([(0, 1, "A"), (0, 1, "B")], "experiment int, anchor int, asset string")
    universe = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "asset string, cost_bp double")
    return panel, exp, universe


def run(ledger, weights=None, universe=None, multiples=None):
    panel, exp, costs = ledger
    windows = sampler.experiment_windows(exp, panel, LEDGER)
    trades = sampler.rebalances(exp, LEDGER)
    if weights is None:
        weights = strategies.relational(strategies.estimates(strategies.estimation_rows(windows, trades))).filter("strategy = 'EW'")
    targets = backtest.effective(weights, trades)
    seg = backtest.segments(targets, windows, LEDGER)
    traded = backtest.trade_list(targets, seg, weights, trades, universe or costs)
    return seg, traded, backtest.daily_returns(seg, traded, LEDGER, multiples or {"gross": 0.0, "net": 1.0})


def by_basis(returns, basis):
    return [r["ret"] for r in returns.filter(F.col("basis") == basis).orderBy("pos").collect()]


def test_ledger(ledger):
    _, traded, returns = run(ledger)
    gross, net = by_basis(returns, "gross"), by_basis(returns, "net")
    assert np.allclose(gross, [0.025, 0.11 / 1.025, 0, 0.0225])
    assert abs(np.prod(1 + np.array(gross)) - 1.1605375) < 1e-12
    drift = 0.66 / 1.135 - 0.5
    t = traded.orderBy("k").collect()
    assert [round(x["turnover"], 12) for x in t] == [1.0, round(2 * drift, 12)]
    assert np.allclose([x["cost"] for x in t], [15e-4, drift * 30e-4])
    assert abs(np.prod(1 + np.array(net)) - 1.1585133756) < 1e-9


def test_no_cost_is_gross(ledger):
    *_, returns = run(ledger, multiples={"gross": 0.0, "free": 0.0})
    assert by_basis(returns, "gross") == by_basis(returns, "free")


def test_unknown_cost_raises(ledger, spark):
    with pytest.raises(Exception, match="no cost for B"):
        run(ledger, universe=spark.createDataFrame([("A", 10.0)], "asset string, cost_bp double"))[1].collect()


def test_failures_hold_or_open_equally(ledger, spark):
    rows = [(0, "F", 0, "A", None, "x"), (0, "F", 0, "B", None, "x"), (0, "F", 1, "A", None, "y"), (0, "F", 1, "B", None, "y")]
    w = spark.createDataFrame(rows, strategies.SCHEMA)
    _, traded, returns = run(ledger, w)
    t = traded.orderBy("k").collect()
    assert [x["status"] for x in t] == ["fallback", "fallback"] and t[0]["turnover"] == 1.0 and t[1]["turnover"] == 0.0
    assert abs(np.prod(1 + np.array(by_basis(returns, "gross"))) - (1.2474 + 1.045) / 2) < 1e-12
    assert [r["fallback"] for r in backtest.failures(w).orderBy("k").collect()] == ["equal weights", "held weights"]


def test_schedule_places(ledger):
    rows = sampler.rebalances(ledger[1], sampler.Schedule()).orderBy("k").collect()
    assert [r["execution"] for r in rows] == [504, 567, 630, 693]
    assert [r["formation"] - r["first"] + 1 for r in rows] == [503, 252, 252, 252]


def test_guard(ledger):
    panel, exp, _ = ledger
    trades = sampler.rebalances(exp, LEDGER)
    rows = strategies.estimation_rows(sampler.experiment_windows(exp, panel, LEDGER), trades)
    known = sampler.with_last_used(trades, rows)
    sampler.guard(known)
    assert sampler.guarded(known).count() == trades.count()
    for name, value in (("formation", F.col("execution")), ("last_used", F.col("formation") + 1), ("last_used", F.lit(None).cast("int")), ("earns", F.col("execution")), ("first", F.col("formation") + 1)):
        bad = known.withColumn(name, value)
        with pytest.raises(sampler.LookAhead):
            sampler.guard(bad)
        with pytest.raises(Exception, match="LookAhead"):
            sampler.guarded(bad).collect()


def test_the_future_leaves_past_weights_alone(ledger):
    panel, exp, _ = ledger
    trades = sampler.rebalances(exp, LEDGER)

    def weights(p):
        rows = strategies.estimation_rows(sampler.experiment_windows(exp, p, LEDGER), trades)
        return sorted(map(tuple, strategies.relational(strategies.estimates(rows)).filter("k = 0 and strategy <> 'IV'").select("strategy", "asset", "w").collect()))

    assert weights(panel) == weights(panel.withColumn("price", F.when(F.col("session") > 3, F.col("price") * 3).otherwise(F.col("price"))))


def test_sampler(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(40)]
    assets = [(f"{g}{k}", g) for g in "XY" for k in range(4)]
    panel = spark.createDataFrame([(k + 1, d, a, None if (k, a) == (5, "X0") else 1.0) for a, _ in assets for k, d in enumerate(days)], "session int, date date, asset string, price double")
    universe = spark.createDataFrame(assets, "asset string, sector string")
    s = sampler.Schedule(8, 4, 2, 4)
    draw = lambda **k: sorted(map(tuple, sampler.sample_experiments(panel, universe, s, 15, **k).collect()))
    rows = draw()
    assert rows == draw() != draw(seed=2)
    by = {}
    for e, anchor, asset in rows:
        by.setdefault((e, anchor), []).append(asset)
    assert len(by) == 15 and all(sum(a[0] == "X" for a in v) == 2 == len(v) - 2 for v in by.values())
    assert len({(anchor, tuple(sorted(v))) for (_, anchor), v in by.items()}) == 15
    assert all(not ("X0" in v and anchor <= 6 <= anchor + 12) for (_, anchor), v in by.items())
    loose = draw(stratified=False, each=4, distinct=False)
    assert len({e for e, *_ in loose}) == 15 and len(loose) == 60
    with pytest.raises(ValueError):
        sampler.subset_rule({g: [a for a, x in assets if x == g] for g in "XY"}, 3)


def test_too_few_windows_raise(spark):
    """Further tries are made until the experiments are there; where they can't be, it fails."""
    sizes = {4: 3, 16: 12}
    made = lambda tries: spark.range(sizes.get(tries, 0)).selectExpr("cast(id AS int) AS experiment", "0 AS anchor", "'a' AS asset")
    assert sampler.filled(made, 10, 16).count() == 12
    with pytest.raises(sampler.TooFewWindows):
        sampler.filled(made, 13, 16)
