"""Alignment, bounded filling and the audit tables on a small panel."""

import datetime as dt

import pytest

from tallyfold.operators import panel, returns

DAYS = [dt.date(2024, 1, d) for d in range(1, 13)]


@pytest.fixture(scope="module")
def small(spark):
    full = [(d, "A", 100.0 + k, 10.0) for k, d in enumerate(DAYS)]
    gappy = [(d, "B", 50.0 + k, 5.0) for k, d in enumerate(DAYS) if k in (2, 3, 9, 10)]
    off = [(dt.date(2024, 1, 20), "B", 60.0, 1.0)]
    obs = spark.createDataFrame(full + gappy + off, "date date, asset string, price double, volume double")
    assets = spark.createDataFrame([("A",), ("B",)], "asset string")
    cal = panel.calendar(obs, "A")
    return obs, cal, panel.align(obs, cal, assets)


def test_fill_is_bounded_and_starts_at_the_first_price(small):
    b = [r["price"] for r in small[2].filter("asset = 'B'").orderBy("session").collect()]
    assert b == [None, None, 52.0, 53.0, 53.0, 53.0, 53.0, None, None, 59.0, 60.0, 60.0]


def test_audit(small):
    obs, cal, p = small
    assert {r["asset"]: r["filled"] for r in panel.fill_counts(p).collect()} == {"A": 0, "B": 4}
    gaps = panel.gap_islands(p).collect()
    assert [(g["asset"], g["gap_start"], g["gap_end"], g["sessions"]) for g in gaps] == [("B", DAYS[7], DAYS[8], 2)]
    assert {r["asset"]: r["longest"] for r in panel.longest_gap(p).collect()} == {"A": 0, "B": 5}
    assert [(r["asset"], r["dropped"]) for r in panel.off_calendar(obs, cal).collect()] == [("B", 1)]
    assert panel.first_complete(p).first()["first_date"] == DAYS[2]
    q = {r["asset"]: r for r in panel.quality(obs, cal, p).collect()}
    assert q["A"]["treatment"] == "None required"
    assert q["B"]["treatment"] == "1 off-calendar obs. dropped; 4 session(s) forward-filled; 2 left as NaN"


def test_one_missing_price_leaves_two_returns_missing(small):
    r = [x["r"] for x in panel.log_returns(small[2]).filter("asset = 'B'").orderBy("session").collect()]
    assert [v is None for v in r] == [True, True, True, False, False, False, False, True, True, True, False, False]


def test_interpolation_stays_inside(small):
    b = [r["price"] for r in panel.interpolate(small[2]).filter("asset = 'B'").orderBy("session").collect()]
    assert b[:3] == [None, None, 52.0] and b[4] == 54.0 and b[-1] is None


def test_periods_without_returns_are_null(small):
    weekly = returns.period_returns(small[2], "weekly").filter("asset = 'B'").orderBy("date").collect()
    assert weekly[0]["log_r"] is not None and weekly[0]["date"].weekday() == 4


def test_prices_as_traded_and_adjusted_again(spark, small, monkeypatch):
    """A 2-for-1 split and a dividend of 10 % of the price before, by hand; blocks of few sessions."""
    monkeypatch.setattr(panel, "BLOCK", 4)
    rows = [(k + 1, d, "A", p and float(p)) for k, (d, p) in enumerate(zip(DAYS, (10, 11, 12, 13, 14, 15, 16, 17, 18, None, 20, 21)))]
    prices = spark.createDataFrame(rows, "session int, date date, asset string, price double")
    acts = spark.createDataFrame([(DAYS[0], "A", 0.5, 4.0), (DAYS[3], "A", 0.1, 0.0), (DAYS[6], "A", 0.0, 2.0), (DAYS[9], "A", 0.2, 3.0)], "date date, asset string, income double, split double")
    traded = {r["session"]: r for r in panel.unadjusted(prices, acts).collect()}
    assert set(traded) == set(range(1, 13)) - {10}
    assert [round(traded[k]["price"], 9) for k in (1, 3, 4, 6, 7, 12)] == [round(x, 9) for x in (10 / 0.45, 12 / 0.45, 13 / 0.5, 15 / 0.5, 16, 21)]
    assert round(traded[4]["dividend"], 9) == round(0.1 * 12 / 0.45, 9) and traded[7]["split"] == 2.0
    # an action on the first price, or on a date without one, does nothing
    assert sum(r["dividend"] != 0 for r in traded.values()) == 1 and sum(r["split"] != 0 for r in traded.values()) == 1
    again = {r["session"]: r["price"] for r in panel.adjusted(panel.unadjusted(prices, acts)).collect()}
    assert all(abs(again[k] - p) < 1e-9 for k, _, _, p in rows if p is not None)
