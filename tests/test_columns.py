"""Carried windows, bootstrap, least squares, normality tests, variance folds and eigenvalues against NumPy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import distributions
from tallyfold.operators import bootstrap, carry, dependence, eigen, garch, normality, regression
from tallyfold.operators import volatility as v


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    return {"A": rng.standard_normal(700) * 1.3, "B": rng.standard_t(4, 333), "C": np.round(rng.standard_normal(61), 1), "flat": np.zeros(40), "short": np.array([1.0, 2.0, 4.0])}


@pytest.fixture(scope="module")
def r(spark, series):
    day = dt.date(2020, 1, 1)
    rows = [(day + dt.timedelta(days=3 * k), a, float(x)) for a, xs in series.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows + [(day, "empty", None)], "date date, asset string, x double").repartition(3).cache()


def by_asset(df, *cols):
    out = {}
    for row in df.collect():
        out.setdefault(row["asset"], []).append(tuple(row[c] for c in cols))
    return out


def test_running_measures_cross_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(k, t, None if rng.random() < 0.4 else float(rng.integers(-5, 6))) for k in "xyz" for t in range(97) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    measures = {"sum": carry.total(F.col("v")), "top": carry.highest(F.col("v")), "seen": carry.last_seen(F.col("v")), "before": carry.previous(F.col("v"))}
    got = carry.running(df, ("k",), "t", F.floor(F.col("t") / 7), **measures).collect()
    assert len(got) == len(rows)
    want = {}
    for k in "xyz":
        total = top = seen = before = None
        for _, t, x in sorted(r for r in rows if r[0] == k):
            prior = before
            before = x
            if x is not None:
                total, top, seen = (total or 0) + x, x if top is None else max(top, x), x
            want[k, t] = (total, top, seen, prior)
    assert {(g["k"], g["t"]): (g["sum"], g["top"], g["seen"], g["before"]) for g in got} == want


def test_paths_cross_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, None if rng.random() < 0.2 or t < 9 and k == "n" else float(rng.standard_normal())) for k in "mn" for t in range(60)]
    got = carry.paths(spark.createDataFrame(rows, "k string, t int, g double"), ("k",), "t", F.floor(F.col("t") / 8), F.col("g"))
    found = {(x["k"], x["t"]): (x["grown"], x["peak"]) for x in got.collect()}
    for k in "mn":
        grown = peak = None
        for _, t, g in (x for x in rows if x[0] == k):
            if g is not None:
                grown = (grown or 0) + g
                peak = grown if peak is None else max(peak, grown)
            assert found[k, t] == (pytest.approx(grown) if grown is not None else None, pytest.approx(peak) if peak is not None else None)


def test_values_before(spark):
    df = spark.range(50).selectExpr("'k' AS k", "cast(id AS int) AS t", "id * 1.0D AS v")
    got = carry.with_before(df, ("k",), "t", 7, before=F.col("v")).collect()
    assert {x["t"]: x["before"] for x in got} == {t: float(t - 1) if t else None for t in range(50)}


def test_bootstrap(r, series):
    """Each draw is the resample of its blocks; p and se follow from the draws."""
    import hashlib

    drawn = by_asset(bootstrap.skew_draws(r, 30), "draw", "skew")
    assert set(drawn) == {"A", "B", "C", "flat"}
    for a in "ABC":
        x = series[a]
        n, width = len(x), round(len(x) ** (1 / 3))
        for draw, skew in drawn[a]:
            taken = []
            for b in range(-(-n // width)):
                h = hashlib.md5(f"7:{a}:{draw}:{b // 4}".encode()).hexdigest()
                start = int(h[b % 4 * 8 : b % 4 * 8 + 8], 16) * n >> 32
                taken += [x[(start + j) % n] for j in range(width)]
            d = np.array(taken[:n])
            d -= d.mean()
            assert skew == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5, abs=1e-9)
    tests = {a: t[0] for a, t in by_asset(bootstrap.skew_tests(r, 200), "n", "skew", "p", "se", "textbook").items()}
    assert tests["A"][2] > 0.01 and 0.5 < tests["A"][3] / tests["A"][4] < 1.6
    assert tests["short"][2:4] == (None, None) and tests["flat"][2:4] == (None, None)


def test_arch_lm_and_autoregression(r, series):
    got = {(a, k): (n, lm, p) for a, rows in by_asset(regression.arch_lm(r, (2, 5)), "lags", "n", "lm", "p").items() for k, n, lm, p in rows}
    for a in "ABC":
        for k in (2, 5):
            lm, p = v.arch_lm(series[a], k)
            assert got[a, k] == (len(series[a]) - k, pytest.approx(lm, rel=1e-9), pytest.approx(p, abs=1e-9))
    for a, rows in by_asset(regression.autoregression(r, 3), "intercept", "slopes", "r2").items():
        if a in "ABC":
            x = series[a]
            design = np.column_stack([np.ones(len(x) - 3), x[2:-1], x[1:-2], x[:-3]])
            c = np.linalg.lstsq(design, x[3:], rcond=None)[0]
            assert [rows[0][0], *rows[0][1]] == pytest.approx(list(c), abs=1e-9)
        else:
            assert rows[0][2] is None


def test_normality(r, series):
    got = {(a, t): (s, p) for a, rows in by_asset(normality.tests(r), "test", "stat", "p").items() for t, s, p in rows}
    assert {a for a, _ in got} == {"A", "B", "C"}
    for a in "ABC":
        for name, f in (("shapiro", v.shapiro_wilk), ("anderson", v.anderson_darling), ("kurtosis", v.kurtosis_test)):
            stat, p = f(series[a])
            assert got[a, name] == (pytest.approx(stat, abs=1e-7), pytest.approx(p, abs=1e-6))


def test_tails(spark):
    xs = [0.0, 0.3, 1.9, 2.1, 5.0, 12.0, 30.0, 60.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", distributions.half_log_tail(F.col("x")).alias("t"))
    for row in df.collect():
        u = row["x"]
        # beyond erfc's range: the asymptotic series
        want = math.log(math.erfc(u) / 2) if u < 20 else -u * u - math.log(2 * u * math.sqrt(math.pi)) + math.log1p(-1 / (2 * u * u) + 3 / (4 * u**4))
        assert row["t"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("model", garch.MODELS)
def test_variance_models(r, series, model):
    """The fold's likelihood is NumPy's, the search comes near the simplex's best, and residuals are the recursion's."""
    some = r.filter("asset in ('B', 'short', 'flat')")
    fit = garch.profiles(some, (model,)).collect()
    assert {f["asset"] for f in fit} == {"B"} and [f["parameter"] for f in fit] == v.parameter_names(model)
    p, x = np.array([f["estimate"] for f in fit]), series["B"]
    assert fit[0]["loglik"] == pytest.approx(v.log_likelihoods(p, model, x).sum(), abs=1e-7)
    assert fit[0]["loglik"] > v.fit_volatility(x, model)["loglik"] - 0.6
    for k, f in enumerate(fit):
        q = p.copy()
        q[k] *= 1.01
        ll = v.log_likelihoods(q, model, x)
        assert (f["higher"] is None) == (ll is None) and (ll is None or f["higher"] == pytest.approx(ll.sum(), abs=1e-7))
        assert f["largest"] == (max(w for w in (f["lower"], f["higher"], -np.inf) if w is not None) <= f["loglik"] + 1e-6)
    z = [row["x"] for row in garch.residuals(some, model).orderBy("date").collect()]
    e = x - p[0]
    assert z == pytest.approx(list(e / np.sqrt(v.variances(p, model, e))), abs=1e-9)


def test_log_gamma(spark):
    row = spark.range(1).select(*(garch.log_gamma(F.lit(z)).alias(str(k)) for k, z in enumerate((1.0, 1.025, 4.5, 250.0)))).first()
    assert list(row) == pytest.approx([math.lgamma(z) for z in (1.0, 1.025, 4.5, 250.0)], abs=1e-11)


def test_extreme_eigenvalues(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(6):
        n = 2 + k
        a = rng.standard_normal((n, n + 3))
        m = a @ a.T / (n + 3)
        want[k] = np.linalg.eigvalsh(m)
        rows += [(k, f"a{i}", f"a{j}", float(m[i, j])) for i in range(n) for j in range(n)]
    rows += [(9, a, b, 1.0) for a in "xy" for b in "xy"]
    found = eigen.extremes(eigen.matrices(spark.createDataFrame(rows, "k int, a string, b string, v double"), ("k",), "v"))
    for row in found.collect():
        if row["k"] == 9:
            assert row["largest"] == pytest.approx(2.0) and row["smallest"] is None
        else:
            assert (row["largest"], row["smallest"]) == (pytest.approx(want[row["k"]][-1], rel=1e-6), pytest.approx(want[row["k"]][0], rel=1e-6))
            assert row["rounds"] < eigen.ROUNDS


def test_pair_moments(spark):
    """Gaps, series that never meet, chunks that some lack; every ordered pair once."""
    rng = np.random.default_rng(8)
    data = {f"s{k}": {t: float(x) for t, x in enumerate(rng.standard_normal(200)) if rng.random() < 0.8 and (k != 3 or t < 50) and (k != 4 or t > 120)} for k in range(5)}
    rows = [(t, a, x) for a, xs in data.items() for t, x in xs.items()] + [(5, "null", None), (7, "one", 1.0)]
    got = {(r["a"], r["b"]): r for r in dependence.pair_moments(spark.createDataFrame(rows, "session int, asset string, r double")).collect()}
    want = {}
    for a, x in [*data.items(), ("one", {7: 1.0})]:
        for b, y in [*data.items(), ("one", {7: 1.0})]:
            both = sorted(set(x) & set(y))
            if both:
                want[a, b] = (len(both), np.cov([x[t] for t in both], [y[t] for t in both])[0, 1] if len(both) > 1 else None, np.corrcoef([x[t] for t in both], [y[t] for t in both])[0, 1] if len(both) > 1 else None)
    assert set(got) == set(want)
    for pair, (n, cov, corr) in want.items():
        r = got[pair]
        assert r["n"] == n
        assert r["cov"] == (pytest.approx(cov, abs=1e-12) if cov is not None else None)
        assert r["corr"] == (pytest.approx(corr, abs=1e-12) if corr is not None else None)
