"""More registered queries: three frequencies, the second implementation, audits and diagnostics."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.distributions import normal_quantile
from ..operators import backtest, bootstrap, garch, normality, panel, performance, regression, returns, robustness, sampler, statistics, strategies, volatility
from ..sources import market, workbook
from ..sources.lineage import shared_folder, written
from . import oracles as o
from .context import BENCHMARK, REGION_BENCHMARK, SCHEDULE, STRESS, Lab, Runs, tidy
from .oracles import sel
from .registry import _ADJUSTED, _EVENTS, _actions, _adjustment, _metrics, _runs, LAGS, ORACLE_SQL, Q_LAGS, QUERIES, query

P, D, E, S, R, T = o.PANEL, o.panel("daily"), o.EXPERIMENTS, o.SEGMENTS, o.returns(), o.METRICS
FREQUENCIES = ("daily", "weekly", "monthly")


def by_frequency(name: str, sql: Callable[[str], str] | None, f: Callable[[Lab], DataFrame]) -> None:
    """Register f over the panels of all frequencies, with a column freq; sql gives a select for the CTEs of one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        days = written(market.daily_sums(spark, sf_dir))
        for freq in FREQUENCIES:
            one = f(Lab(spark, sf_dir, freq, days=days)).withColumn("freq", F.lit(freq))
            out = one if out is None else out.unionByName(one)
        return tidy(out)

    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = " UNION ALL ".join(f"SELECT *, '{freq}' AS freq FROM ({sql(o.panel(freq))})" for freq in FREQUENCIES)


# ---- sources and audits ----
_END = "1998-06-05"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = market.observations(spark, sf_dir, end=_END)
    return tidy(obs.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last")))


QUERIES["panel_end_cut"] = _cut
ORACLE_SQL["panel_end_cut"] = f"{P} {sel(asset='asset', n='#count(*)', last='max(date)')} FROM obs WHERE date < DATE '{_END}' GROUP BY asset"
_LONG_A, _LONG_B = "Weekly prices of all nations, as traded", "Weekly prices of all nations, as filled"


def _round_trip(b: Lab) -> DataFrame:
    """Two tables whose names are cut alike, written as one workbook and read back, with their sheets and row counts."""
    sheets = {_LONG_A: b.panel.select("date", "asset", F.col("price_raw").alias("price")), _LONG_B: b.panel.select("date", "asset", "price")}
    folder = f"{shared_folder(b.spark)}/workbook-{uuid.uuid4().hex}"
    workbook.save(sheets, folder, b.spark)
    known = workbook.manifest(b.spark, folder).select("name", "sheet", "rows")
    out = None
    for name in sheets:
        one = workbook.load(b.spark, folder, name).groupBy("asset").agg(F.count("price").alias("n"), F.sum("price").alias("total")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.join(known, "name").select("sheet", "rows", "asset", "n", "total")


def _book(column: str, sheet: str) -> str:
    return f"SELECT '{sheet}' AS sheet, (SELECT count(*) FROM panel) AS rows, asset, count({column}) AS n, sum({column}) AS total FROM panel GROUP BY asset"


_SHEETS = workbook.sheet_names([_LONG_A, _LONG_B])
query("workbook_round_trip", f"{P}, wb AS ({_book('price_raw', _SHEETS[0])} UNION ALL {_book('price', _SHEETS[1])}) {sel(sheet='sheet', rows='#rows', asset='asset', n='#n', total='~total')} FROM wb")(_round_trip)


def _snapshot(b: Lab) -> DataFrame:
    """Observations as they are in the latest of two versions of a snapshot, the first cut off in the middle."""
    folder = f"{shared_folder(b.spark)}/snapshot-{uuid.uuid4().hex}"
    for obs in (b.obs.filter(F.col("date") < F.lit(_END).cast("date")), b.obs):
        workbook.save({"observations": obs, "universe": b.universe}, folder, b.spark, "parquet")
    found = workbook.load(b.spark, folder, "observations").join(workbook.load(b.spark, folder, "universe"), "asset")
    return found.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.max("date").alias("last"))


query("snapshot_latest", f"{P} {sel(sector='sector', n='#count(*)', volume='~sum(volume)', last='max(date)')} FROM obs JOIN uni USING (asset) GROUP BY sector")(_snapshot)
query("fill_limit_two", f"{D} {sel(asset='asset', before='#count(*) FILTER (price_raw IS NULL)', after='#count(*) FILTER (price_raw IS NULL AND coalesce(session - ls, 3) > 2)')} FROM marked GROUP BY asset", "daily")(
    lambda b: panel.align(b.obs, b.cal, b.universe, 2).groupBy("asset").agg(F.count_if(F.col("price_raw").isNull()).alias("before"), F.count_if(F.col("price").isNull()).alias("after"))
)
_RF = f""", rs AS (SELECT {o._DAY} AS date, avg(l_tax) * 100 AS rf FROM lineitem GROUP BY 1 HAVING dayofmonth({o._DAY}) % 9 < 4),
rg AS (SELECT session, date, rf, last_value(rf IGNORE NULLS) OVER w AS last, max(CASE WHEN rf IS NOT NULL THEN session END) OVER w AS seen FROM cal LEFT JOIN rs USING (date) WINDOW w AS (ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
query("rf_filled", f"{D}{_RF} {sel(session='session', date='date', rf_pct='~CASE WHEN session - seen <= 3 THEN last END')} FROM rg", "daily")(
    lambda b: panel.align_series(market.risk_free(b.spark, b.sf_dir, "daily").filter(F.dayofmonth("date") % 9 < 4), b.cal, "rf_pct", 3)
)


def _event_days(b: Lab) -> DataFrame:
    r = panel.log_returns(b.panel).withColumn("sd", F.stddev_samp("r").over(Window.partitionBy("asset")))
    events = _actions(b).filter("split <> 0").join(r.select("date", "asset", "r", "sd"), ["date", "asset"])
    moved = panel.extreme_moves(b.panel).select("date", "asset", F.lit(True).alias("extreme"))
    j = events.join(moved, ["date", "asset"], "left")
    return j.groupBy("asset").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.abs("r") >= 3 * F.col("sd")).alias("beyond"), F.count_if(F.col("extreme")).alias("extreme"))


query("event_day_checks", f"{P}{_EVENTS}, rd AS (SELECT *, stddev_samp(r) OVER (PARTITION BY asset) AS sd FROM ret) {sel(asset='ac.asset', events='#count(*)', beyond='#count(*) FILTER (abs(r) >= 3 * sd)', extreme='#count(*) FILTER (abs(r) > 0.15)')} FROM ac JOIN rd ON ac.date = rd.date AND ac.asset = rd.asset WHERE split <> 0 GROUP BY 1")(_event_days)
query("index_gap", f"{_ADJUSTED} {sel(asset='asset', gap_pp='~100 * (ac - (SELECT rc FROM cg WHERE asset = ' + chr(39) + BENCHMARK + chr(39) + '))')} FROM cg")(
    lambda b: _adjustment(b).crossJoin(_adjustment(b).filter(F.col("asset") == BENCHMARK).select(F.col("raw_cagr").alias("index"))).select("asset", ((F.col("adj_cagr") - F.col("index")) * 100).alias("gap_pp"))  # one row
)
query("income_ranking", f"{_ADJUSTED} {sel(asset='asset', income_pp='~100 * (ac - rc)', nth='#row_number() OVER (ORDER BY round(ac - rc, 9) DESC, asset)')} FROM cg QUALIFY row_number() OVER (ORDER BY round(ac - rc, 9) DESC, asset) <= 5")(
    lambda b: _adjustment(b).select("asset", (F.col("gap") * 100).alias("income_pp"), F.row_number().over(Window.orderBy(F.desc(F.round("gap", 9)), "asset")).alias("nth")).filter("nth <= 5")  # one row an asset
)
query("negative_on_price", f"{_ADJUSTED} {sel(asset='asset', raw_cagr='~rc', adj_cagr='~ac')} FROM cg WHERE rc < 0")(lambda b: _adjustment(b).filter("raw_cagr < 0").select("asset", "raw_cagr", "adj_cagr"))
query("proxies", f"{P}, px AS (SELECT asset, CASE WHEN cost_bp = 2 THEN sector || ' index' END AS proxy FROM uni) {sel(asset='asset', proxy='proxy')} FROM px WHERE proxy IS NOT NULL")(
    lambda b: panel.with_value(b.universe.select("asset", F.when(F.col("cost_bp") == 2, F.concat("sector", F.lit(" index"))).alias("proxy")), "proxy")
)
for _freq in ("weekly", "monthly"):
    query(f"returns_{_freq}_of_daily", f"{D}, pr AS (SELECT {o._PERIOD[_freq].replace(o._DAY, 'date')} AS d, asset, sum(r) AS lr FROM ret WHERE session > 1 GROUP BY 1, 2) {sel(date='d', asset='asset', log_r='~lr', simple_r='~exp(lr) - 1')} FROM pr", "daily")(lambda b, freq=_freq: returns.period_returns(b.panel, freq))


# ---- statistics at three frequencies ----
by_frequency(
    "describe_by_freq",
    lambda p: f"{p}{o.MOMENTS} {sel(asset='asset', n='#n', mean='~m', sd='~sd', skew='~skew', kurt='~kurt', kurt_plain='~kurt + 3', jb='~n / 6 * (skew * skew + kurt * kurt / 4)', jb_p='~exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)')} FROM mom",
    lambda b: statistics.describe(b.r).withColumn("kurt_plain", F.col("kurt") + 3).select("asset", "n", "mean", "sd", "skew", "kurt", "kurt_plain", "jb", "jb_p"),
)


def _lagged(p: str, lags: int = max(Q_LAGS)) -> str:
    return p + o.lagged(lags) + o.lagged(lags, "abs(x)", "_a") + o.lagged(lags, "x * x", "_s")


_KINDS = (("raw", ""), ("absolute", "_a"), ("squared", "_s"))


def _boxes(p: str) -> str:
    rows = " UNION ALL ".join(f"SELECT asset, {k} AS lags, '{t}' AS transform, any_value(n) * (any_value(n) + 2) * sum(xs / ss * xs / ss / (n - lag)) AS q FROM lagged{s} WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS for t, s in _KINDS)
    return _lagged(p) + f", lb AS ({rows}), lp AS (SELECT *, {o.at_lags(Q_LAGS)} AS p FROM lb)"


by_frequency("ljung_box_by_freq", lambda p: f"{_boxes(p)} {sel(asset='asset', lags='#lags', transform='transform', q='~q', p='~p')} FROM lp", lambda b: statistics.ljung_box(b.r, Q_LAGS))
by_frequency(
    "portmanteau_by_freq",
    lambda p: p + o.lagged(max(Q_LAGS)) + ", rp AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS lags, sum(xs * xs / xs2) AS q FROM lagged WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS) + f") {sel(asset='asset', lags='#lags', q='~q', p='~' + o.at_lags(Q_LAGS))} FROM rp",
    lambda b: statistics.robust_portmanteau(b.r, Q_LAGS),
)
by_frequency(
    "acf_by_freq",
    lambda p: f"{_lagged(p, LAGS)} {sel(asset='c.asset', lag='#c.lag', raw='~c.xs / c.ss', absolute='~a.xs / a.ss', squared='~s.xs / s.ss')} FROM lagged c JOIN lagged_a a ON a.asset = c.asset AND a.lag = c.lag JOIN lagged_s s ON s.asset = c.asset AND s.lag = c.lag",
    lambda b: statistics.acf(b.r, LAGS).select("asset", "lag", "raw", "absolute", "squared"),
)
by_frequency("normality_by_freq", lambda p: f"{p}{o.NORMALITY} {sel(asset='asset', test='test', stat='~stat', p='~p')} FROM nt", lambda b: normality.tests(b.r))
by_frequency(
    "arch_lm_by_freq",
    lambda p: f"{o.recursive(p)}{o.arch_lm(Q_LAGS)} {sel(asset='asset', lags='#lags', n='#n', lm='~lm', p='~' + o.at_lags(Q_LAGS, 'lm'))} FROM lm",
    lambda b: regression.arch_lm(b.r, Q_LAGS),
)
by_frequency(
    "ar1_by_freq",
    lambda p: f"{p}, ap AS (SELECT asset, x AS y, lag(x) OVER (PARTITION BY asset ORDER BY date) AS z FROM x) {sel(asset='asset', n='#count(z)', intercept='~regr_intercept(y, z)', slope='~regr_slope(y, z)', r2='~regr_r2(y, z)')} FROM ap WHERE z IS NOT NULL GROUP BY asset",
    lambda b: regression.autoregression(b.r).select("asset", "n", "intercept", F.col("slopes")[0].alias("slope"), "r2"),
)


def _dependence_rows(b: Lab) -> DataFrame:
    """Statistic and p of every dependence test at every number of lags."""
    boxes = statistics.ljung_box(b.r, Q_LAGS).select("asset", F.concat(F.lit("ljung-box "), "transform").alias("test"), "lags", F.col("q").alias("stat"), "p")
    robust = statistics.robust_portmanteau(b.r, Q_LAGS).select("asset", F.lit("robust portmanteau").alias("test"), "lags", F.col("q").alias("stat"), "p")
    arch = regression.arch_lm(b.r, Q_LAGS).select("asset", F.lit("arch-lm").alias("test"), "lags", F.col("lm").alias("stat"), "p")
    return boxes.unionByName(robust).unionByName(arch)


_PORTMANTEAU = ", rp AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS lags, sum(xs * xs / xs2) AS q FROM lagged WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS) + ")"
by_frequency(
    "dependence_table",
    lambda p: f"""{_boxes(o.recursive(p))}{_PORTMANTEAU}{o.arch_lm(Q_LAGS)}, dt AS (SELECT asset, 'ljung-box ' || transform AS test, lags, q, p FROM lp UNION ALL SELECT asset, 'robust portmanteau', lags, q, {o.at_lags(Q_LAGS)} FROM rp
    UNION ALL SELECT asset, 'arch-lm', lags, lm, {o.at_lags(Q_LAGS, 'lm')} FROM lm) {sel(asset='asset', test='test', lags='#lags', stat='~q', p='~p')} FROM dt""",
    _dependence_rows,
)
_LAYOUT = [(f"{t}_{k}", t, k) for t, _ in _KINDS for k in Q_LAGS]
by_frequency(
    "dependence_layout",
    lambda p: f"{_boxes(p)} {sel(asset='asset', **{n: f'''~max(CASE WHEN transform = '{t}' AND lags = {k} THEN p END)''' for n, t, k in _LAYOUT})} FROM lp GROUP BY asset",
    lambda b: statistics.ljung_box(b.r, Q_LAGS).groupBy("asset").agg(*(F.max(F.when((F.col("transform") == t) & (F.col("lags") == k), F.col("p"))).alias(n) for n, t, k in _LAYOUT)),
)
query("qq_normal", f"{P}, qz AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY x, date) AS i, count(*) OVER (PARTITION BY asset) AS n, (x - avg(x) OVER (PARTITION BY asset)) / stddev_samp(x) OVER (PARTITION BY asset) AS z FROM x), qp AS (SELECT *, (i - 0.5) / n AS pr FROM qz) {sel(asset='asset', i='#i', z='~z', normal='~' + o.normal_quantile('pr'))} FROM qp")(
    lambda b: statistics.qq_points(b.r).select("asset", "i", "z", normal_quantile(F.col("prob")).alias("normal"))
)
#: Student's quantile of 5 degrees of freedom: the angle atan(t / sqrt(5)) halved 50 times, as the operator does.
_ANGLE = "(a.at + sin(a.at) * cos(a.at) * (1 + cos(a.at) * cos(a.at) * 2 / 3))"
_STUDENT = f"tan(list_reduce(list_prepend({{'at': 0.0::DOUBLE, 'width': pi() / 2}}, list_transform(range(50), lambda i: {{'at': 0.0::DOUBLE, 'width': 0.0::DOUBLE}})), lambda a, b: {{'at': a.at + CASE WHEN {_ANGLE} < (pr - 0.5) * pi() THEN a.width / 2 ELSE -a.width / 2 END, 'width': a.width / 2}}).at) * sqrt(5.0::DOUBLE)"
query("qq_student", f"{P}, qz AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY x, date) AS i, count(*) OVER (PARTITION BY asset) AS n, (x - avg(x) OVER (PARTITION BY asset)) / stddev_samp(x) OVER (PARTITION BY asset) AS z FROM x), qs AS (SELECT *, {_STUDENT} AS t FROM (SELECT *, (i - 0.5) / n AS pr FROM qz)) {sel(asset='asset', i='#i', z='~z', student='~t', unit_student='~t * sqrt(0.6::DOUBLE)')} FROM qs")(lambda b: statistics.with_student(statistics.qq_points(b.r)))
_NOISE = """, un AS (SELECT date, asset, session, (('0x' || substr(md5('noise:' || asset || ':' || session), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u, (('0x' || substr(md5('noise:' || asset || ':' || session), 14, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS v FROM x),
wn AS (SELECT date, asset, session, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS x FROM un)"""
query("white_noise_acf", f"{P}{_NOISE}{o.lagged(10).replace('FROM x)', 'FROM wn)')} {sel(asset='asset', lag='#lag', rho='~xs / ss', inside='abs(xs / ss) <= 1.96 / sqrt(n)')} FROM lagged")(
    lambda b: statistics.acf(statistics.white_noise(panel.log_returns(b.panel).filter("r is not null").select("date", "asset", "session")), 10).select("asset", "lag", F.col("raw").alias("rho"), (F.abs("raw") <= F.col("band")).alias("inside"))
)
_BOOT = f""",
bz AS (SELECT asset, count(*) AS n, round_even(power(count(*)::DOUBLE, {1 / 3!r}::DOUBLE), 0)::INT AS width, avg(x) AS mean FROM x GROUP BY asset HAVING count(*) >= {bootstrap.MIN_N}),
bd AS (SELECT x.asset, row_number() OVER (PARTITION BY x.asset ORDER BY date) AS t, x - mean AS d FROM x JOIN bz ON x.asset = bz.asset),
bp AS (SELECT asset, t, sum(d) OVER w AS p1, sum(d * d) OVER w AS p2, sum(d * d * d) OVER w AS p3 FROM bd WINDOW w AS (PARTITION BY asset ORDER BY t) UNION ALL SELECT asset, 0, 0, 0, 0 FROM bz),
bb AS (SELECT asset, n, width, draw, unnest(range(ceil(n / width::DOUBLE)::INT)) AS b FROM bz CROSS JOIN (SELECT unnest(range({bootstrap.DRAWS})) AS draw)),
bs_ AS (SELECT *, (('0x' || substr(md5('{bootstrap.SEED}:' || asset || ':' || draw || ':' || (b // 4)), ((b % 4) * 8 + 1)::INT, 8))::BIGINT * n) >> 32 AS s, least(width, n - b * width) AS len FROM bb),
bt AS (SELECT bs_.asset, draw, bs_.n, sum(e.p1 - s.p1 + CASE WHEN bs_.s + len > bs_.n THEN f.p1 ELSE 0 END) / bs_.n AS m1, sum(e.p2 - s.p2 + CASE WHEN bs_.s + len > bs_.n THEN f.p2 ELSE 0 END) / bs_.n AS m2, sum(e.p3 - s.p3 + CASE WHEN bs_.s + len > bs_.n THEN f.p3 ELSE 0 END) / bs_.n AS m3
       FROM bs_ JOIN bp s ON s.asset = bs_.asset AND s.t = bs_.s JOIN bp e ON e.asset = bs_.asset AND e.t = CASE WHEN bs_.s + len > bs_.n THEN bs_.s + len - bs_.n ELSE bs_.s + len END JOIN bp f ON f.asset = bs_.asset AND f.t = bs_.n GROUP BY 1, 2, 3),
bw AS (SELECT asset, n, draw, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / power(m2 - m1 * m1, 1.5) AS w, avg((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / power(m2 - m1 * m1, 1.5)) OVER (PARTITION BY asset) AS mid FROM bt),
bo AS (SELECT asset, count(*) AS n, avg(d * d * d) / power(avg(d * d), 1.5) AS own FROM bd GROUP BY asset)"""
by_frequency(
    "skew_bootstrap_by_freq",
    lambda p: f"{p}{_BOOT} {sel(asset='bo.asset', n='#any_value(bo.n)', skew='~any_value(own)', p='~avg(CASE WHEN abs(w - mid) >= abs(own) THEN 1.0::DOUBLE ELSE 0 END)', se='~stddev_samp(w)', textbook='~sqrt(6.0 * (any_value(bo.n) - 2) / ((any_value(bo.n) + 1) * (any_value(bo.n) + 3)))')} FROM bo JOIN bw ON bw.asset = bo.asset GROUP BY bo.asset",
    lambda b: bootstrap.skew_tests(b.r),
)
query("skew_standard_errors", f"{P}{_BOOT} {sel(asset='bo.asset', textbook='~sqrt(6.0 * (any_value(bo.n) - 2) / ((any_value(bo.n) + 1) * (any_value(bo.n) + 3)))', bootstrap='~stddev_samp(w)')} FROM bo JOIN bw ON bw.asset = bo.asset GROUP BY bo.asset")(
    lambda b: bootstrap.skew_tests(b.r).select("asset", "textbook", F.col("se").alias("bootstrap"))
)


def _residuals(b: Lab) -> DataFrame:
    r = written(b.r)
    return volatility.standardised_residuals(r, volatility.fit_models(r, ("GJR-t",)))


_PROFILE = dict(asset="asset", model="model", n="#n", parameter="parameter", estimate="~estimate", loglik="~loglik", lower="~lower", higher="~higher", largest="greatest(coalesce(lower, '-infinity'::DOUBLE), coalesce(higher, '-infinity'::DOUBLE)) <= loglik + 1e-6")
by_frequency("variance_profiles", lambda p: f"{o.recursive(p)}{o.variance_profiles('GARCH-N', 'g')} {sel(**_PROFILE)} FROM gp", lambda b: garch.profiles(b.r, ("GARCH-N",)))
query("variance_profiles_gjr", f"{o.recursive(P)}{o.variance_profiles('GJR-t', 'g')} {sel(**_PROFILE)} FROM gp")(lambda b: garch.profiles(b.r, ("GJR-t",)))
query("variance_persistence", f"{o.recursive(P)}{o.variance_profiles('GJR-t', 'g')}, pe AS (SELECT asset, al + be + ga / 2 AS kept, nu FROM gb) {sel(asset='asset', persistence='~kept', half_life='~CASE WHEN kept > 0 AND kept < 1 THEN ln(0.5::DOUBLE) / ln(kept) END', nu='~nu')} FROM pe")(
    lambda b: garch.persistence(b.r, "GJR-t")
)
_RESIDUAL = o.variance_residuals("GARCH-N", "g") + o.lagged(max(Q_LAGS), "x * x", "_z").replace("FROM x)", "FROM zx)")
_RESIDUAL_BOX = " UNION ALL ".join(f"SELECT asset, {k} AS lags, any_value(n) * (any_value(n) + 2) * sum(xs / ss * xs / ss / (n - lag)) AS q FROM lagged_z WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS)
query("residual_ljung_box", f"{o.recursive(P)}{o.variance_profiles('GARCH-N', 'g')}{_RESIDUAL}, zb AS ({_RESIDUAL_BOX}) " + sel(asset="asset", lags="#lags", transform="'squared'", q="~q", p="~" + o.at_lags(Q_LAGS)) + " FROM zb")(
    lambda b: statistics.ljung_box(written(garch.residuals(b.r, "GARCH-N")), Q_LAGS).filter("transform = 'squared'")
)
query("residual_ljung_box_gjr", None)(lambda b: statistics.ljung_box(_residuals(b), Q_LAGS).filter("transform = 'squared'"))
query("asymmetry_robustness", None)(lambda b: volatility.asymmetry_robustness(b.r, *STRESS))
query("convergence_log", None)(lambda b: volatility.convergence_log(written(volatility.fit_models(b.r, ("GARCH-N", "GJR-t")))))

# ---- runs ----
query("benchmark_leg", f"{E} {sel(experiment='#experiment', pos='#pos', date='d.date', ret='~ret.s')} FROM (SELECT DISTINCT experiment, pos, date FROM win WHERE pos > {SCHEDULE.estimation}) d LEFT JOIN ret ON d.date = ret.date AND ret.asset = '{BENCHMARK}'")(
    lambda b: backtest.benchmark_leg(b.windows, returns.simple_returns(b.panel).filter(F.col("asset") == BENCHMARK), SCHEDULE)
)
query("identity_weights", f"{E} {sel(experiment='#a.experiment', strategy='''concat('BH ', a.asset)''', asset='b.asset', w='~CASE WHEN a.asset = b.asset THEN 1.0::DOUBLE ELSE 0 END')} FROM ea a JOIN ea b ON a.experiment = b.experiment")(
    lambda b: backtest.identity(b.exp_asset, b.trades).select("experiment", "strategy", "asset", "w")
)
query("gmrp_weights", f"{E} {sel(experiment='#experiment', k='#k', asset='asset', w='~CASE WHEN row_number() OVER (PARTITION BY experiment, k ORDER BY mean DESC, asset) = 1 THEN 1.0::DOUBLE ELSE 0 END')} FROM est")(
    lambda b: strategies.relational(strategies.estimates(b.rows)).filter("strategy = 'GMRP'").select("experiment", "k", "asset", "w")
)


def _frame(runs: Runs) -> DataFrame:
    """One row a run, with turnover beside its metrics."""
    return runs.metrics.join(backtest.turnover(runs.traded, SCHEDULE), ["experiment", "strategy"]).select("experiment", "strategy", "basis", "ann_return", "sharpe", "max_dd", "turnover")


query("results_frame", f"{o.ALL_METRICS}, tv AS (SELECT experiment, strategy, coalesce(sum(turnover) FILTER (k > 0), 0) * {SCHEDULE.periods} / {SCHEDULE.evaluation}.0::DOUBLE AS turnover FROM td GROUP BY 1, 2) {sel(experiment='#m.experiment', strategy='m.strategy', basis='basis', ann_return='~ann_return', sharpe='~sharpe', max_dd='~max_dd', turnover='~turnover')} FROM m JOIN tv ON m.experiment = tv.experiment AND m.strategy = tv.strategy WHERE m.strategy <> 'QNT'")(
    lambda b: _frame(Runs(b, b.solved.unionByName(b.relational.filter("strategy <> 'QNT'"))))
)
query("turnover_summary", f"{S}, tv AS (SELECT experiment, strategy, coalesce(sum(turnover) FILTER (k > 0), 0) AS t FROM td GROUP BY 1, 2) {sel(strategy='strategy', mean='~avg(t)', median='~median(t)')} FROM tv GROUP BY strategy")(
    lambda b: backtest.turnover(_runs(b).traded, SCHEDULE).groupBy("strategy").agg(F.avg("turnover").alias("mean"), F.median("turnover").alias("median"))
)
query(
    "shrinkage_crisis_split",
    o.SHRINK + f", cs AS (SELECT si.*, EXISTS (SELECT 1 FROM er JOIN win USING (experiment, asset, pos) WHERE er.experiment = si.experiment AND er.k = si.k AND win.date BETWEEN DATE '{STRESS[0]}' AND DATE '{STRESS[1]}') AS stressed FROM si) {sel(stressed='stressed', n='#count(*)', median='~median(x)')} FROM cs GROUP BY stressed",
)(
    lambda b: strategies.shrinkage(b.rows)
    .join(b.rows.join(b.windows.select("experiment", "asset", "pos", "date"), ["experiment", "asset", "pos"]).groupBy("experiment", "k").agg(F.bool_or(F.col("date").between(F.lit(STRESS[0]).cast("date"), F.lit(STRESS[1]).cast("date"))).alias("stressed")), ["experiment", "k"])
    .groupBy("stressed").agg(F.count(F.lit(1)).alias("n"), F.median("intensity").alias("median"))
)
query(
    "iv_erc_gap",
    f"""{o.ALL_WEIGHTS}, gw AS (SELECT experiment, k, sum(abs(x.w - y.w)) / 2 AS gap FROM w x JOIN w y USING (experiment, k, asset) WHERE x.strategy = 'IV' AND y.strategy = 'ERC' GROUP BY 1, 2),
    gs AS (SELECT experiment, k, stddev_samp(m) AS spread FROM (SELECT experiment, k, a, avg(c) AS m FROM ec WHERE a <> b GROUP BY 1, 2, 3) GROUP BY 1, 2) {sel(windows='#count(*)', mean_gap='~avg(gap)', max_gap='~max(gap)', corr='~corr(gap, spread)')} FROM gw JOIN gs USING (experiment, k)""",
)(lambda b: strategies.gap_by_correlation(b.relational.unionByName(strategies.solved(b.rows, SCHEDULE, names=("ERC",))), strategies.pair_covariances(b.rows)))

# ---- the second implementation ----
_LAB2 = sampler.SECOND


def _second(schedule: sampler.Schedule, freq: str, level: str = "nation", fee: float = 0.0015) -> str:
    """CTEs up to s14, the 14 metrics of runs net of a flat fee."""
    y = float(schedule.periods)
    return o.segments(schedule, freq, level) + f""",
dv AS (SELECT DISTINCT experiment, strategy, k, pos, date, execution, v FROM seg),
dg AS (SELECT *, v / lag(v) OVER (PARTITION BY experiment, strategy, k ORDER BY pos) - 1 AS gross FROM dv),
f2 AS (SELECT d.experiment, d.strategy, 'flat fee' AS basis, d.pos, d.date, gross - coalesce(turnover, 0) * {fee} AS ret FROM (SELECT * FROM dg WHERE pos > execution) d LEFT JOIN td c ON d.experiment = c.experiment AND d.strategy = c.strategy AND d.pos = c.execution + 1),
bl AS (SELECT experiment, 'BENCHMARK' AS strategy, 'flat fee' AS basis, pos, d.date, ret.s AS ret FROM (SELECT DISTINCT experiment, pos, date FROM win WHERE pos > {schedule.estimation}) d JOIN ret ON d.date = ret.date AND ret.asset = '{REGION_BENCHMARK if level == "region" else BENCHMARK}'),
fa AS (SELECT * FROM f2 UNION ALL SELECT * FROM bl WHERE ret IS NOT NULL),
fw AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY experiment, strategy, basis ORDER BY pos)) AS wealth, avg(ret) OVER r - 1.6448536269514729 * stddev_samp(ret) OVER r AS lim, ret - avg(ret) OVER r AS d FROM fa WINDOW r AS (PARTITION BY experiment, strategy, basis)),
fd AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY experiment, strategy, basis ORDER BY pos)) - 1 AS fall FROM fw),
fy AS (SELECT experiment, strategy, basis, median(g) AS median_year FROM (SELECT experiment, strategy, basis, exp(sum(ln(1 + ret))) - 1 AS g FROM fa GROUP BY 1, 2, 3, year(date)) GROUP BY 1, 2, 3),
fg AS (SELECT experiment, strategy, basis, count(*)::DOUBLE AS n, avg(ret) AS m, stddev_samp(ret) AS sd, sum(ln(1 + ret)) AS grown, avg(power(least(ret, 0), 2)) AS down, least(min(fall), 0) AS worst, avg(fall) FILTER (fall < 0) AS mf,
       100.0::DOUBLE * count(*) FILTER (ret > 0) / count(*) FILTER (ret <> 0) AS win_pct, avg(d * d * d) / power(avg(d * d), 1.5) AS g1, avg(d * d * d * d) / power(avg(d * d), 2) - 3 AS g2, -any_value(lim) AS var95, -coalesce(avg(ret) FILTER (ret < lim), any_value(lim)) AS cvar95 FROM fd GROUP BY 1, 2, 3),
s14 AS (SELECT experiment, strategy, basis, m * {y} AS ann_return, exp(grown) - 1 AS cum_return, sd * sqrt({y}) AS ann_vol, m / nullif(sd, 0) * sqrt({y}) AS sharpe, m * sqrt({y}) / nullif(sqrt(down), 0) AS sortino, (exp(grown * {y} / n) - 1) / nullif(-worst, 0) AS calmar,
        m * {y} / nullif(-mf, 0) AS sterling, coalesce(-mf, 0) AS mean_dd, -worst AS max_dd, win_pct, g1 * sqrt(n * (n - 1)) / (n - 2) AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) AS kurt, var95, cvar95, median_year FROM fg JOIN fy USING (experiment, strategy, basis))"""


def _second_returns(b: Lab, fee: float = 0.0015) -> DataFrame:
    """Returns net of a flat fee of the relational strategies, and of the benchmark bought and held, on the same dates."""
    own = backtest.flat_fee_returns(_runs(b).segments, _runs(b).traded, fee)
    leg = backtest.benchmark_leg(b.windows, returns.simple_returns(b.panel).filter(F.col("asset") == b.benchmark), b.schedule).filter("ret is not null")
    return own.unionByName(leg.withColumn("strategy", F.lit("BENCHMARK"))).withColumn("basis", F.lit("flat fee"))


_ALL14 = (*performance.SECOND_METRICS, "median_year")
query("second_metrics", f"{_second(SCHEDULE, 'weekly')} {sel(experiment='#experiment', strategy='strategy', basis='basis', **{c: '~' + c for c in _ALL14})} FROM s14")(lambda b: performance.second_metrics(_second_returns(b), SCHEDULE.periods))


def _daily_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At region level, whose days are complete enough for windows of 1,261 sessions in small tables too."""
    b = Lab(spark, sf_dir, "daily", "region", _LAB2)
    return tidy(performance.second_metrics(_second_returns(b), _LAB2.periods))


QUERIES["second_schedule_metrics"] = _daily_second
ORACLE_SQL["second_schedule_metrics"] = f"{_second(_LAB2, 'daily', 'region')} {sel(experiment='#experiment', strategy='strategy', basis='basis', **{c: '~' + c for c in _ALL14})} FROM s14"
_LONG14 = f", l14 AS (UNPIVOT s14 ON {', '.join(performance.SECOND_METRICS)} INTO NAME metric VALUE value)"
query("second_summary", f"{_second(SCHEDULE, 'weekly')}{_LONG14} {sel(strategy='strategy', basis='basis', metric='metric', mean='~avg(value)', median='~median(value)')} FROM l14 GROUP BY 1, 2, 3")(
    lambda b: performance.across_runs(performance.second_metrics(_second_returns(b), SCHEDULE.periods))
)
_EIGHT = {"ann_return": True, "median_year": True, "ann_vol": False, "sharpe": True, "max_dd": False, "calmar": True, "sterling": True, "win_pct": True}
query(
    "win_table",
    f"{_second(SCHEDULE, 'weekly')}, wj AS (SELECT a.strategy, a.basis, {', '.join(f'a.{c} AS {c}, b.{c} AS b_{c}' for c in _EIGHT)} FROM s14 a JOIN s14 b ON a.experiment = b.experiment AND a.basis = b.basis AND b.strategy = 'BENCHMARK' WHERE a.strategy <> 'BENCHMARK') "
    + sel(strategy="strategy", basis="basis", **{c: f"~avg(CASE WHEN {c} IS NULL OR b_{c} IS NULL THEN NULL WHEN {c} {'>' if up else '<'} b_{c} THEN 100.0::DOUBLE ELSE 0 END)" for c, up in _EIGHT.items()})
    + " FROM wj GROUP BY strategy, basis",
)(lambda b: performance.win_table(performance.benchmark_wins(written(performance.second_metrics(_second_returns(b), SCHEDULE.periods)), "BENCHMARK", _EIGHT), tuple(_EIGHT)))
query(
    "association_differences",
    f"""{T}, sd AS (SELECT experiment, strategy, sharpe - b_sharpe AS d, CASE WHEN sharpe > b_sharpe THEN 100.0::DOUBLE ELSE 0 END AS w FROM ag2 WHERE basis = 'net'), al AS (SELECT strategy, count(*) AS an, sum(w) AS aw, sum(d) AS ad FROM sd GROUP BY 1),
    hd AS (SELECT strategy, asset, count(*) AS n, sum(w) AS hw, sum(d) AS hd FROM sd JOIN ea USING (experiment) GROUP BY 1, 2 HAVING count(*) >= 5), dd AS (SELECT *, hw / n AS ww, (aw - hw) / nullif(an - n, 0) AS wo, hd / n AS dw_, (ad - hd) / nullif(an - n, 0) AS do_ FROM hd JOIN al USING (strategy))
    {sel(strategy='strategy', asset='asset', n='#n', win_with='~ww', win_without='~wo', d_with='~dw_', d_without='~do_', win_gap='~ww - wo', d_gap='~dw_ - do_')} FROM dd""",
)(lambda b: robustness.association_differences(_metrics(b), b.exp_asset))
_BP = (5, 10, 20, 50)
query(
    "fee_cost",
    f"{o.returns(', '.join(f'''('{f}bp', {f / 3.5!r}::DOUBLE)''' for f in (0, *_BP)))}, fc AS (SELECT experiment, strategy, basis, avg(ret) * 52 AS a FROM rt GROUP BY 1, 2, 3), fk AS (SELECT z.strategy, f.basis, z.a - f.a AS c FROM fc z JOIN fc f ON z.experiment = f.experiment AND z.strategy = f.strategy AND z.basis = '0bp' AND f.basis <> '0bp') "
    + sel(strategy="strategy", **{f"cost_{f}bp": f"~avg(c) FILTER (basis = '{f}bp')" for f in _BP})
    + " FROM fk GROUP BY strategy",
)(lambda b: performance.fee_cost(Runs(b, b.relational, {f"{f}bp": f / 3.5 for f in (0, *_BP)}).returns, "0bp", tuple(f"{f}bp" for f in _BP), 52))
_PAIR = f", mq AS (SELECT a.experiment, a.asset || '/' || b.asset AS pair, corr(a.s, b.s) AS c FROM win a JOIN win b ON a.experiment = b.experiment AND a.pos = b.pos AND a.asset < b.asset WHERE a.pos > {SCHEDULE.estimation - SCHEDULE.lookback} AND a.pos <= {SCHEDULE.estimation} GROUP BY 1, 2), mp AS (SELECT experiment, max_by(pair, c) AS pair FROM mq GROUP BY 1)"
query("pair_by_crisis", f"{E}{o.CRISIS}{_PAIR} {sel(pair='pair', evaluation='#count(*) FILTER (crisis = ' + chr(39) + 'evaluation' + chr(39) + ')', estimation_only='#count(*) FILTER (crisis = ' + chr(39) + 'estimation only' + chr(39) + ')', neither='#count(*) FILTER (crisis = ' + chr(39) + 'neither' + chr(39) + ')')} FROM mp JOIN cr USING (experiment) GROUP BY pair")(
    lambda b: robustness.max_pair_correlation(b.windows, SCHEDULE.estimation, SCHEDULE.lookback).join(robustness.crisis_groups(b.windows, SCHEDULE.estimation, *STRESS), "experiment")
    .groupBy("pair").agg(*(F.count_if(F.col("crisis") == c).alias(c.replace(" ", "_")) for c in ("evaluation", "estimation only", "neither")))
)
query("winners_exposure", f"{T}, ex AS (SELECT experiment, strategy, avg(x) AS e FROM (SELECT experiment, strategy, pos, sum(weight * cost_bp) AS x FROM dw JOIN uni USING (asset) GROUP BY 1, 2, 3) GROUP BY 1, 2) {sel(strategy='ag2.strategy', winner='sharpe > b_sharpe', n='#count(*)', exposure='~avg(e)')} FROM ag2 JOIN ex ON ag2.experiment = ex.experiment AND ag2.strategy = ex.strategy WHERE basis = 'net' GROUP BY 1, 2")(
    lambda b: performance.against(_metrics(b)).filter("basis = 'net'").join(robustness.exposure(_runs(b).daily_weights, b.universe.select("asset", F.col("cost_bp").alias("value"))), ["experiment", "strategy"])
    .groupBy("strategy", (F.col("sharpe") > F.col("b_sharpe")).alias("winner")).agg(F.count(F.lit(1)).alias("n"), F.avg("exposure").alias("exposure"))
)
query("extra_cost", f"{T} {sel(strategy='a.strategy', sharpe_once='~median(a.sharpe)', sharpe_twice='~median(b.sharpe)', difference='~median(b.sharpe - a.sharpe)', drag_bp='~median(a.ann_return - b.ann_return) * 1e4')} FROM m a JOIN m b ON a.experiment = b.experiment AND a.strategy = b.strategy AND a.basis = 'net' AND b.basis = 'net_2x' GROUP BY a.strategy")(
    lambda b: performance.cost_impact(_metrics(b), "net", "net_2x").withColumnsRenamed({"sharpe_before": "sharpe_once", "sharpe_after": "sharpe_twice"})
)
