"""Every query of the analytics engine by name, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting
from ..operators import backtest, dependence, panel, performance, returns, robustness, sampler, statistics, strategies, verdicts, volatility
from ..sources import market
from ..sources.lineage import written
from . import oracles as o
from .context import BENCHMARK, N_EXPERIMENTS, SCHEDULE, STRESS, Lab, Runs, tidy
from .oracles import sel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TAIL_Z = {0.01: -2.3263478740408408, 0.05: -1.6448536269514726, 0.95: 1.6448536269514722, 0.99: 2.3263478740408408}
TAIL_SF = {3: 0.0026997960632601965, 4: 6.334248366623996e-05, 5: 5.733031437583892e-07}


def query(name: str, sql: str | None, freq: str = "weekly") -> Callable:
    """Register f(lab) under name, rounded as the SQL is."""

    def add(f: Callable[[Lab], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(Lab(spark, sf_dir, freq)))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every run; at region level, so that small tables have complete windows too."""
    return tidy(_runs(Lab(spark, sf_dir, level="region")).metrics)


def _runs(lab: Lab) -> Runs:
    """The runs of the relational strategies, one object for each query."""
    if not hasattr(lab, "runs"):
        lab.runs = Runs(lab, lab.relational)
    return lab.runs


P, D = o.PANEL, o.panel("daily")

# ---- panel and audit ----
query("panel_weekly", f"{P} {sel(session='session', date='date', asset='asset', price_raw='~price_raw', price='~price', volume='~volume')} FROM panel")(lambda b: b.panel)
query("panel_fill_counts", f"{D} {sel(asset='asset', filled='#count(*) FILTER (price_raw IS NULL AND price IS NOT NULL)')} FROM panel GROUP BY asset", "daily")(lambda b: panel.fill_counts(b.panel))
_GAPS = """,
fs AS (SELECT *, min(CASE WHEN {c} IS NOT NULL THEN session END) OVER (PARTITION BY asset) AS f FROM panel),
gi AS (SELECT asset, date, session, session - row_number() OVER (PARTITION BY asset ORDER BY session) AS isl FROM fs WHERE {c} IS NULL AND session > f),
gaps AS (SELECT asset, min(date) AS gap_start, max(date) AS gap_end, count(*) AS sessions FROM gi GROUP BY asset, isl)"""
query("panel_gap_islands", f"{D}{_GAPS.format(c='price')} {sel(asset='asset', gap_start='gap_start', gap_end='gap_end', sessions='#sessions')} FROM gaps", "daily")(lambda b: panel.gap_islands(b.panel))
query("longest_gap", f"{D}{_GAPS.format(c='price_raw')} {sel(asset='uni.asset', longest='#coalesce(max(sessions), 0)')} FROM uni LEFT JOIN gaps ON uni.asset = gaps.asset GROUP BY uni.asset", "daily")(lambda b: panel.longest_gap(b.panel))
query("off_calendar", f"{D} {sel(asset='asset', dropped='#count(*)')} FROM obs WHERE date >= (SELECT min(date) FROM cal) AND date NOT IN (SELECT date FROM cal) GROUP BY asset", "daily")(lambda b: panel.off_calendar(b.obs, b.cal))
query("first_complete_date", f"{D} SELECT min(date) AS first_date FROM (SELECT date FROM panel GROUP BY date HAVING count(price) = count(*))", "daily")(lambda b: panel.first_complete(b.panel))
query(
    "availability",
    f"""{D}, av AS (SELECT asset, min(date) AS first_obs, count(*) AS n, median(CASE WHEN price * volume > 0 AND date >= (SELECT min(date) FROM cal) THEN price * volume END) AS mv,
    ((SELECT max(date) FROM cal) - min(date)) / 365.25::DOUBLE AS years FROM obs GROUP BY asset)
    {sel(asset='asset', first_obs='first_obs', years='~years', obs_per_year='~n / years', median_value_m='~mv / 1e6', long_enough='years >= 5')} FROM av""",
    "daily",
)(lambda b: panel.availability(b.obs, b.panel, 5.0))
query(
    "quality",
    f"""{D}{_GAPS.format(c='price_raw')},
    rr AS (SELECT *, min(CASE WHEN price_raw IS NOT NULL THEN session END) OVER (PARTITION BY asset) AS f0 FROM ret),
    q AS (SELECT asset, min(date) AS panel_start, count(price) AS n_obs, count(*) FILTER (price_raw IS NULL) AS missing, count(*) FILTER (price_raw IS NULL AND price IS NOT NULL) AS filled,
          100.0::DOUBLE * count(*) FILTER (abs(r) < 1e-12) / nullif(count(r), 0) AS stale_pct, count(*) FILTER (abs(r) > 0.15) AS extreme_days FROM rr WHERE session >= f0 GROUP BY asset),
    l AS (SELECT asset, max(sessions) AS longest FROM gaps GROUP BY asset),
    dr AS (SELECT asset, count(*) AS dropped FROM obs WHERE date >= (SELECT min(date) FROM cal) AND date NOT IN (SELECT date FROM cal) GROUP BY asset),
    t AS (SELECT q.*, coalesce(longest, 0) AS longest, coalesce(dropped, 0) AS dropped, array_to_string(list_filter([
       CASE WHEN coalesce(dropped, 0) > 0 THEN format('{{:,}}', dropped) || ' off-calendar obs. dropped' END,
       CASE WHEN filled > 0 THEN filled::VARCHAR || ' session(s) forward-filled' END,
       CASE WHEN missing - filled > 0 THEN (missing - filled)::VARCHAR || ' left as NaN' END], lambda z: z IS NOT NULL), '; ') AS done FROM q LEFT JOIN l USING (asset) LEFT JOIN dr USING (asset))
    {sel(asset='asset', panel_start='panel_start', n_obs='#n_obs', missing='#missing', filled='#filled', stale_pct='~stale_pct', extreme_days='#extreme_days', longest='#longest', dropped='#dropped', treatment="CASE WHEN done = '' THEN 'None required' ELSE done END")} FROM t""",
    "daily",
)(lambda b: panel.quality(b.obs, b.cal, b.panel))
_MOVES = ", mv AS (SELECT date, asset, 100 * r AS r_pct, count(*) OVER (PARTITION BY date) AS same_day FROM ret WHERE abs(r) > 0.15)"
query("extreme_moves", f"{P}{_MOVES} {sel(date='date', asset='asset', r_pct='~r_pct', same_day='#same_day')} FROM mv")(lambda b: panel.extreme_moves(b.panel))
query("moves_by_year", f"{P}{_MOVES} {sel(year='#year(date)', n='#count(*)', dates='#count(DISTINCT date)', shared='#count(*) FILTER (same_day > 1)')} FROM mv GROUP BY year(date)")(lambda b: panel.moves_by(panel.extreme_moves(b.panel), "year"))
query("moves_by_asset", f"{P}{_MOVES} {sel(asset='asset', n='#count(*)', dates='#count(DISTINCT date)', shared='#count(*) FILTER (same_day > 1)')} FROM mv GROUP BY asset")(lambda b: panel.moves_by(panel.extreme_moves(b.panel), "asset"))
query("moves_explained", f"{P}{_MOVES} {sel(date='date', asset='asset', note='''CASE WHEN asset = 'NATION_2' THEN 'Annotated' ELSE 'No note' END''')} FROM mv")(
    lambda b: panel.explained(panel.extreme_moves(b.panel), b.panel.filter("asset = 'NATION_2'").select("date", "asset", F.lit("Annotated").alias("note"))).select("date", "asset", "note")
)
query(
    "interpolated",
    f"""{D}, ip AS (SELECT *, max(CASE WHEN price_raw IS NOT NULL THEN session END) OVER (PARTITION BY asset ORDER BY session) AS s0, min(CASE WHEN price_raw IS NOT NULL THEN session END) OVER (PARTITION BY asset ORDER BY session ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s1 FROM panel)
    {sel(asset='i.asset', session='i.session', price='~coalesce(i.price_raw, a.price_raw + (b.price_raw - a.price_raw) * ((i.session - i.s0) / (i.s1 - i.s0)::DOUBLE))')}
    FROM ip i LEFT JOIN panel a ON a.asset = i.asset AND a.session = i.s0 LEFT JOIN panel b ON b.asset = i.asset AND b.session = i.s1""",
    "daily",
)(lambda b: panel.interpolate(b.panel).select("asset", "session", "price"))
query(
    "buy_and_hold",
    f"""{P}, cp AS (SELECT * FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(price) = count(*))),
    cl AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY session) AS lr FROM cp),
    bh AS (SELECT asset, max_by(price, session) / min_by(price, session) AS growth, (max(date) - min(date)) / 365.25::DOUBLE AS years, stddev_samp(lr) AS sd FROM cl GROUP BY asset)
    {sel(asset='asset', growth='~growth', cagr='~power(growth, 1 / years) - 1', vol='~sd * sqrt(52)', beats=f"growth > (SELECT growth FROM bh WHERE asset = '{BENCHMARK}')")} FROM bh""",
)(lambda b: panel.buy_and_hold(b.panel, BENCHMARK))

# ---- returns ----
query("returns_daily_log", f"{D} {sel(date='date', asset='asset', r='~r')} FROM ret", "daily")(lambda b: panel.log_returns(b.panel).select("date", "asset", "r"))
query("returns_monthly_simple", f"{P}, mo AS (SELECT last_day(date) AS date, asset, sum(r) AS log_r FROM ret WHERE session > 1 GROUP BY 1, 2) {sel(date='date', asset='asset', log_r='~log_r', simple_r='~exp(log_r) - 1')} FROM mo")(lambda b: returns.period_returns(b.panel, "monthly"))
query(
    "returns_complete_months",
    f"{P}, mo AS (SELECT last_day(date) AS date, asset, sum(r) AS log_r FROM ret WHERE session > 1 GROUP BY 1, 2), mn AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS nth FROM mo) {sel(date='date', asset='asset', r_pct='~100 * log_r')} FROM mn WHERE nth > 1 AND date <= DATE '2001-10-31'",
)(lambda b: returns.complete_periods(returns.period_returns(b.panel, "monthly"), "2001-10-31"))
query("rolling_vol", f"{P} {sel(date='date', asset='asset', vol='~CASE WHEN count(r) OVER t = 13 THEN stddev_samp(r) OVER t END * sqrt(52)')} FROM ret WINDOW t AS (PARTITION BY asset ORDER BY session ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)")(lambda b: returns.rolling_vol(b.panel, 13, 52))
query(
    "sma",
    f"{P} {sel(date='date', asset='asset', sma_short='~CASE WHEN count(price) OVER a = 6 THEN avg(price) OVER a END', sma_long='~CASE WHEN count(price) OVER b = 40 THEN avg(price) OVER b END')} FROM panel WINDOW a AS (PARTITION BY asset ORDER BY session ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY asset ORDER BY session ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)",
)(lambda b: returns.moving_averages(b.panel, 6, 40))
query("normalised_prices", f"{P}, cp AS (SELECT * FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(price) = count(*))) {sel(date='date', asset='asset', growth='~price / first_value(price) OVER (PARTITION BY asset ORDER BY session)')} FROM cp")(lambda b: returns.normalised(b.panel))
query("yearly_returns", f"{P} {sel(asset='asset', year='#year(date)', year_return='~exp(sum(ln(1 + s))) - 1')} FROM ret WHERE s IS NOT NULL GROUP BY asset, year(date)")(lambda b: returns.yearly(b.panel))
query("wealth_paths", f"{P} {sel(date='date', asset='asset', additive='~1 + sum(s) OVER t', compounded='~exp(sum(ln(1 + s)) OVER t)')} FROM ret WHERE s IS NOT NULL WINDOW t AS (PARTITION BY asset ORDER BY session)")(lambda b: returns.wealth_paths(b.panel))
query(
    "train_test_split",
    f"{P}, nn AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY session) AS i, count(*) OVER (PARTITION BY asset) AS n FROM ret WHERE s IS NOT NULL) {sel(date='date', asset='asset', s='~s', part='''CASE WHEN i <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' ELSE 'test' END''')} FROM nn",
)(lambda b: returns.split_rows(b.panel))
query(
    "return_inventory",
    f"""{P}, pd AS (SELECT 'weekly' AS freq, date AS d, asset, sum(r) AS lr FROM ret WHERE session > 1 GROUP BY 1, 2, 3 UNION ALL SELECT 'monthly', last_day(date), asset, sum(r) FROM ret WHERE session > 1 GROUP BY 1, 2, 3),
    pb AS (SELECT freq, d, count(*) - count(lr) AS missing FROM pd GROUP BY freq, d) {sel(freq='freq', periods='#count(*)', complete='#count(*) FILTER (missing = 0)', first='min(d)', last='max(d)')} FROM pb GROUP BY freq""",
)(lambda b: returns.inventory(b.panel))
query("returns_excluding", f"{P} {sel(asset='asset', n='#count(*)', mean='~avg(x)')} FROM x WHERE NOT (date BETWEEN DATE '{STRESS[0]}' AND DATE '{STRESS[1]}') GROUP BY asset")(lambda b: returns.without(b.r, *STRESS).groupBy("asset").agg(F.count("x").alias("n"), F.avg("x").alias("mean")))
query(
    "returns_halves",
    f"{P}, hh AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM x), h2 AS (SELECT *, CASE WHEN i < n // 2 THEN 1 ELSE 2 END AS half FROM hh) {sel(asset='asset', half='#half', n='#count(*)', sd='~stddev_samp(x)')} FROM h2 GROUP BY asset, half",
)(lambda b: returns.halves(b.r).groupBy("asset", "half").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd")))
query("sector_growth", f"{P} {sel(sector='sector', growth='~median(g)')} FROM (SELECT asset, max_by(price, session) / min_by(price, session) AS g FROM panel WHERE price IS NOT NULL GROUP BY asset) JOIN uni USING (asset) GROUP BY sector")(
    lambda b: b.panel.filter("price is not null").groupBy("asset").agg((F.max_by("price", "session") / F.min_by("price", "session")).alias("g")).join(b.universe, "asset").groupBy("sector").agg(F.median("g").alias("growth"))
)

# ---- dependence ----
def _pairs(b: Lab) -> DataFrame:
    return dependence.pair_moments(panel.log_returns(b.panel))


_SEC = o.PAIRS + ", ps AS (SELECT pr.*, u.sector AS sa, v.sector AS sb FROM pr JOIN uni u ON a = u.asset JOIN uni v ON b = v.asset)"
query("corr_matrix", f"{P}{o.PAIRS} {sel(a='a', b='b', corr='~corr', cov='~cov', n='#n')} FROM pr")(_pairs)
query(
    "corr_summary",
    f"{P}{_SEC} {sel(mean_corr='~avg(corr)', within='~avg(corr) FILTER (sa = sb)', across='~avg(corr) FILTER (sa <> sb)', max_pair='''max_by(a || '/' || b, corr)''', min_pair='''min_by(a || '/' || b, corr)''', n_negative='#count(*) FILTER (corr < 0)')} FROM ps WHERE a < b",
)(lambda b: dependence.summary(_pairs(b), b.universe))
query("corr_by_sector", f"{P}{_SEC} {sel(sector='sa', within='~avg(corr) FILTER (sa = sb)', with_benchmark=f'''~avg(corr) FILTER (b = '{BENCHMARK}')''', n_negative='#count(*) FILTER (corr < 0)')} FROM ps WHERE a <> b GROUP BY sa")(
    lambda b: dependence.by_sector(_pairs(b), b.universe, BENCHMARK)
)
query("corr_with_others", f"{P}{o.PAIRS} {sel(asset='a', mean_corr='~avg(corr)', sd_corr='~stddev_samp(corr)')} FROM pr WHERE a <> b GROUP BY a")(lambda b: dependence.with_others(_pairs(b)))


def _top(tag: str, source: str, squarings: int = 12) -> str:
    """CTEs that end in {tag}(value), the largest eigenvalue of source(a, b, x)."""
    out, last = "", source
    for k in range(squarings):
        out += f", {tag}p{k} AS MATERIALIZED (SELECT l.a, r.b, sum(l.x * r.x) AS x FROM {last} l JOIN {last} r ON l.b = r.a GROUP BY 1, 2), {tag}q{k} AS MATERIALIZED (SELECT a, b, x / (SELECT sum(x) FROM {tag}p{k} WHERE a = b) AS x FROM {tag}p{k})"
        last = f"{tag}q{k}"
    return out + f", {tag} AS MATERIALIZED (SELECT (SELECT sum(p.x * m.x) FROM {last} p JOIN {source} m USING (a, b)) / (SELECT sum(x) FROM {last} WHERE a = b) AS value)"


query(
    "corr_spectrum",
    f"{P}{o.PAIRS}, c0 AS MATERIALIZED (SELECT a, b, corr AS x FROM pr){_top('ev', 'c0')}, c1 AS MATERIALIZED (SELECT a, b, CASE WHEN a = b THEN (SELECT value FROM ev) ELSE 0 END - x AS x FROM c0){_top('ew', 'c1')}, "
    + f"ez AS (SELECT sum(CASE WHEN a = b THEN x END) AS trace, sum(x * x) AS squares FROM c0) {sel(trace='~trace', squares='~squares', first_share='~ev.value / trace', smallest='~ev.value - ew.value', condition='~ev.value / (ev.value - ew.value)')} FROM ev, ew, ez",
)(lambda b: dependence.spectrum(_pairs(b)))

# ---- statistics ----
M = P + o.MOMENTS
query(
    "describe_freq",
    f"{M} {sel(asset='asset', n='#n', mean='~m', sd='~sd', min='~lo', max='~hi', skew='~skew', kurt='~kurt', q_skew='~(q95 + q05 - 2 * q50) / (q95 - q05)', jb='~n / 6 * (skew * skew + kurt * kurt / 4)', jb_p='~exp(-(n / 6 * (skew * skew + kurt * kurt / 4)) / 2)', skew_se='~sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))')} FROM mom",
)(lambda b: statistics.describe(b.r))
query(
    "tail_quantiles",
    P
    + ", tq AS ("
    + " UNION ALL ".join(f"SELECT asset, {p}::DOUBLE AS level, {z}::DOUBLE AS z, quantile_cont(x, {p}) AS e, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY asset" for p, z in TAIL_Z.items())
    + f") {sel(asset='asset', level='~level', empirical='~e', normal='~m + z * s', ratio='~(e - m) / (z * s)')} FROM tq",
)(lambda b: statistics.tail_quantiles(b.r))
query(
    "exceedances",
    P
    + ", zz AS (SELECT asset, abs(x - avg(x) OVER (PARTITION BY asset)) / stddev_samp(x) OVER (PARTITION BY asset) AS z FROM x), ez AS ("
    + " UNION ALL ".join(f"SELECT asset, {k} AS sigma, count(*) FILTER (z > {k}) AS observed, count(*) * {p}::DOUBLE AS expected FROM zz GROUP BY asset" for k, p in TAIL_SF.items())
    + f") {sel(asset='asset', sigma='#sigma', observed='#observed', expected='~expected')} FROM ez",
)(lambda b: statistics.exceedances(b.r))
LAGS, Q_LAGS = 40, (5, 10, 20)
_L = o.lagged(LAGS) + o.lagged(LAGS, "abs(x)", "_a") + o.lagged(LAGS, "x * x", "_s")
query(
    "acf_lags",
    f"{P}{_L} {sel(asset='c.asset', lag='#c.lag', raw='~c.xs / c.ss', band='~1.96 / sqrt(c.n)', robust_band='~1.96 * sqrt(c.xs2 / (c.n - c.lag) / ((c.ss / c.n) * (c.ss / c.n)) / c.n)', absolute='~a.xs / a.ss', squared='~s.xs / s.ss')} FROM lagged c JOIN lagged_a a ON a.asset = c.asset AND a.lag = c.lag JOIN lagged_s s ON s.asset = c.asset AND s.lag = c.lag",
)(lambda b: statistics.acf(b.r, LAGS))
query(
    "robust_portmanteau",
    P + o.lagged(20) + ", rp AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS lags, sum(xs * xs / xs2) AS q FROM lagged WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS) + ") "
    + sel(asset="asset", lags="#lags", q="~q", p="~" + o.at_lags(Q_LAGS)) + " FROM rp",
)(lambda b: statistics.robust_portmanteau(b.r, Q_LAGS))
query(
    "ljung_box",
    P + _L + ", lb AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS lags, '{t}' AS transform, any_value(n) * (any_value(n) + 2) * sum(xs / ss * xs / ss / (n - lag)) AS q FROM lagged{s} WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS for t, s in (("raw", ""), ("absolute", "_a"), ("squared", "_s"))) + ") "
    + sel(asset="asset", lags="#lags", transform="transform", q="~q", p="~" + o.at_lags(Q_LAGS)) + " FROM lb",
)(lambda b: statistics.ljung_box(b.r, Q_LAGS))
query(
    "stress_sensitivity",
    f"""{P}, bo AS (SELECT *, 'full' AS sample FROM x UNION ALL SELECT *, 'excluding' FROM x WHERE NOT (date BETWEEN DATE '{STRESS[0]}' AND DATE '{STRESS[1]}')),
    bl AS (SELECT *, lag(x) OVER (PARTITION BY asset, sample ORDER BY date) AS prev, x - avg(x) OVER (PARTITION BY asset, sample) AS d FROM bo)
    {sel(asset='asset', sample='sample', n='#count(*)', skew='~avg(d * d * d) / power(avg(d * d), 1.5)', kurt='~avg(d * d * d * d) / power(avg(d * d), 2) - 3', autocorr='~corr(x, prev)')} FROM bl GROUP BY asset, sample""",
)(lambda b: statistics.stress_sensitivity(b.r, *STRESS))
query(
    "historical_var",
    f"{P}, hq AS (SELECT asset, quantile_cont(x / 100, 0.05) AS q, avg(CASE WHEN x / 100 <= -0.02 THEN 1.0::DOUBLE ELSE 0 END) AS ecdf FROM x GROUP BY asset), hc AS (SELECT x.asset, avg(x / 100) AS mb FROM x JOIN hq USING (asset) WHERE x / 100 <= q GROUP BY 1) {sel(asset='asset', var_log='~-q', var_simple='~1 - exp(q)', cvar='~-mb', ecdf='~ecdf')} FROM hq JOIN hc USING (asset)",
)(lambda b: statistics.historical_var(b.r.select("date", "asset", (F.col("x") / 100).alias("x"))))
query("autocovariance", f"{P}{o.lagged(10)} {sel(asset='asset', lag='#lag', autocov='~xs / n')} FROM lagged")(lambda b: statistics.autocovariance(b.r, 10))
query("qq_points", f"{P}, qz AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY x, date) AS i, count(*) OVER (PARTITION BY asset) AS n, (x - avg(x) OVER (PARTITION BY asset)) / stddev_samp(x) OVER (PARTITION BY asset) AS z FROM x) {sel(asset='asset', i='#i', prob='~(i - 0.5) / n', z='~z')} FROM qz")(lambda b: statistics.qq_points(b.r))
query(
    "histogram",
    f"""{P}, hs AS (SELECT asset, min(x) AS lo, max(x) AS hi, count(*) AS n, least(greatest(floor(1.5 * sqrt(count(*))), 20), 120)::INT AS bins FROM x GROUP BY asset),
    hb AS (SELECT asset, least(floor((x - lo) / (hi - lo) * bins), bins - 1)::INT AS bin, n, bins, lo, hi FROM x JOIN hs USING (asset))
    {sel(asset='asset', bin='#bin', c='#count(*)', density='~count(*) / any_value(n)::DOUBLE * any_value(bins) / (any_value(hi) - any_value(lo))')} FROM hb GROUP BY asset, bin""",
)(lambda b: statistics.histogram(b.r))
query(
    "box_stats",
    f"""{P}, bq AS (SELECT asset, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY asset)
    {sel(asset='x.asset', q1='~any_value(q1)', median='~any_value(q2)', q3='~any_value(q3)', low='~min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', high='~max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', outliers='#count(*) FILTER (NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))')} FROM x JOIN bq USING (asset) GROUP BY x.asset""",
)(lambda b: statistics.box_stats(b.r))

# ---- experiments and backtests ----
E, W, S, R, T = o.EXPERIMENTS, o.WEIGHTS, o.SEGMENTS, o.returns(), o.METRICS
query("experiments", f"{E} {sel(experiment='#experiment', anchor='#anchor', asset='asset')} FROM ea")(lambda b: b.exp_asset)
query("experiment_windows", f"{E} {sel(experiment='#experiment', asset='asset', pos='#pos', date='date', price='~price', s='~s')} FROM win")(lambda b: b.windows)
query("rebalance_schedule", f"{E} {sel(experiment='#experiment', k='#k', execution='#execution', formation='#formation', first='#first', earns='#execution + 1')} FROM tr")(lambda b: b.trades)
query("lookahead_violations", f"{E}, lu AS (SELECT experiment, k, max(pos) AS u FROM er GROUP BY 1, 2) {sel(violations='#count(*) FILTER (u IS NULL OR first > formation OR u > formation OR formation >= execution OR execution >= execution + 1)', trades='#count(*)')} FROM tr LEFT JOIN lu USING (experiment, k)")(
    lambda b: sampler.lookahead_violations(sampler.with_last_used(b.trades, b.rows))
)
query("estimates", f"{E} {sel(experiment='#experiment', k='#k', asset='asset', mean='~mean', sd='~sd', n='#n')} FROM est")(lambda b: strategies.estimates(b.rows))
query(
    "pair_covariances",
    f"{E}, ec AS (SELECT a.experiment, a.k, a.asset AS a, b.asset AS b, covar_samp(a.s, b.s) AS cov, corr(a.s, b.s) AS corr FROM er a JOIN er b ON a.experiment = b.experiment AND a.k = b.k AND a.pos = b.pos GROUP BY 1, 2, 3, 4) {sel(experiment='#experiment', k='#k', a='a', b='b', cov='~cov', corr='~corr')} FROM ec",
)(lambda b: strategies.pair_covariances(b.rows))
query("bt_weights", f"{W} {sel(experiment='#experiment', strategy='strategy', k='#k', asset='asset', w='~w')} FROM w")(lambda b: b.relational.drop("error"))
query("bt_daily_weights", f"{S} {sel(experiment='#experiment', strategy='strategy', asset='asset', pos='#pos', weight='~weight')} FROM dw")(lambda b: _runs(b).daily_weights.drop("date"))
query("bt_trades_cost", f"{S} {sel(experiment='#experiment', strategy='strategy', k='#k', execution='#execution', turnover='~turnover', cost='~cost')} FROM td")(lambda b: _runs(b).traded.select("experiment", "strategy", "k", "execution", "turnover", "cost"))
query("bt_returns", f"{R} {sel(experiment='#experiment', strategy='strategy', basis='basis', pos='#pos', date='date', ret='~ret')} FROM rt")(lambda b: _runs(b).returns)
query("bt_wealth", f"{R}{o.PATH} {sel(experiment='#experiment', strategy='strategy', basis='basis', pos='#pos', wealth='~wealth')} FROM wl")(lambda b: backtest.wealth(_runs(b).returns).drop("date", "ret"))
query("bt_turnover", f"{S} {sel(experiment='#experiment', strategy='strategy', turnover='~coalesce(sum(turnover) FILTER (k > 0), 0)', total_cost='~sum(cost)')} FROM td GROUP BY experiment, strategy")(lambda b: backtest.turnover(_runs(b).traded, SCHEDULE))
_FEES = {f"{f}bp": f / 3.5 for f in (0, 5, 10, 20, 50)}
query(
    "bt_fee_grid",
    f"{o.returns(', '.join(f'''('{n}', {m!r}::DOUBLE)''' for n, m in _FEES.items()))} {sel(strategy='strategy', basis='basis', growth='~median(g)')} FROM (SELECT experiment, strategy, basis, exp(sum(ln(1 + ret))) AS g FROM rt GROUP BY 1, 2, 3) GROUP BY strategy, basis",
)(lambda b: Runs(b, b.relational, _FEES).returns.groupBy("experiment", "strategy", "basis").agg(F.exp(F.sum(F.log1p("ret"))).alias("g")).groupBy("strategy", "basis").agg(F.median("g").alias("growth")))
query(
    "bt_buy_hold",
    f"{W}, fw AS (SELECT w.experiment, strategy, asset, w.w FROM w WHERE k = 0), bh AS (SELECT experiment, strategy, pos, sum(w * p) AS v FROM (SELECT f.*, win.pos, price / first_value(price) OVER (PARTITION BY experiment, strategy, asset ORDER BY pos) AS p FROM fw f JOIN win USING (experiment, asset) WHERE pos >= {SCHEDULE.estimation}) GROUP BY 1, 2, 3) {sel(experiment='#experiment', strategy='strategy', pos='#pos', wealth='~v')} FROM bh",
)(
    lambda b: backtest.segments(backtest.effective(b.relational.filter("k = 0"), b.trades), b.windows, SCHEDULE).groupBy("experiment", "strategy", "pos").agg(F.first("v").alias("wealth"))
)
query(
    "bt_fixed_mix",
    f"{W}, fm AS (SELECT win.experiment, strategy, win.pos, sum(w * s) AS ret FROM win JOIN (SELECT * FROM w WHERE k = 0) f ON win.experiment = f.experiment AND win.asset = f.asset WHERE win.pos > {SCHEDULE.estimation} GROUP BY 1, 2, 3) {sel(experiment='#experiment', strategy='strategy', pos='#pos', ret='~ret')} FROM fm",
)(lambda b: backtest.fixed_mix(b.windows, b.relational, SCHEDULE).drop("date"))
query(
    "bt_design",
    f"""{E}, st AS (SELECT experiment, any_value(anchor) AS anchor, list(asset ORDER BY asset) AS l FROM ea GROUP BY 1), sh AS (SELECT len(list_intersect(a.l, b.l)) AS c FROM st a JOIN st b ON a.experiment < b.experiment),
    iv AS (SELECT DISTINCT unnest(range(anchor + {SCHEDULE.estimation + 1}, anchor + {SCHEDULE.window + 1})) AS session FROM st)
    {sel(experiments='#(SELECT count(*) FROM st)', subsets='#(SELECT count(DISTINCT l) FROM st)', median_shared='~quantile_cont(c, 0.5)', max_shared='#max(c)', coverage='~(SELECT avg(CASE WHEN iv.session IS NULL THEN 0.0::DOUBLE ELSE 1 END) FROM cal LEFT JOIN iv USING (session) WHERE cal.session >= (SELECT min(anchor) FROM st))')} FROM sh""",
)(lambda b: backtest.design(b.exp_asset, b.cal, SCHEDULE))
query(
    "bt_inclusion",
    f"{E}, ic AS (SELECT asset, count(*) AS n, list_sort(list(anchor)) AS l FROM ea GROUP BY 1) {sel(asset='uni.asset', sector='sector', n='#coalesce(n, 0)', first='#l[1]', middle='#l[len(l) // 2 + 1]', last='#l[len(l)]')} FROM uni LEFT JOIN ic ON uni.asset = ic.asset",
)(lambda b: backtest.inclusion(b.exp_asset, b.universe))
query("evaluation_years", f"{E} {sel(year='#year(date)', n='#count(*)')} FROM win WHERE pos = {SCHEDULE.estimation + 1} AND asset = (SELECT min(asset) FROM ea e WHERE e.experiment = win.experiment) GROUP BY year(date)")(
    lambda b: b.windows.filter(F.col("pos") == SCHEDULE.estimation + 1).groupBy("experiment").agg(F.year(F.min("date")).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
)
_W8 = o.ALL_WEIGHTS
query("bt_solved_checks", f"{E}{o.solved_weights()} {sel(strategy='strategy', n='#count(*)', failed='#count(*) FILTER (w IS NULL)', least='~min(w)', most='~max(w)')} FROM sw GROUP BY strategy")(
    lambda b: b.solved.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.min("w").alias("least"), F.max("w").alias("most"))
)
query(
    "strategy_distances",
    f"{_W8}, dd AS (SELECT x.strategy AS a, y.strategy AS b, x.experiment, x.k, sum(abs(x.w - y.w)) / 2 AS d FROM w x JOIN w y ON x.experiment = y.experiment AND x.k = y.k AND x.asset = y.asset AND x.strategy < y.strategy GROUP BY 1, 2, 3, 4) {sel(a='a', b='b', distance='~avg(d)', coincide='~avg(CASE WHEN d < 1e-4 THEN 1.0::DOUBLE ELSE 0 END)')} FROM dd GROUP BY a, b",
)(lambda b: strategies.distances(b.solved.unionByName(b.relational)))
query(
    "risk_contributions",
    f"{E}{o.solved_weights()}, rk AS (SELECT experiment, k, a AS asset, sum(x.w * y.w * c * s.sd * t.sd) AS part FROM ec JOIN sw x USING (experiment, k) JOIN sw y USING (experiment, k) JOIN est s USING (experiment, k) JOIN est t USING (experiment, k) WHERE x.strategy = 'ERC' AND y.strategy = 'ERC' AND x.asset = a AND y.asset = b AND s.asset = a AND t.asset = b GROUP BY 1, 2, 3) "
    + sel(experiment="#experiment", strategy="'ERC'", k="#k", asset="asset", share="~part / sum(part) OVER (PARTITION BY experiment, k)") + " FROM rk",
)(lambda b: strategies.risk_contributions(b.solved.filter("strategy = 'ERC'"), strategies.pair_covariances(b.rows)))
query(
    "bt_failures",
    f"""{E}{o.solved_weights()}, fl AS (SELECT experiment, k, any_value(rf) * {SCHEDULE.periods} AS rate FROM est JOIN rw USING (experiment, k) GROUP BY 1, 2 HAVING max(mean - rf) <= 0)
    {sel(experiment='#experiment', strategy="'MSR'", k='#k', error="format('Infeasible: no expected return above the risk-free rate of {:.2f}%', 100 * rate)", fallback="CASE WHEN k = 0 THEN 'equal weights' ELSE 'held weights' END")} FROM fl""",
)(lambda b: backtest.failures(b.solved))
query("solved_metrics", f"{o.ALL_METRICS} {sel(experiment='#experiment', strategy='strategy', basis='basis', n='#n', ann_return='~ann_return', ann_vol='~ann_vol', sharpe='~sharpe', sortino='~sortino', max_dd='~max_dd', calmar='~calmar', sterling='~sterling')} FROM m")(lambda b: Runs(b, b.solved.unionByName(b.relational)).metrics)

# ---- performance ----
def _metrics(b: Lab) -> DataFrame:
    """Metrics of the runs, written once for a query that reads them more than once."""
    if not hasattr(b, "metrics"):
        b.metrics = written(_runs(b).metrics)
    return b.metrics


query("run_metrics", f"{T} {sel(experiment='#experiment', strategy='strategy', basis='basis', n='#n', ann_return='~ann_return', ann_vol='~ann_vol', sharpe='~sharpe', sortino='~sortino', max_dd='~max_dd', calmar='~calmar', sterling='~sterling')} FROM m")(lambda b: _runs(b).metrics)
query("win_rate", f"{T} {sel(strategy='strategy', basis='basis', beats_pct='~' + o.share('sharpe > b_sharpe'))} FROM ag2 GROUP BY strategy, basis")(lambda b: performance.win_rates(_metrics(b)))
query("headline", f"{T} {sel(strategy='strategy', basis='basis', ann_return='~median(ann_return) * 100', ann_vol='~median(ann_vol) * 100', sharpe='~median(sharpe)', max_dd='~median(max_dd) * 100', sterling='~median(sterling)')} FROM m GROUP BY strategy, basis")(lambda b: performance.headline(_runs(b).metrics))
query("dispersion", f"{T} {sel(strategy='strategy', basis='basis', median='~median(sharpe)', iqr='~quantile_cont(sharpe, 0.75) - quantile_cont(sharpe, 0.25)', p10='~quantile_cont(sharpe, 0.1)', p90='~quantile_cont(sharpe, 0.9)')} FROM m GROUP BY strategy, basis")(lambda b: performance.dispersion(_runs(b).metrics))
query(
    "cost_impact",
    f"{T} {sel(strategy='a.strategy', sharpe_before='~median(a.sharpe)', sharpe_after='~median(b.sharpe)', difference='~median(b.sharpe - a.sharpe)', drag_bp='~median(a.ann_return - b.ann_return) * 1e4')} FROM m a JOIN m b ON a.experiment = b.experiment AND a.strategy = b.strategy AND a.basis = 'gross' AND b.basis = 'net' GROUP BY a.strategy",
)(lambda b: performance.cost_impact(_metrics(b)))
query(
    "paired",
    f"{T} {sel(strategy='strategy', basis='basis', d_sharpe='~median(sharpe - b_sharpe)', beats_pct='~' + o.share('sharpe > b_sharpe'), d_return_pp='~median(ann_return - b_ann_return) * 100', d_vol_pp='~median(ann_vol - b_ann_vol) * 100', lower_vol_pct='~' + o.share('ann_vol < b_ann_vol'), d_dd_pp='~median(max_dd - b_max_dd) * 100', shallower_pct='~' + o.share('max_dd > b_max_dd'))} FROM ag2 GROUP BY strategy, basis",
)(lambda b: performance.paired(_metrics(b)))
query("representative", f"{T}, rk AS (SELECT *, row_number() OVER (PARTITION BY strategy, basis ORDER BY sharpe NULLS FIRST, experiment) AS nth, count(*) OVER (PARTITION BY strategy, basis) AS o FROM m) {sel(strategy='strategy', basis='basis', experiment='#experiment', sharpe='~sharpe')} FROM rk WHERE nth = (o - 1) // 2 + 1")(
    lambda b: performance.representative(_metrics(b))
)
query(
    "terciles",
    f"{T}, ow AS (SELECT experiment, sharpe FROM m WHERE strategy = 'EW' AND basis = 'net'), ed AS (SELECT quantile_cont(sharpe, 0.3333333333333333) AS a, quantile_cont(sharpe, 0.6666666666666666) AS b FROM ow) {sel(experiment='#experiment', sharpe='~sharpe', regime='''CASE WHEN sharpe <= a THEN 'low' WHEN sharpe <= b THEN 'middle' ELSE 'high' END''')} FROM ow, ed",
)(lambda b: performance.regimes(_metrics(b)))
query(
    "replication_metrics",
    f"""{R}{o.PATH}, dm AS (SELECT *, ret - avg(ret) OVER (PARTITION BY experiment, strategy, basis) AS d FROM fl),
    rm AS (SELECT experiment, strategy, basis, avg(ret) * 52 AS ann_return, stddev_samp(ret) * sqrt(52) AS ann_vol, -least(min(fall), 0) AS max_dd, avg(fall) FILTER (fall < 0) AS mean_fall, {o.share('ret > 0')} AS win_pct,
           avg(d * d * d) / power(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / power(avg(d * d), 2) - 3 AS kurt FROM dm GROUP BY 1, 2, 3)
    {sel(experiment='#experiment', strategy='strategy', basis='basis', ann_return='~ann_return', ann_vol='~ann_vol', sharpe='~ann_return / nullif(ann_vol, 0)', max_dd='~max_dd', calmar='~ann_return / nullif(max_dd, 0)', sterling='~ann_return / nullif(-mean_fall, 0)', win_pct='~win_pct', skew='~skew', kurt='~kurt')} FROM rm""",
)(lambda b: performance.replication_metrics(_runs(b).returns, 52))

# ---- robustness ----
query(
    "cost_rank",
    f"{T}, md AS (SELECT strategy, basis, median(sharpe) AS ms FROM m GROUP BY 1, 2), wr AS (SELECT strategy, basis, {o.share('sharpe > b_sharpe')} AS bp FROM ag2 GROUP BY 1, 2) {sel(strategy='md.strategy', basis='md.basis', rank='#rank() OVER (PARTITION BY md.basis ORDER BY ms DESC)', median_sharpe='~ms', beats_pct='~bp')} FROM md LEFT JOIN wr ON md.strategy = wr.strategy AND md.basis = wr.basis",
)(lambda b: robustness.cost_ranking(_metrics(b)))
query("rank_gaps", f"{T}, md AS (SELECT strategy, basis, median(sharpe) AS ms FROM m GROUP BY 1, 2) {sel(strategy='strategy', basis='basis', median_sharpe='~ms', gap='~lag(ms) OVER (PARTITION BY basis ORDER BY ms DESC, strategy) - ms')} FROM md")(lambda b: robustness.rank_gaps(_metrics(b)))
query("crisis_exposure", f"{E}{o.CRISIS} {sel(experiment='#experiment', crisis='crisis')} FROM cr")(lambda b: robustness.crisis_groups(b.windows, SCHEDULE.estimation, *STRESS))
query(
    "crisis_split",
    f"{T}{o.CRISIS}, bo AS (SELECT ag2.*, crisis AS grp FROM ag2 JOIN cr USING (experiment) UNION ALL SELECT ag2.*, 'All' FROM ag2) {sel(basis='basis', grp='grp', strategy='strategy', n='#count(*)', d_sharpe='~median(sharpe - b_sharpe)', beats_pct='~' + o.share('sharpe > b_sharpe'), lower_vol_pct='~' + o.share('ann_vol < b_ann_vol'))} FROM bo GROUP BY basis, grp, strategy",
)(lambda b: robustness.split_table(_metrics(b), robustness.crisis_groups(b.windows, SCHEDULE.estimation, *STRESS), "crisis"))
_EFFECT = T + """, be AS (SELECT experiment, strategy, CASE WHEN sharpe > b_sharpe THEN 100.0::DOUBLE ELSE 0 END AS better FROM ag2 WHERE basis = 'net'),
tot AS (SELECT strategy, sum(better) AS s, count(*) AS n FROM be GROUP BY 1), hd AS (SELECT strategy, asset, sum(better) AS hs, count(*) AS hn FROM be JOIN ea USING (experiment) GROUP BY 1, 2),
ef AS (SELECT hd.strategy, asset, hn AS n_held, hs / hn - (s - hs) / nullif(n - hn, 0) AS effect_pp FROM hd JOIN tot ON hd.strategy = tot.strategy)"""
query("asset_effect", f"{_EFFECT} {sel(strategy='strategy', asset='asset', n_held='#n_held', effect_pp='~effect_pp')} FROM ef")(lambda b: robustness.asset_effect(_metrics(b), b.exp_asset, b.universe))
query("top_effects", f"{_EFFECT}, te AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(abs(effect_pp), 9) DESC NULLS LAST, asset) AS nth FROM ef) {sel(strategy='strategy', asset='asset', n_held='#n_held', effect_pp='~effect_pp', nth='#nth')} FROM te WHERE nth <= 3")(
    lambda b: robustness.top_effects(robustness.asset_effect(_metrics(b), b.exp_asset, b.universe).withColumn("effect_pp", F.round("effect_pp", 9)))
)
query(
    "noise_yardstick",
    f"{_EFFECT}, wr AS (SELECT strategy, {o.share('sharpe > b_sharpe')} / 100 AS p FROM ag2 WHERE basis = 'net' GROUP BY 1), nb AS (SELECT ef.*, 200 * sqrt(p * (1 - p) / n_held + p * (1 - p) / nullif({N_EXPERIMENTS} - n_held, 0)) AS band FROM ef JOIN wr ON ef.strategy = wr.strategy) {sel(strategy='strategy', asset='asset', effect_pp='~effect_pp', band_pp='~band', beyond='abs(effect_pp) > band')} FROM nb",
)(lambda b: robustness.noise_yardstick(robustness.asset_effect(_metrics(b), b.exp_asset, b.universe), N_EXPERIMENTS, performance.win_rates(_metrics(b)).filter("basis = 'net'").select("strategy", "beats_pct")))
_CONC = S + ", cd AS (SELECT experiment, strategy, pos, max(weight) AS top, 1 / sum(weight * weight) AS eff FROM dw GROUP BY 1, 2, 3), cn AS (SELECT experiment, strategy, avg(top) AS mw, avg(eff) AS en, avg(CASE WHEN top > 0.99 THEN 1.0::DOUBLE ELSE 0 END) AS sa FROM cd GROUP BY 1, 2)"
query("concentration", f"{_CONC} {sel(experiment='#experiment', strategy='strategy', max_weight='~mw', effective_n='~en', single_asset='~sa')} FROM cn")(lambda b: robustness.concentration(_runs(b).daily_weights))
query("concentration_table", f"{_CONC} {sel(strategy='strategy', max_weight_pct='~avg(mw) * 100', effective_n='~avg(en)', lowest_n='~min(en)', single_pct='~avg(sa) * 100')} FROM cn GROUP BY strategy")(lambda b: robustness.concentration_table(robustness.concentration(_runs(b).daily_weights)))
query("exposure", f"{S}, ex AS (SELECT experiment, strategy, pos, sum(weight * cost_bp) AS x FROM dw JOIN uni USING (asset) GROUP BY 1, 2, 3) {sel(experiment='#experiment', strategy='strategy', exposure='~avg(x)')} FROM ex GROUP BY experiment, strategy")(
    lambda b: robustness.exposure(_runs(b).daily_weights, b.universe.select("asset", F.col("cost_bp").alias("value")))
)
query("sector_exposure", f"{S}, ex AS (SELECT experiment, strategy, pos, sum(weight) AS x FROM dw JOIN uni USING (asset) WHERE sector = 'ASIA' GROUP BY 1, 2, 3) {sel(experiment='#experiment', strategy='strategy', exposure='~avg(x)')} FROM ex GROUP BY experiment, strategy")(
    lambda b: robustness.exposure(_runs(b).daily_weights, b.universe.filter("sector = 'ASIA'").select("asset", F.lit(1.0).alias("value")))
)
query(
    "max_pair_corr",
    f"{E}, mc AS (SELECT a.experiment, a.asset || '/' || b.asset AS pair, corr(a.s, b.s) AS c FROM win a JOIN win b ON a.experiment = b.experiment AND a.pos = b.pos AND a.asset < b.asset WHERE a.pos > {SCHEDULE.estimation - SCHEDULE.lookback} AND a.pos <= {SCHEDULE.estimation} GROUP BY 1, 2) {sel(experiment='#experiment', max_corr='~max(c)', pair='max_by(pair, c)')} FROM mc GROUP BY experiment",
)(lambda b: robustness.max_pair_correlation(b.windows, SCHEDULE.estimation, SCHEDULE.lookback))
query("stock_association", f"{T}, sd AS (SELECT ag2.experiment, strategy, sharpe - b_sharpe AS d FROM ag2 WHERE basis = 'net') {sel(strategy='strategy', asset='asset', n='#count(*)', win_pct='~' + o.share('d > 0'), mean_d='~avg(d)')} FROM sd JOIN ea USING (experiment) GROUP BY strategy, asset HAVING count(*) >= 5")(
    lambda b: robustness.stock_association(_metrics(b), b.exp_asset)
)
query(
    "period_association",
    f"{T}, yr AS (SELECT experiment, year(min(date)) AS y FROM win WHERE pos = {SCHEDULE.estimation + 1} GROUP BY 1), pd AS (SELECT strategy, y, sharpe - b_sharpe AS d FROM ag2 JOIN yr USING (experiment) WHERE basis = 'net') {sel(strategy='strategy', year='#y', n='#count(*)', wins='#count(*) FILTER (d > 0)', mean_d='~avg(d)', median_d='~median(d)')} FROM pd GROUP BY strategy, y",
)(lambda b: robustness.period_association(_metrics(b), b.windows, SCHEDULE.estimation))
query("median_by_year", f"{T}, yr AS (SELECT experiment, year(min(date)) AS y FROM win WHERE pos = {SCHEDULE.estimation + 1} GROUP BY 1) {sel(strategy='strategy', year='#y', sharpe='~median(sharpe)')} FROM m JOIN yr USING (experiment) WHERE basis = 'net' GROUP BY strategy, y")(
    lambda b: _metrics(b).filter("basis = 'net'").join(b.windows.filter(F.col("pos") == SCHEDULE.estimation + 1).groupBy("experiment").agg(F.year(F.min("date")).alias("year")), "experiment").groupBy("strategy", "year").agg(F.median("sharpe").alias("sharpe"))
)


# ---- more audits, tests and tables ----
query("data_checks", f"{P} {sel(asset='asset', n='#count(*)', missing='#count(*) FILTER (price IS NULL)', not_positive='#count(*) FILTER (price <= 0)', not_finite='#count(*) FILTER (isnan(price) OR isinf(price))')} FROM obs GROUP BY asset")(lambda b: panel.data_checks(b.obs))
query("complete_rows", f"{D}, mi AS (SELECT date FROM ret GROUP BY date HAVING count(r) = count(*)) {sel(date='date', asset='asset', r='~r')} FROM ret WHERE date IN (SELECT date FROM mi)", "daily")(lambda b: panel.complete_rows(panel.log_returns(b.panel)).select("date", "asset", "r"))
#: CTEs after panel that end in un(session, date, asset, adj, raw, income, split) and ac(date, asset, dividend, split): what is traded, and actions read off order lines.
_EVENTS = f""", cx AS (
  SELECT {o._PERIOD['weekly']} AS date, n_name AS asset, coalesce(avg(CASE WHEN l_quantity = 1 AND l_discount > 0.095 THEN l_tax / 4 END), 0) AS income,
         coalesce(max(CASE WHEN l_quantity = 50 AND l_discount > 0.095 AND l_tax > 0.075 THEN CASE l_returnflag WHEN 'R' THEN 2.0::DOUBLE WHEN 'A' THEN 3.0 ELSE 1.25 END END), 0) AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
ua AS (SELECT p.session, p.date, p.asset, price AS adj, CASE WHEN lag(price) OVER s IS NULL THEN 0 ELSE coalesce(income, 0) END AS income, CASE WHEN lag(price) OVER s IS NULL THEN 0 ELSE coalesce(split, 0) END AS split
       FROM panel p LEFT JOIN cx ON p.date = cx.date AND p.asset = cx.asset WHERE price IS NOT NULL WINDOW s AS (PARTITION BY p.asset ORDER BY p.session)),
un AS (SELECT *, adj * exp(-coalesce(sum(ln(1 - income) - ln(CASE WHEN split > 0 THEN split ELSE 1 END)) OVER (PARTITION BY asset ORDER BY session DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS raw FROM ua),
ac AS (SELECT session, date, asset, raw, coalesce(income * lag(raw) OVER (PARTITION BY asset ORDER BY session), 0) AS dividend, split FROM un)"""


def _actions(b: Lab) -> DataFrame:
    """session, date, asset, price, dividend and split: prices as traded, with the corporate actions of order lines."""
    if not hasattr(b, "acted"):
        b.acted = written(panel.unadjusted(b.panel, market.actions(b.spark, b.sf_dir, b.freq, b.level)))
    return b.acted


_ADJUSTED = f"""{P}{_EVENTS},
    sp AS (SELECT asset, min(date) AS f, max(date) AS l, min_by(adj, date) AS a0, max_by(adj, date) AS a1, min_by(raw, date) AS r0, max_by(raw, date) AS r1 FROM un GROUP BY asset),
    ev AS (SELECT ac.asset, count(*) FILTER (dividend <> 0) AS nd, count(*) FILTER (split <> 0) AS ns FROM ac JOIN sp ON ac.asset = sp.asset WHERE date > f AND date <= l GROUP BY 1),
    cg AS (SELECT *, power(a1 / a0, 365.25::DOUBLE / (l - f)) - 1 AS ac, power(r1 / r0, 365.25::DOUBLE / (l - f)) - 1 AS rc FROM sp)"""


def _adjustment(b: Lab) -> DataFrame:
    return panel.adjustment_table(b.panel, _actions(b), _actions(b))


query("traded_prices", f"{P}{_EVENTS} {sel(session='session', date='date', asset='asset', price='~raw', dividend='~dividend', split='~split')} FROM ac")(_actions)
# what the given series is lowered by must come out of the traded prices and actions again
query("readjusted_prices", f"{P} {sel(session='session', date='date', asset='asset', price='~price')} FROM panel WHERE price IS NOT NULL")(lambda b: panel.adjusted(_actions(b)))
query("adjustment_table", f"{_ADJUSTED} {sel(asset='cg.asset', first='f', last='l', adj_cagr='~ac', raw_cagr='~rc', gap='~ac - rc', dividends='#coalesce(nd, 0)', splits='#coalesce(ns, 0)')} FROM cg LEFT JOIN ev ON cg.asset = ev.asset")(_adjustment)
query("classified_actions", f"""{P}{_EVENTS} {sel(date='ac.date', asset='ac.asset', split='~split', kind="CASE WHEN abs(split - round(split)) < 1e-6 THEN 'split' ELSE 'spin-off' END", r='~r')} FROM ac JOIN ret ON ac.date = ret.date AND ac.asset = ret.asset WHERE split <> 0""")(lambda b: panel.classify_actions(_actions(b), panel.log_returns(b.panel)))
query("formatted_headline", f"""{T} {sel(strategy='strategy', basis='basis', ann_return="format('{:,.2f}', round(median(ann_return) * 100, 6))", n="format('{:,.0f}', sum(n)::DOUBLE)")} FROM m GROUP BY strategy, basis""")(
    lambda b: _metrics(b).groupBy("strategy", "basis").agg(formatting.fixed(F.round(F.median("ann_return") * 100, 6), 2).alias("ann_return"), formatting.fixed(F.sum("n").cast("double"), 0).alias("n"))
)
query("annual_table", f"{P}, an AS (SELECT asset, avg(s) * 52 AS r1, stddev_samp(s) * sqrt(52) AS v FROM ret WHERE s IS NOT NULL GROUP BY asset) {sel(asset='asset', ret='~r1', vol='~v', sharpe='~r1 / nullif(v, 0)')} FROM an")(lambda b: performance.annual_table(returns.simple_returns(b.panel), 52))
query(
    "downside_table",
    f"""{P}, ds AS (SELECT asset, session, s, avg(s) OVER (PARTITION BY asset) AS m, sum(s) OVER (PARTITION BY asset ORDER BY session) AS path FROM ret WHERE s IS NOT NULL),
    dm AS (SELECT *, max(path) OVER (PARTITION BY asset ORDER BY session) - path AS fall FROM ds),
    da AS (SELECT asset, sqrt(avg(power(least(s - m, 0), 2))) AS sd, quantile_cont(s, 0.05) AS q, max(fall) AS dd FROM dm GROUP BY asset),
    dc AS (SELECT ds.asset, -avg(s) AS cv FROM ds JOIN da ON ds.asset = da.asset WHERE s <= q GROUP BY 1)
    {sel(asset='da.asset', semi_dev='~sd', var='~-q', cvar='~cv', max_dd='~dd')} FROM da JOIN dc ON da.asset = dc.asset""",
)(lambda b: performance.downside_table(returns.simple_returns(b.panel)))
query(
    "quintile_weights",
    E + ", qr AS (SELECT experiment, k, asset, greatest(round_even(count(*) OVER p / 5.0::DOUBLE, 0), 1) AS sz, row_number() OVER (PARTITION BY experiment, k ORDER BY mean DESC, asset) AS a, row_number() OVER (PARTITION BY experiment, k ORDER BY mean / nullif(sd * sd, 0) DESC NULLS LAST, asset) AS b, row_number() OVER (PARTITION BY experiment, k ORDER BY mean / nullif(sd, 0) DESC NULLS LAST, asset) AS c FROM est WINDOW p AS (PARTITION BY experiment, k)), ql AS ("
    + " UNION ALL ".join(f"SELECT experiment, 'QNT {n}' AS strategy, k, asset, CASE WHEN {c} <= sz THEN 1 / sz ELSE 0.0::DOUBLE END AS w FROM qr" for n, c in (("mean", "a"), ("mean_var", "b"), ("mean_sd", "c")))
    + f") {sel(experiment='#experiment', strategy='strategy', k='#k', asset='asset', w='~w')} FROM ql",
)(lambda b: strategies.quintiles(strategies.estimates(b.rows)).drop("error"))


def _two(b: Lab) -> DataFrame:
    """Estimation rows of the first two assets of each experiment, for closed forms."""
    first = b.exp_asset.groupBy("experiment").agg(F.slice(F.sort_array(F.collect_list("asset")), 1, 2).alias("pair"))  # a subset each
    return b.rows.join(first, "experiment").filter(F.array_contains("pair", F.col("asset"))).drop("pair")


_TWO = E + """,
e2 AS (SELECT *, dense_rank() OVER (PARTITION BY experiment ORDER BY asset) AS rk FROM er),
c2 AS (SELECT a.experiment, a.k, a.asset AS a1, b.asset AS a2, var_samp(a.s) * 52 AS v1, var_samp(b.s) * 52 AS v2, covar_samp(a.s, b.s) * 52 AS c, avg(a.s) * 52 AS m1, avg(b.s) * 52 AS m2
       FROM e2 a JOIN e2 b ON a.experiment = b.experiment AND a.k = b.k AND a.pos = b.pos AND a.rk = 1 AND b.rk = 2 GROUP BY 1, 2, 3, 4),
x2 AS (SELECT *, least(greatest((v2 - c) / (v1 + v2 - 2 * c), 0), 1) AS gmv, (1 / sqrt(v1)) / (1 / sqrt(v1) + 1 / sqrt(v2)) AS iv, least(greatest(((m1 - m2) / 3.0::DOUBLE + v2 - c) / (v1 + v2 - 2 * c), 0), 1) AS mv,
              v2 * m1 - c * m2 AS y1, v1 * m2 - c * m1 AS y2 FROM c2),
r2 AS (SELECT *, CASE WHEN m1 <= 0 AND m2 <= 0 THEN NULL WHEN y1 >= 0 AND y2 >= 0 AND y1 + y2 > 0 THEN y1 / (y1 + y2) WHEN m1 / sqrt(v1) > m2 / sqrt(v2) THEN 1.0 ELSE 0.0 END AS msr FROM x2),
l2 AS (SELECT experiment, k, a1, a2, unnest(['GMV', 'MDP', 'ERC', 'MDC', 'MV', 'MSR']) AS strategy, unnest([gmv, iv, iv, 0.5::DOUBLE, mv, msr]) AS x FROM r2),
w2 AS (SELECT experiment, strategy, k, a1 AS asset, x AS w FROM l2 UNION ALL SELECT experiment, strategy, k, a2, 1 - x FROM l2)"""
for _name, _keep in (("gmv_n2", ("GMV",)), ("mv_n2", ("MV",)), ("msr_n2", ("MSR",)), ("risk_based_n2", ("MDP", "ERC", "MDC"))):
    query(_name, f"{_TWO} {sel(experiment='#experiment', strategy='strategy', k='#k', asset='asset', w='~w')} FROM w2 WHERE strategy IN ({', '.join(repr(x) for x in _keep)})")(
        lambda b, keep=_keep: strategies.solved(_two(b), SCHEDULE, names=keep).select("experiment", "strategy", "k", "asset", "w")
    )
query("solved_optimality", f"{E}, sk AS (SELECT DISTINCT experiment, k FROM tr) {sel(experiment='#experiment', k='#k', invested='true', long_only='true', calmer='true')} FROM sk")(
    lambda b: strategies.optimality(b.solved.filter("strategy = 'GMV'"), strategies.pair_covariances(b.rows)).select("experiment", "k", (F.abs(F.col("total") - 1) < 1e-9).alias("invested"), (F.col("least") >= 0).alias("long_only"), (F.col("variance") <= F.col("equal_variance") + 1e-12).alias("calmer"))
)
query("solved_weights", f"{E}{o.solved_weights()} {sel(experiment='#experiment', strategy='strategy', k='#k', asset='asset', w='~w')} FROM sw")(
    lambda b: b.solved.filter("w is not null").select("experiment", "strategy", "k", "asset", "w")
)
query("solved_weights_shrunk", f"{o.SHRINK}{o.solved_weights(shrunk=True)} {sel(experiment='#experiment', strategy='strategy', k='#k', asset='asset', w='~w')} FROM sw")(
    lambda b: b.solve(shrink=True).filter("w is not null").select("experiment", "strategy", "k", "asset", "w")
)
_SOLVED = ("GMV", "MV", "MDP", "MDC", "ERC")
query("solved_kkt", f"{E} {sel(experiment='#experiment', strategy='strategy', k='#k', invested='true', long_only='true', optimal='true')} FROM (SELECT DISTINCT experiment, k FROM est) CROSS JOIN (SELECT unnest({list(_SOLVED)!r}) AS strategy)")(
    lambda b: strategies.kkt(strategies.solved(b.rows, SCHEDULE, names=_SOLVED), strategies.estimates(b.rows), strategies.pair_covariances(b.rows), SCHEDULE.periods)
)
query("equal_risk_shares", f"{E} {sel(experiment='#experiment', k='#k', asset='asset', equal='true')} FROM est")(
    lambda b: strategies.risk_contributions(strategies.solved(b.rows, SCHEDULE, names=("ERC",)), strategies.pair_covariances(b.rows)).select("experiment", "k", "asset", (F.abs(F.col("share") - 0.1) < 1e-7).alias("equal"))
)
query("holdings", f"{E} SELECT experiment::BIGINT AS experiment, " + ", ".join(f"bool_or(asset = 'NATION_{k}') AS NATION_{k}" for k in range(25)) + " FROM ea GROUP BY experiment")(lambda b: robustness.holdings(b.exp_asset, [f"NATION_{k}" for k in range(25)]))
query("crisis_by_year", f"{E}{o.CRISIS}, yr AS (SELECT experiment, year(min(date)) AS y FROM win WHERE pos = {SCHEDULE.estimation + 1} GROUP BY 1) {sel(year='#y', crisis='crisis', n='#count(*)')} FROM cr JOIN yr USING (experiment) GROUP BY y, crisis")(
    lambda b: robustness.crisis_groups(b.windows, SCHEDULE.estimation, *STRESS).join(b.windows.filter(F.col("pos") == SCHEDULE.estimation + 1).groupBy("experiment").agg(F.year(F.min("date")).alias("year")), "experiment").groupBy("year", "crisis").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "turnover_by_collinearity",
    f"""{S}, mc AS (SELECT a.experiment, a.asset, b.asset AS b2, corr(a.s, b.s) AS c FROM win a JOIN win b ON a.experiment = b.experiment AND a.pos = b.pos AND a.asset < b.asset WHERE a.pos > {SCHEDULE.estimation - SCHEDULE.lookback} AND a.pos <= {SCHEDULE.estimation} GROUP BY 1, 2, 3),
    cl AS (SELECT experiment, max(c) > 0.3 AS collinear FROM mc GROUP BY 1), tv AS (SELECT experiment, strategy, coalesce(sum(turnover) FILTER (k > 0), 0) AS t FROM td GROUP BY 1, 2)
    {sel(strategy='strategy', collinear='collinear', turnover='~median(t)', n='#count(*)')} FROM tv JOIN cl USING (experiment) GROUP BY strategy, collinear""",
)(lambda b: performance.turnover_by(backtest.turnover(_runs(b).traded, SCHEDULE), robustness.max_pair_correlation(b.windows, SCHEDULE.estimation, SCHEDULE.lookback).select("experiment", (F.col("max_corr") > 0.3).alias("collinear")), "collinear"))
query("calm_experiments", f"{T}{o.CRISIS} {sel(strategy='strategy', n='#count(*)', d_sharpe='~median(sharpe - b_sharpe)')} FROM ag2 JOIN cr USING (experiment) WHERE basis = 'net' AND crisis = 'neither' GROUP BY strategy")(
    lambda b: performance.against(_metrics(b)).filter("basis = 'net'").join(robustness.crisis_groups(b.windows, SCHEDULE.estimation, *STRESS).filter("crisis = 'neither'"), "experiment").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.median(F.col("sharpe") - F.col("b_sharpe")).alias("d_sharpe"))
)
query("conditioning", f"{o.recursive(E)}{o.CONDITIONING} {sel(experiment='#experiment', k='#k', condition='~condition', max_corr='~max_corr', pair='pair')} FROM cn")(lambda b: strategies.conditioning(b.rows))
_SHRINK = o.SHRINK
query("shrinkage_by_window", f"{_SHRINK} {sel(experiment='#experiment', k='#k', intensity='~x')} FROM si")(lambda b: strategies.shrinkage(b.rows))
query("shrinkage_intensity", f"{_SHRINK} {sel(least='~min(x)', q05='~quantile_cont(x, 0.05)', median='~median(x)', q95='~quantile_cont(x, 0.95)', most='~max(x)')} FROM si")(
    lambda b: strategies.shrinkage(b.rows).agg(F.min("intensity").alias("least"), F.percentile("intensity", F.lit(0.05)).alias("q05"), F.median("intensity").alias("median"), F.percentile("intensity", F.lit(0.95)).alias("q95"), F.max("intensity").alias("most"))
)
_SWEEP = (1.0, 2.0, 3.0, 5.0, 10.0, 20.0)
query("aversion_sweep", f"{E}{o.solved_weights(_SWEEP)} {sel(aversion='~aversion', mean_top='~avg(t)')} FROM (SELECT experiment, k, aversion, max(w) AS t FROM mv GROUP BY 1, 2, 3) GROUP BY aversion")(lambda b: _aversions(b))
query("normality_tests", None)(lambda b: volatility.normality_tests(b.r))
query("volatility_models", None)(lambda b: volatility.fit_models(b.r))
query("volatility_persistence", None)(lambda b: volatility.persistence(volatility.fit_models(b.r)))
query("news_impact", None)(lambda b: volatility.news_impact(volatility.fit_models(b.r, ("GARCH-N", "GJR-t", "EGARCH-t"))))


def _aversions(b: Lab, values: tuple[float, ...] = _SWEEP) -> DataFrame:
    """Mean largest mean-variance weight at each risk aversion."""
    out = None
    for a in values:
        one = strategies.solved(b.rows, SCHEDULE, names=("MV",), aversion=a).groupBy("experiment", "k").agg(F.max("w").alias("top")).agg(F.avg("top").alias("mean_top")).select(F.lit(a).alias("aversion"), "mean_top")
        out = one if out is None else out.unionByName(one)
    return out


query(
    "verdict_serial_correlation",
    P + o.lagged(20) + ", rp AS (" + " UNION ALL ".join(f"SELECT asset, {k} AS lags, sum(xs * xs / xs2) AS q FROM lagged WHERE lag <= {k} GROUP BY asset" for k in Q_LAGS) + f"), pp AS (SELECT asset, min({o.at_lags(Q_LAGS)}) AS p FROM rp GROUP BY asset), "
    + "mr AS (SELECT asset, max(abs(xs / ss)) AS mx FROM lagged GROUP BY asset) "
    + sel(asset="pp.asset", fact="#1", verdict="CASE WHEN p >= 0.05 THEN 'Supported' WHEN mx < 0.1 THEN 'Partial' ELSE 'Not supported' END") + " FROM pp JOIN mr ON pp.asset = mr.asset",
)(lambda b: verdicts.serial_correlation(statistics.robust_portmanteau(b.r, Q_LAGS), statistics.acf(b.r, LAGS)).drop("evidence"))


def _verdicts(b: Lab) -> DataFrame:
    tests, fits = written(volatility.normality_tests(b.r)), written(volatility.fit_models(b.r, ("GJR-t", "EGARCH-t")))
    out = verdicts.serial_correlation(statistics.robust_portmanteau(b.r, Q_LAGS), statistics.acf(b.r, LAGS))
    for part in (
        verdicts.fat_tails(statistics.describe(b.r), tests),
        verdicts.negative_skew(tests),
        verdicts.clustering(statistics.ljung_box(b.r, Q_LAGS), tests),
        verdicts.leverage(fits),
        verdicts.conditional_normality(statistics.describe(volatility.standardised_residuals(b.r, fits)), volatility.persistence(fits)),
    ):
        out = out.unionByName(part)
    return out


query("verdicts", None)(_verdicts)


# ---- the second implementation's conventions ----
_FEE = 0.0015
_SECOND = S + f""",
dv AS (SELECT DISTINCT experiment, strategy, k, pos, date, execution, v FROM seg),
dg AS (SELECT *, v / lag(v) OVER (PARTITION BY experiment, strategy, k ORDER BY pos) - 1 AS gross FROM dv),
f2 AS (SELECT d.experiment, d.strategy, d.pos, d.date, gross - coalesce(turnover, 0) * {_FEE} AS ret FROM (SELECT * FROM dg WHERE pos > execution) d LEFT JOIN td c ON d.experiment = c.experiment AND d.strategy = c.strategy AND d.pos = c.execution + 1)"""
query("flat_fee_returns", f"{_SECOND} {sel(experiment='#experiment', strategy='strategy', pos='#pos', date='date', ret='~ret')} FROM f2")(lambda b: backtest.flat_fee_returns(_runs(b).segments, _runs(b).traded, _FEE))
query(
    "one_way_turnover",
    f"{_SECOND}, ys AS (SELECT experiment, strategy, (max(date) - min(date)) / 365.0::DOUBLE AS y FROM f2 GROUP BY 1, 2), mo AS (SELECT experiment, strategy, coalesce(sum(turnover) FILTER (k > 0), 0) / 2 AS m FROM td GROUP BY 1, 2) {sel(experiment='#mo.experiment', strategy='mo.strategy', turnover='~m / nullif(y, 0)')} FROM mo JOIN ys ON mo.experiment = ys.experiment AND mo.strategy = ys.strategy",
)(lambda b: backtest.one_way_turnover(_runs(b).traded, backtest.flat_fee_returns(_runs(b).segments, _runs(b).traded, _FEE)))
_REPLICATION = f"""{R}{o.PATH},
    rm AS (SELECT experiment, strategy, basis, avg(ret) * 52 AS ann_return, stddev_samp(ret) * sqrt(52) AS ann_vol, -least(min(fall), 0) AS max_dd, avg(fall) FILTER (fall < 0) AS mean_fall, {o.share('ret > 0')} AS win_pct FROM fl GROUP BY 1, 2, 3),
    rl AS (SELECT experiment, strategy, basis, unnest(['ann_return', 'ann_vol', 'sharpe', 'max_dd', 'calmar', 'sterling', 'win_pct']) AS metric,
           unnest([ann_return, ann_vol, ann_return / nullif(ann_vol, 0), max_dd, ann_return / nullif(max_dd, 0), ann_return / nullif(-mean_fall, 0), win_pct]) AS value FROM rm),
    rj AS (SELECT a.strategy, a.basis, a.metric, a.value - b.value AS d, CASE WHEN a.metric IN ('ann_vol', 'max_dd') THEN -1.0::DOUBLE ELSE 1.0 END AS sg FROM rl a JOIN rl b ON a.experiment = b.experiment AND a.basis = b.basis AND a.metric = b.metric AND b.strategy = 'EW' WHERE a.strategy <> 'EW' AND a.value IS NOT NULL AND b.value IS NOT NULL)"""
query("benchmark_wins", f"{_REPLICATION} {sel(strategy='strategy', basis='basis', metric='metric', n='#count(*)', mean_d='~avg(d)', win_pct='~' + o.share('d * sg > 0'))} FROM rj GROUP BY strategy, basis, metric")(
    lambda b: performance.benchmark_wins(performance.replication_metrics(_runs(b).returns, 52))
)


from . import extended  # noqa: E402,F401  registers its queries here
