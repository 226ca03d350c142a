"""DuckDB SQL for the registered queries: shared table expressions and a small writer of select lists."""

from __future__ import annotations

from math import gamma

from ..operators import eigen, garch, normality
from ..operators.sampler import Schedule
from ..functions.distributions import MEET, MIDDLE, NODES, SPLIT, TAIL, fraction_steps, node_rates, series_terms
from .context import BENCHMARK, N_EXPERIMENTS, REGION_BENCHMARK, SCHEDULE, STRESS

_DAY = "l_shipdate::DATE"
_PERIOD = {"daily": _DAY, "weekly": f"({_DAY} + ((12 - dayofweek({_DAY})) % 7)::INT)::DATE", "monthly": f"last_day({_DAY})"}


def sel(**cols: str) -> str:
    """A select list: ~ rounds to 6 places, # makes a BIGINT."""
    out = []
    for name, x in cols.items():
        x = f"round({x[1:]}, 6) + 0.0::DOUBLE" if x[0] == "~" else f"({x[1:]})::BIGINT" if x[0] == "#" else x
        out.append(f"{x} AS {name}")
    return "SELECT " + ", ".join(out)


def panel(freq: str = "weekly", level: str = "nation") -> str:
    region = level == "region"
    where = f" WHERE asset = '{REGION_BENCHMARK if region else BENCHMARK}'" if freq == "daily" else ""
    name, joined = ("r_name", " JOIN region ON n_regionkey = r_regionkey") if region else ("n_name", "")
    uni = "SELECT r_name AS asset, r_regionkey AS ord, 'ALL' AS sector, 2.0::DOUBLE + r_regionkey % 4 AS cost_bp FROM region" if region else "SELECT n_name AS asset, n_nationkey AS ord, r_name AS sector, 2.0::DOUBLE + n_nationkey % 4 AS cost_bp FROM nation JOIN region ON n_regionkey = r_regionkey"
    return f"""WITH obs AS (
  SELECT {_PERIOD[freq]} AS date, {name} AS asset, power(avg(l_extendedprice / l_quantity), 0.05) AS price, sum(l_quantity) AS volume
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey{joined} GROUP BY 1, 2),
uni AS ({uni}),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM (SELECT DISTINCT date FROM obs{where})),
grid AS (SELECT session, date, asset, price AS price_raw, volume FROM cal CROSS JOIN (SELECT asset FROM uni) LEFT JOIN obs USING (date, asset)),
marked AS (SELECT *, last_value(price_raw IGNORE NULLS) OVER w AS lp, max(CASE WHEN price_raw IS NOT NULL THEN session END) OVER w AS ls
           FROM grid WINDOW w AS (PARTITION BY asset ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
panel AS (SELECT session, date, asset, price_raw, volume, CASE WHEN session - ls <= 3 THEN lp END AS price FROM marked),
ret AS (SELECT *, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY session) AS r, price / lag(price) OVER (PARTITION BY asset ORDER BY session) - 1 AS s FROM panel),
x AS (SELECT date, asset, session, 100 * r AS x FROM ret WHERE r IS NOT NULL)"""


PANEL = panel()

MOMENTS = """,
c AS (SELECT asset, date, x, x - avg(x) OVER (PARTITION BY asset) AS d, count(*) OVER (PARTITION BY asset) AS n, row_number() OVER (PARTITION BY asset ORDER BY date) AS t FROM x),
mom AS (SELECT asset, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, avg(d * d * d) / power(avg(d * d), 1.5) AS skew, avg(d * d * d * d) / power(avg(d * d), 2) - 3 AS kurt,
               quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.95) AS q95 FROM c GROUP BY asset)"""


def lagged(lags: int, value: str = "x", tag: str = "") -> str:
    """lagged{tag}(asset, lag, n, xs, xs2, ss) of a transform of x."""
    return f""",
y{tag} AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) AS t, ({value}) - avg({value}) OVER (PARTITION BY asset) AS d, count(*) OVER (PARTITION BY asset) AS n FROM x),
ss{tag} AS (SELECT asset, sum(d * d) AS ss FROM y{tag} GROUP BY asset),
lagged{tag} AS (SELECT a.asset, g.lag, a.n, sum(a.d * b.d) AS xs, sum(a.d * b.d * a.d * b.d) AS xs2, any_value(ss) AS ss
               FROM y{tag} a JOIN (SELECT unnest(range(1, {lags + 1})) AS lag) g ON true JOIN y{tag} b ON a.asset = b.asset AND b.t = a.t + g.lag JOIN ss{tag} s ON a.asset = s.asset GROUP BY 1, 2, 3)"""


def erfc(x: str) -> str:
    low = "0.0::DOUBLE"
    for c in reversed(series_terms()):
        low = f"({low}) * ({x}) * ({x}) + ({c!r}::DOUBLE)"
    high = " + ".join(f"exp(-({x}) * ({x}) * {rate!r}::DOUBLE)" for rate in node_rates())
    return f"CASE WHEN {x} < {SPLIT} THEN 1 - ({x}) * ({low}) ELSE ({high}) / {NODES} END"


def half_log_tail(u: str) -> str:
    """log(erfc(u) / 2) for u >= 0."""
    steps = ", ".join(f"{c!r}::DOUBLE" for c in fraction_steps())
    fraction = f"list_reduce(list_prepend(({u})::DOUBLE, [{steps}]), lambda t, c: ({u}) + c / t)"
    return f"CASE WHEN {u} < {SPLIT} THEN ln(({erfc(u)}) / 2) ELSE -({u}) * ({u}) - ln(2 * sqrt(pi()) * {fraction}) END"


def normal_sf(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN ({erfc(f'(abs({x}) / sqrt(2.0::DOUBLE))')}) / 2 ELSE 1 - ({erfc(f'(abs({x}) / sqrt(2.0::DOUBLE))')}) / 2 END"


def chi2_sf(x: str, df: int) -> str:
    powers = [j + 0.5 * (df % 2) for j in range((df + 1) // 2 - df % 2)]
    tail = f"exp(-({x}) / 2) * (" + (" + ".join(f"power({x} / 2, {p}::DOUBLE) / {gamma(p + 1)!r}::DOUBLE" for p in powers) or "0.0") + ")"
    return f"{tail} + ({erfc(f'sqrt({x} / 2)')})" if df % 2 else tail


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}) * ({x}) + ({c!r}::DOUBLE)"
    return f"({out})"


def normal_quantile(p: str) -> str:
    q, far = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{q} * {_polynomial(f'{q} * {q}', MIDDLE[0])} / {_polynomial(f'{q} * {q}', MIDDLE[1])}"
    tail = f"{_polynomial(far, TAIL[0])} / {_polynomial(far, TAIL[1])}"
    return f"CASE WHEN abs({q}) <= {0.5 - MEET!r} THEN {middle} WHEN {q} < 0 THEN {tail} ELSE -{tail} END"


def at_lags(lags: tuple[int, ...], q: str = "q") -> str:
    """The tail of q at the degrees of freedom in column lags."""
    return "CASE lags " + " ".join(f"WHEN {k} THEN {chi2_sf(q, k)}" for k in lags) + " END"


_S = SCHEDULE
PAIRS = """,
pr AS (SELECT a.asset AS a, b.asset AS b, corr(a.r, b.r) AS corr, covar_samp(a.r, b.r) AS cov, count(*) AS n FROM ret a JOIN ret b ON a.date = b.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)"""

def experiments(_S: Schedule = SCHEDULE, freq: str = "weekly", level: str = "nation") -> str:
    return panel(freq, level) + f""",
cand AS (SELECT c, asset FROM (SELECT unnest(range({4 * N_EXPERIMENTS})) AS c) CROSS JOIN uni QUALIFY row_number() OVER (PARTITION BY c, sector ORDER BY md5('42:' || c || ':' || asset)) <= 2),
el AS (SELECT asset, session AS anchor FROM (SELECT asset, session, count(price) OVER (PARTITION BY asset ORDER BY session ROWS BETWEEN CURRENT ROW AND {_S.window} FOLLOWING) AS has FROM panel) WHERE has = {_S.window + 1}),
sz AS (SELECT c, count(*) AS size, string_agg(asset, ',' ORDER BY asset) AS subset FROM cand GROUP BY c),
op AS (SELECT c, anchor, subset FROM (SELECT c, anchor, count(*) AS have FROM cand JOIN el USING (asset) GROUP BY 1, 2) JOIN sz USING (c) WHERE have = size QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('42:' || c || ':' || anchor), anchor) = 1),
ds AS (SELECT c, anchor FROM op QUALIFY row_number() OVER (PARTITION BY anchor, subset ORDER BY c) = 1),
exps AS (SELECT (row_number() OVER (ORDER BY c) - 1)::INT AS experiment, c, anchor::INT AS anchor FROM ds QUALIFY row_number() OVER (ORDER BY c) <= {N_EXPERIMENTS}),
ea AS (SELECT experiment, anchor, asset FROM exps JOIN cand USING (c)),
win AS (SELECT experiment, asset, session - anchor AS pos, date, price, price / lag(price) OVER (PARTITION BY experiment, asset ORDER BY session) - 1 AS s
        FROM ea JOIN panel USING (asset) WHERE session BETWEEN anchor AND anchor + {_S.window}),
tr AS (SELECT experiment, k, {_S.estimation} + {_S.every} * k AS execution, {_S.estimation - _S.lag} + {_S.every} * k AS formation,
              CASE WHEN k = 0 THEN 1 ELSE greatest({_S.estimation - _S.lag} + {_S.every} * k - {_S.lookback} + 1, 1) END AS first FROM exps CROSS JOIN (SELECT unnest(range({_S.n_trades})) AS k)),
er AS (SELECT experiment, k, asset, pos, s FROM win JOIN tr USING (experiment) WHERE pos >= 1 AND pos BETWEEN first AND formation),
est AS (SELECT experiment, k, asset, avg(s) AS mean, stddev_samp(s) AS sd, count(s) AS n FROM er GROUP BY 1, 2, 3)"""

def weights(_S: Schedule = SCHEDULE, freq: str = "weekly", level: str = "nation") -> str:
    return experiments(_S, freq, level) + """,
wide AS (SELECT experiment, k, asset, 1.0::DOUBLE / count(*) OVER p AS ew, (1 / sd) / sum(1 / sd) OVER p AS iv,
                greatest(floor(count(*) OVER p / 5.0), 1) AS fifth, row_number() OVER (PARTITION BY experiment, k ORDER BY mean DESC, asset) AS rk FROM est WINDOW p AS (PARTITION BY experiment, k)),
w AS (SELECT experiment, 'EW' AS strategy, k, asset, ew AS w FROM wide UNION ALL SELECT experiment, 'IV', k, asset, iv FROM wide
      UNION ALL SELECT experiment, 'QNT', k, asset, CASE WHEN rk <= fifth THEN 1.0::DOUBLE / fifth ELSE 0.0 END FROM wide)"""

def segments(_S: Schedule = SCHEDULE, freq: str = "weekly", level: str = "nation", made: str | None = None) -> str:
    """made: CTEs that end in the weights w, if they aren't those of weights()."""
    return (made or weights(_S, freq, level)) + f""",
tg AS (SELECT w.*, execution, coalesce(lead(execution) OVER (PARTITION BY experiment, strategy, asset ORDER BY k), {_S.window}) AS until FROM w JOIN tr USING (experiment, k)),
g AS (SELECT experiment, strategy, k, asset, execution, until, pos, date, w * price / first_value(price) OVER (PARTITION BY experiment, strategy, k, asset ORDER BY pos) AS g
      FROM tg JOIN win USING (experiment, asset) WHERE pos BETWEEN execution AND until),
seg AS (SELECT *, sum(g) OVER (PARTITION BY experiment, strategy, k, pos) AS v FROM g),
dw AS (SELECT experiment, strategy, asset, pos, date, g / v AS weight FROM seg WHERE pos < until OR pos = {_S.window}),
td AS (SELECT t.experiment, t.strategy, t.k, t.execution, sum(abs(t.w - coalesce(b.g / b.v, 0))) AS turnover, sum(abs(t.w - coalesce(b.g / b.v, 0)) * cost_bp) / 1e4 AS cost
       FROM tg t LEFT JOIN (SELECT * FROM seg WHERE pos = until) b ON t.experiment = b.experiment AND t.strategy = b.strategy AND t.asset = b.asset AND t.execution = b.until JOIN uni u ON t.asset = u.asset GROUP BY 1, 2, 3, 4)"""


def returns(bases: str = "('gross', 0.0::DOUBLE), ('net', 1.0), ('net_2x', 2.0)", _S: Schedule = SCHEDULE, freq: str = "weekly", made: str | None = None) -> str:
    return segments(_S, freq, made=made) + f""",
dv AS (SELECT DISTINCT experiment, strategy, k, pos, date, execution, v FROM seg),
dg AS (SELECT *, v / lag(v) OVER (PARTITION BY experiment, strategy, k ORDER BY pos) - 1 AS gross FROM dv),
bs AS (SELECT * FROM (VALUES {bases}) t(basis, mult)),
rt AS (SELECT d.experiment, d.strategy, basis, d.pos, d.date, (1 + gross) * (1 - coalesce(cost, 0) * mult) - 1 AS ret
       FROM (SELECT * FROM dg WHERE pos > execution) d LEFT JOIN (SELECT *, CASE WHEN k = 0 THEN {_S.estimation + 1} ELSE execution END AS at FROM td) c
       ON d.experiment = c.experiment AND d.strategy = c.strategy AND d.pos = c.at CROSS JOIN bs)"""


_PATH = """,
wl AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY experiment, strategy, basis ORDER BY pos)) AS wealth FROM rt),
fl AS (SELECT *, wealth / greatest(1.0, max(wealth) OVER (PARTITION BY experiment, strategy, basis ORDER BY pos)) - 1 AS fall FROM wl)"""

EXPERIMENTS, WEIGHTS, SEGMENTS = experiments(), weights(), segments()
_METRICS = _PATH + f""",
rfs AS (SELECT {_PERIOD["weekly"]} AS date, avg(l_tax) * 100 / 100 / {_S.periods} AS rf FROM lineitem GROUP BY 1),
ag AS (SELECT experiment, strategy, basis, count(ret) AS n, exp(sum(ln(1 + ret)) * {_S.periods}.0 / count(ret)) - 1 AS ann_return, stddev_samp(ret) * sqrt({_S.periods}) AS ann_vol,
              avg(ret - rf) * {_S.periods} / nullif(stddev_samp(ret - rf) * sqrt({_S.periods}), 0) AS sharpe,
              avg(ret - rf) * {_S.periods} / nullif(sqrt(avg(power(least(ret - rf, 0), 2))) * sqrt({_S.periods}), 0) AS sortino, least(min(fall), 0) AS max_dd
       FROM fl LEFT JOIN rfs USING (date) GROUP BY 1, 2, 3),
m AS (SELECT *, ann_return / nullif(abs(max_dd), 0) AS calmar, ann_return / (abs(max_dd) + 0.1) AS sterling FROM ag),
ag2 AS (SELECT m.*, b.sharpe AS b_sharpe, b.ann_return AS b_ann_return, b.ann_vol AS b_ann_vol, b.max_dd AS b_max_dd
        FROM m JOIN m b ON m.experiment = b.experiment AND m.basis = b.basis AND b.strategy = 'EW' WHERE m.strategy <> 'EW')"""
METRICS = returns() + _METRICS

CRISIS = f""",
cr AS (SELECT experiment, CASE WHEN min(CASE WHEN pos > {_S.estimation} THEN date END) <= DATE '{STRESS[1]}' AND max(date) >= DATE '{STRESS[0]}' THEN 'evaluation'
              WHEN min(CASE WHEN pos >= 1 THEN date END) <= DATE '{STRESS[1]}' AND max(CASE WHEN pos <= {_S.estimation} THEN date END) >= DATE '{STRESS[0]}' THEN 'estimation only' ELSE 'neither' END AS crisis
       FROM win GROUP BY experiment)"""


def share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 100.0::DOUBLE ELSE 0 END)"


PATH = _PATH

SHRINK = EXPERIMENTS + """, zz AS (SELECT experiment, k, asset, pos, var_pop(s) OVER p AS v, (s - avg(s) OVER p) / stddev_pop(s) OVER p AS z FROM er WINDOW p AS (PARTITION BY experiment, k, asset)),
pm AS (SELECT a.experiment, a.k, a.asset AS a, b.asset AS b, any_value(a.v) * any_value(b.v) AS sc, avg(a.z * b.z) AS r, avg(a.z * b.z * a.z * b.z) AS m22, avg(a.z * a.z * a.z * b.z) AS m31, count(*) AS t
       FROM zz a JOIN zz b ON a.experiment = b.experiment AND a.k = b.k AND a.pos = b.pos GROUP BY 1, 2, 3, 4),
pq AS (SELECT *, avg(CASE WHEN a <> b THEN r END) OVER (PARTITION BY experiment, k) AS rb FROM pm),
si AS (SELECT experiment, k, least(greatest(coalesce((sum(sc * (m22 - r * r)) - sum(CASE WHEN a <> b THEN rb * sc * (m31 - r) ELSE sc * (m22 - 1) END)) / nullif(sum(CASE WHEN a <> b THEN sc * (rb - r) * (rb - r) END) * any_value(t), 0), 0), 0), 1) AS x FROM pq GROUP BY 1, 2)"""


def _ends(coefficients: tuple[float, ...], x: str, last: str) -> str:
    return f"({_polynomial(x, coefficients)} * ({x}) + {last})"


def _stephens(a: str) -> str:
    out = f"CASE WHEN {a} >= {normality.CERTAIN} THEN 0"
    for least, (c0, c1, c2), rising in normality.PIECES:
        tail = f"exp({c0}::DOUBLE + {c1}::DOUBLE * {a} + {c2}::DOUBLE * {a} * {a})"
        tail = f"1 - {tail}" if rising else tail
        out += f" WHEN {a} >= {least} THEN {tail}" if least is not None else f" ELSE {tail}"
    return out + " END"


#: CTEs after x that end in nt(asset, test, stat, p).
NORMALITY = f""",
nr AS (SELECT asset, x, row_number() OVER (PARTITION BY asset ORDER BY x, date) AS i, count(*) OVER a AS n, avg(x) OVER a AS mean, stddev_samp(x) OVER a AS sd, var_pop(x) OVER a AS var FROM x WINDOW a AS (PARTITION BY asset)),
nz AS (SELECT *, (x - mean) / sd AS z, abs((x - mean) / sd) / sqrt(2.0::DOUBLE) AS u, {normal_quantile("((i - 0.375::DOUBLE) / (n + 0.25::DOUBLE))")} AS sc FROM nr WHERE n >= {normality.MIN_N} AND var > 0),
nl AS (SELECT *, {half_log_tail("u")} AS lt FROM nz),
ns AS (SELECT asset, n::DOUBLE AS n, any_value(var) AS var, sum((2 * i - 1) * CASE WHEN z <= 0 THEN lt ELSE ln(1 - exp(lt)) END + (2 * n - 2 * i + 1) * CASE WHEN z >= 0 THEN lt ELSE ln(1 - exp(lt)) END) AS tails, sum(sc * sc) AS mm, sum(sc * x) FILTER (i > 2 AND i < n - 1) AS inner_,
       max(x) FILTER (i = 1) AS low1, max(x) FILTER (i = 2) AS low2, max(x) FILTER (i = n) AS high1, max(x) FILTER (i = n - 1) AS high2, avg(power(x - mean, 4)) AS m4, {normal_quantile("((n - 0.375::DOUBLE) / (n + 0.25::DOUBLE))")} AS m1, {normal_quantile("((n - 1.375::DOUBLE) / (n + 0.25::DOUBLE))")} AS m2 FROM nl GROUP BY asset, n),
na AS (SELECT *, {_ends(normality.LAST, "(1 / sqrt(n))", "m1 / sqrt(mm)")} AS a1, {_ends(normality.NEXT, "(1 / sqrt(n))", "m2 / sqrt(mm)")} AS a2 FROM ns),
nb AS (SELECT *, power(inner_ / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * (high1 - low1) + a2 * (high2 - low2), 2) / (n * var) AS w, -n - tails / n AS ad, m4 / (var * var) AS b2,
       6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS ks FROM na),
nc AS (SELECT *, ad * (1 + 0.75::DOUBLE / n + 2.25::DOUBLE / (n * n)) AS aa, (ln(1 - w) - {_polynomial("ln(n)", normality.CENTRE)}) / exp({_polynomial("ln(n)", normality.SPREAD)}) AS wz, 6 + 8 / ks * (2 / ks + sqrt(1 + 4 / (ks * ks))) AS ka FROM nb),
nd AS (SELECT *, (1 - 2 / ka) / (1 + (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) * sqrt(2 / (ka - 4))) AS kt FROM nc),
ne AS (SELECT *, (1 - 2 / (9 * ka) - sign(kt) * power(abs(kt), {1 / 3!r}::DOUBLE)) / sqrt(2 / (9 * ka)) AS kz FROM nd),
nt AS (SELECT asset, 'shapiro' AS test, w AS stat, {normal_sf("wz")} AS p FROM ne UNION ALL SELECT asset, 'anderson', ad, {_stephens("aa")} FROM ne UNION ALL SELECT asset, 'kurtosis', kz, 2 * ({normal_sf("abs(kz)")}) FROM ne)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def arch_lm(lags: tuple[int, ...]) -> str:
    """CTEs after x (of a recursive WITH) that end in lm(asset, lags, n, lm): each step clears a column of the matrix m of cross products."""
    return f""",
ad AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) AS t, power(x - avg(x) OVER a, 2) / var_pop(x) OVER a AS s FROM x WINDOW a AS (PARTITION BY asset)),
al AS (SELECT unnest({list(lags)}) AS lags), ai AS (SELECT unnest(range(0, {max(lags) + 1})) AS i),
af AS (SELECT asset, lags, t, 0 AS i, 1.0::DOUBLE AS v FROM ad JOIN al ON t > lags
       UNION ALL SELECT a.asset, lags, a.t, lags + 1 - i, b.s FROM ad a JOIN al ON a.t > lags JOIN ai ON i <= lags JOIN ad b ON b.asset = a.asset AND b.t = a.t - i),
ag AS (SELECT p.asset, p.lags, p.i, q.i AS j, sum(p.v * q.v) AS v, count(*) AS n FROM af p JOIN af q ON p.asset = q.asset AND p.lags = q.lags AND p.t = q.t GROUP BY 1, 2, 3, 4),
am AS (SELECT asset, lags, any_value(n) AS n, list(line ORDER BY i) AS m FROM (SELECT asset, lags, i, any_value(n) AS n, list(v ORDER BY j) AS line FROM ag GROUP BY 1, 2, 3) GROUP BY 1, 2),
ae AS (SELECT asset, lags, n, 1 AS k, m, m[lags + 2][lags + 2] - m[1][lags + 2] * m[1][lags + 2] / n AS tss FROM am
       UNION ALL SELECT asset, lags, n, k + 1, list_transform(range(1, lags + 3), lambda i: CASE WHEN i = k THEN m[i] ELSE list_transform(range(1, lags + 3), lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END), tss FROM ae WHERE k <= lags + 1),
lm AS (SELECT asset, lags, n, n * (1 - m[lags + 2][lags + 2] / tss) AS lm FROM ae WHERE k = lags + 2)"""


def _natural(model: str) -> str:
    """Columns mu..nu of a model at the search's vector c."""
    own = garch.free(model)
    ga = "c[5]" if garch.LEAN in own else "0.0::DOUBLE"
    return f"c[1] AS mu, (1 - c[3]) * exp(c[2]) AS om, c[4] AS al, {ga} AS ga, c[3] - c[4] - {ga} / 2 AS be, {'exp(c[6])' if garch.FREEDOM in own else '0.0::DOUBLE'} AS nu"


def _likelihood(model: str) -> str:
    """Log-likelihood of xs (n values) at mu..nu, one fold over them."""
    student = model.endswith("-t")
    inside = "om > 0 AND al >= 0 AND be >= 0 AND al + ga >= 0 AND al + be + ga / 2 < 1" + (f" AND nu > {garch.NU_BOUNDS[0]} AND nu < {garch.NU_BOUNDS[1]}" if student else "")
    weight = f"list_transform(range(1, least({garch.DEPTH}, n) + 1), lambda i: power({garch.DECAY}::DOUBLE, i - 1)"
    first = f"list_sum({weight} * (xs[i] - mu) * (xs[i] - mu))) / list_sum({weight}))"
    term = "-0.5 * ln(a.h) - (nu + 1) / 2 * ln(1 + b.e * b.e / (a.h * (nu - 2)))" if student else "-0.5 * (ln(a.h) + b.e * b.e / a.h)"
    each = "lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(pi() * (nu - 2))" if student else "-0.5 * ln(2 * pi())"
    zero = "0.0::DOUBLE"
    return f"""CASE WHEN {inside} THEN list_reduce(list_prepend({{'e': {zero}, 'h': om + (al + ga / 2 + be) * ({first}), 'l': {zero}}}, list_transform(xs, lambda v: {{'e': v - mu, 'h': {zero}, 'l': {zero}}})),
    lambda a, b: {{'e': b.e, 'h': om + (al + CASE WHEN b.e < 0 THEN ga ELSE {zero} END) * b.e * b.e + be * a.h, 'l': a.l + ({term})}}).l + n * ({each}) END"""


def variance_profiles(model: str, tag: str, share: float = 0.01) -> str:
    """CTEs after x (of a recursive WITH) that end in {tag}p(asset, model, n, parameter, estimate, loglik, lower, higher); GARCH and GJR only."""
    ways = [*((f"{d}::DOUBLE[]", "0.0::DOUBLE") for d in garch.moves(model)), *(("NULL::DOUBLE[]", f"{by}::DOUBLE") for by in garch.ONWARD)]
    begin = f"[mean, ln(var), {', '.join(repr(b) + '::DOUBLE' for b in garch.BEGIN[2:])}]"
    own = [c for c in garch.PARAMETERS if not (c == "gamma" and garch.LEAN not in garch.free(model)) and not (c == "nu" and garch.FREEDOM not in garch.free(model))]
    short = dict(zip(garch.PARAMETERS, ("mu", "om", "al", "ga", "be", "nu")))
    least = "'-infinity'::DOUBLE"
    return f""",
{tag}s AS MATERIALIZED (SELECT asset, count(*) AS n, avg(x) AS mean, var_pop(x) AS var, list(x ORDER BY date) AS xs FROM x GROUP BY asset HAVING count(*) >= {garch.MIN_N} AND var_pop(x) > 0),
{tag}w AS (SELECT * FROM (VALUES {', '.join(f'({d}, {by})' for d, by in ways)}) t(d, far)),
{tag}f AS (SELECT asset, 0 AS round, c AS p, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS drift, 1.0::DOUBLE AS scale, {_likelihood(model)} AS ll FROM (SELECT *, {_natural(model)} FROM (SELECT *, {begin} AS c FROM {tag}s))
  UNION ALL
  SELECT asset, round + 1, CASE WHEN bl > ll THEN bp ELSE p END, CASE WHEN bl > ll THEN list_transform(range(1, 7), lambda i: drift[i] * {garch.FADING} + (bp[i] + p[i] * -1.0::DOUBLE)) ELSE drift END,
         CASE WHEN bl > ll THEN least(scale * 2, 1.0::DOUBLE) ELSE scale / 2 END, greatest(bl, ll)
  FROM (SELECT asset, round, p, drift, scale, ll, max(l) AS bl, arg_max(c, l) AS bp
        FROM (SELECT *, coalesce({_likelihood(model)}, {least}) AS l FROM (SELECT *, {_natural(model)} FROM (
              SELECT f.*, s.n, s.xs, list_transform(range(1, 7), lambda i: CASE WHEN d IS NULL THEN p[i] + drift[i] * far ELSE p[i] + d[i] * (CASE WHEN i = 1 THEN sqrt(var) ELSE 1.0::DOUBLE END) * scale END) AS c
              FROM {tag}f f JOIN {tag}s s ON f.asset = s.asset CROSS JOIN {tag}w WHERE round < {garch.ROUNDS} AND scale >= {garch.FINEST!r}))) GROUP BY ALL)),
{tag}b AS (SELECT s.asset, n, xs, ll, {_natural(model)} FROM (SELECT asset, p AS c, ll FROM {tag}f QUALIFY row_number() OVER (PARTITION BY asset ORDER BY round DESC) = 1) f JOIN {tag}s s ON f.asset = s.asset),
{tag}v AS (SELECT asset, n, xs, ll, parameter, side, CASE parameter {' '.join(f"WHEN '{c}' THEN {short[c]}" for c in garch.PARAMETERS)} END AS estimate, {', '.join(f"{short[c]} * CASE WHEN parameter = '{c}' THEN 1 + side * {share}::DOUBLE ELSE 1.0::DOUBLE END AS {short[c]}" for c in garch.PARAMETERS)}
  FROM (SELECT *, unnest([{', '.join(f"'{c}'" for c in own)}]) AS parameter FROM {tag}b) CROSS JOIN (VALUES (-1), (1)) t(side)),
{tag}p AS (SELECT asset, '{model}' AS model, n, parameter, any_value(estimate) AS estimate, any_value(ll) AS loglik, max(l) FILTER (side = -1) AS lower, max(l) FILTER (side = 1) AS higher FROM (SELECT *, {_likelihood(model)} AS l FROM {tag}v) GROUP BY asset, n, parameter)"""


def variance_residuals(model: str, tag: str) -> str:
    """CTEs that end in zx(asset, date, x): standardised residuals at what variance_profiles() found, date their place."""
    zero, first = "0.0::DOUBLE", _likelihood(model).split("'h': om + (al + ga / 2 + be) * (", 1)[1].split("), 'l'", 1)[0]
    return f""",
zz AS (SELECT asset, n, list_reduce(list_prepend({{'e': {zero}, 'h': om + (al + ga / 2 + be) * ({first}), 'z': []::DOUBLE[]}}, list_transform(xs, lambda v: {{'e': v - mu, 'h': {zero}, 'z': []::DOUBLE[]}})),
    lambda a, b: {{'e': b.e, 'h': om + (al + CASE WHEN b.e < 0 THEN ga ELSE {zero} END) * b.e * b.e + be * a.h, 'z': list_append(a.z, b.e / sqrt(a.h))}}).z AS z FROM {tag}b),
zx AS (SELECT asset, unnest(range(n)) AS date, unnest(z) AS x FROM zz)"""


def _top_of(m: str) -> str:
    """The eigenvalue of largest size of the matrix in column m, by the iteration that the operator takes."""
    zero = "0.0::DOUBLE"
    start = f"list_transform(range(1, len({m}) + 1), lambda i: 1.0::DOUBLE / i)"
    unit = f"list_transform({start}, lambda x: x / sqrt(list_dot_product({start}, {start})))"
    w = f"list_transform({m}, lambda row: list_dot_product(row, a.v))"
    return f"""list_reduce(list_prepend({{'v': {unit}, 'w': []::DOUBLE[], 'l': {zero}, 'done': false}}, list_transform(range({2 * eigen.ROUNDS}), lambda i: {{'v': []::DOUBLE[], 'w': []::DOUBLE[], 'l': {zero}, 'done': i % 2 = 0}})),
      lambda a, b: CASE WHEN b.done THEN CASE WHEN a.done THEN a ELSE {{'v': a.v, 'w': {w}, 'l': a.l, 'done': false}} END
      WHEN a.done THEN a ELSE {{'v': list_transform(a.w, lambda x: x / sqrt(list_dot_product(a.w, a.w))), 'w': a.w, 'l': list_dot_product(a.v, a.w), 'done': abs(list_dot_product(a.v, a.w) - a.l) <= {eigen.TOL!r} * abs(list_dot_product(a.v, a.w))}} END).l"""


#: CTEs after er (of a recursive WITH) that end in cn(experiment, k, condition, max_corr, pair).
CONDITIONING = f""",
ec AS MATERIALIZED (SELECT a.experiment, a.k, a.asset AS a, b.asset AS b, corr(a.s, b.s) AS c FROM er a JOIN er b ON a.experiment = b.experiment AND a.k = b.k AND a.pos = b.pos GROUP BY 1, 2, 3, 4),
ek AS (SELECT experiment, k, list(line ORDER BY a) AS m FROM (SELECT experiment, k, a, list(c ORDER BY b) AS line FROM ec GROUP BY 1, 2, 3) GROUP BY 1, 2),
ei AS (SELECT experiment, k, m, 1 AS j, list_transform(range(1, len(m) + 1), lambda i: list_concat(m[i], list_transform(range(1, len(m) + 1), lambda q: CASE WHEN q = i THEN 1.0::DOUBLE ELSE 0 END))) AS g FROM ek
  UNION ALL SELECT experiment, k, m, j + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = j THEN list_transform(g[j], lambda x: x / g[j][j]) ELSE list_transform(range(1, 2 * len(m) + 1), lambda q: g[i][q] - g[i][j] * (g[j][q] / g[j][j])) END) FROM ei WHERE j <= len(m)),
en AS (SELECT experiment, k, m, list_transform(g, lambda row: row[len(m) + 1:]) AS inv FROM ei WHERE j = len(m) + 1),
ev AS (SELECT experiment, k, ({_top_of("m")}) * ({_top_of("inv")}) AS condition FROM en),
cn AS (SELECT ev.experiment, ev.k, condition, max(c) AS max_corr, arg_max(a || '/' || b, c) AS pair FROM ev JOIN ec ON ev.experiment = ec.experiment AND ev.k = ec.k AND a < b GROUP BY 1, 2, 3)"""


def _descent(a: str, equal_risk: bool = False, sweeps: int = 150) -> str:
    """y of cyclical coordinate descent on the correlations r, from list a of the linear terms."""
    rest = "list_dot_product(r[j], s.y) - s.y[j]"
    new = f"(sqrt(({rest}) * ({rest}) + 4.0::DOUBLE / len(r)) - ({rest})) / 2" if equal_risk else f"greatest(0.0::DOUBLE, {a}[j] - ({rest}))"
    start = f"list_transform(range(1, len(r) + 1), lambda j: {'1.0::DOUBLE / sqrt(len(r))' if equal_risk else '0.0::DOUBLE'})"
    return f"""list_reduce(list_prepend({{'y': {start}, 'i': 0::BIGINT}}, list_transform(range({sweeps} * len(r)), lambda i: {{'y': []::DOUBLE[], 'i': (i % len(r) + 1)::BIGINT}})),
      lambda s, e: {{'y': list_transform(range(1, len(r) + 1), lambda j: CASE WHEN j = e.i THEN {new} ELSE s.y[j] END), 'i': e.i}}).y"""


#: CTEs after est and er that end in sw(experiment, strategy, k, asset, w): solved weights by another method than the
#: operator's. On assets scaled to unit deviation each of the scale-free strategies is min y'Ry/2 - a'y, y >= 0.
_SOLVED_WEIGHTS = f""",
rfs AS (SELECT {_PERIOD["weekly"]} AS date, avg(l_tax) / {SCHEDULE.periods} AS rf FROM lineitem GROUP BY 1),
rw AS (SELECT experiment, k, avg(rf) AS rf FROM (SELECT DISTINCT experiment, k, pos, date FROM er JOIN win USING (experiment, asset, pos)) JOIN rfs USING (date) GROUP BY 1, 2),
ec AS MATERIALIZED (SELECT a.experiment, a.k, a.asset AS a, b.asset AS b, corr(a.s, b.s) AS c FROM er a JOIN er b ON a.experiment = b.experiment AND a.k = b.k AND a.pos = b.pos GROUP BY 1, 2, 3, 4),
em AS (SELECT experiment, k, list(line ORDER BY a) AS r FROM (SELECT experiment, k, a, list(c ORDER BY b) AS line FROM ec GROUP BY 1, 2, 3) GROUP BY 1, 2),
ev AS (SELECT experiment, k, list(asset ORDER BY asset) AS assets, list(sd ORDER BY asset) AS sd, list((mean - rf) / sd ORDER BY asset) AS excess, list(1 / sd ORDER BY asset) AS calm, list(1.0::DOUBLE ORDER BY asset) AS one FROM est JOIN rw USING (experiment, k) GROUP BY 1, 2),
ey AS (SELECT experiment, k, assets, sd, excess, {_descent('calm')} AS gmv, {_descent('excess')} AS msr, {_descent('one')} AS md, {_descent('one', True)} AS erc FROM em JOIN ev USING (experiment, k)),
el_ AS (SELECT experiment, k, unnest(['GMV', 'MSR', 'MDP', 'MDC', 'ERC']) AS strategy, unnest([gmv, msr, md, md, erc]) AS y, assets, sd FROM ey),
ew AS (SELECT experiment, strategy, k, unnest(assets) AS asset, unnest(y) / CASE WHEN strategy = 'MDC' THEN 1.0::DOUBLE ELSE unnest(sd) END AS x FROM el_),
sw AS MATERIALIZED (SELECT experiment, strategy, k, asset, x / sum(x) OVER (PARTITION BY experiment, strategy, k) AS w FROM ew QUALIFY sum(x) OVER (PARTITION BY experiment, strategy, k) > 0
  UNION ALL SELECT experiment, 'MV', k, asset, w FROM mv WHERE aversion = 3)"""


def _pairwise(sweeps: int = 100) -> str:
    """x of min x'Qx/2 - mean'x, sum 1, x >= 0, by moving weight between two assets at a time, all pairs in turn."""
    g = lambda j: f"(list_dot_product(q[{j}], s.x) - mean[{j}])"
    step = f"least(greatest(-({g('e.i')} - {g('e.j')}) / (q[e.i][e.i] + q[e.j][e.j] - 2 * q[e.i][e.j]), -s.x[e.i]), s.x[e.j])"
    return f"""list_reduce(list_prepend({{'x': list_transform(mean, lambda v: 1.0::DOUBLE / len(mean)), 'i': 0::BIGINT, 'j': 0::BIGINT}},
      list_transform(list_filter(range({sweeps} * len(mean) * len(mean)), lambda t: t % (len(mean) * len(mean)) // len(mean) < t % len(mean)), lambda t: {{'x': []::DOUBLE[], 'i': (t % (len(mean) * len(mean)) // len(mean) + 1)::BIGINT, 'j': (t % len(mean) + 1)::BIGINT}})),
      lambda s, e: {{'x': list_transform(range(1, len(mean) + 1), lambda m: CASE WHEN m = e.i THEN s.x[m] + {step} WHEN m = e.j THEN s.x[m] - {step} ELSE s.x[m] END), 'i': e.i, 'j': e.j}}).x"""


def solved_weights(aversions: tuple[float, ...] = (3.0,), shrunk: bool = False) -> str:
    """CTEs after est and er that end in sw(experiment, strategy, k, asset, w) and mv(experiment, k, aversion, asset, w).

    shrunk: correlations are those of SHRINK, which then stands before.
    """
    head, tail = _SOLVED_WEIGHTS.split("sw AS MATERIALIZED", 1)
    if shrunk:
        before, after = head.split("ec AS MATERIALIZED (", 1)
        rest = after.split("GROUP BY 1, 2, 3, 4),", 1)[1]
        head = before + "ec AS MATERIALIZED (SELECT experiment, k, a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE (1 - x) * r + x * rb END AS c FROM pq JOIN si USING (experiment, k))," + rest
    return head + f"""mq AS (SELECT experiment, k, aversion, assets, mean, list_transform(range(1, len(sd) + 1), lambda i: list_transform(range(1, len(sd) + 1), lambda j: aversion * r[i][j] * sd[i] * sd[j])) AS q
  FROM em JOIN ev USING (experiment, k) JOIN (SELECT experiment, k, list(mean ORDER BY asset) AS mean FROM est GROUP BY 1, 2) USING (experiment, k) CROSS JOIN (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in aversions)}]) AS aversion)),
mv AS MATERIALIZED (SELECT experiment, k, aversion, unnest(assets) AS asset, unnest({_pairwise()}) AS w FROM mq),
sw AS MATERIALIZED""" + tail


#: CTEs that end in w, the weights of all strategies.
ALL_WEIGHTS = weights().replace("w AS (SELECT experiment, 'EW'", "w0 AS (SELECT experiment, 'EW'") + solved_weights() + ", w AS (SELECT experiment, strategy, k, asset, w FROM w0 UNION ALL SELECT experiment, strategy, k, asset, w FROM sw)"
ALL_METRICS = returns(made=ALL_WEIGHTS) + _METRICS.replace("rfs AS (", "rfs2 AS (")
