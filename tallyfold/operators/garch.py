"""Conditional-variance models as folds over a series' array, and their fit by a compass search, all in columns.

A row is a series with its values in the order of dates; a model's log-likelihood at given parameters is one fold over
them. The search tries a step up and down in each parameter and along the way it came, goes where the likelihood is highest, doubles its steps
there and halves them where none is better; it looks at nothing but likelihoods, so an engine that folds in the same order takes the same
way. Steps are taken in the mean, the log of the long-run variance, the persistence, the shock terms and the log of
the degrees of freedom, which depend on one another far less than the models' own parameters.

A series is held whole by one row, so it is bounded by the calendar's sessions; series and models are dealt over tasks.
Series with fewer than MIN_N values or without variance have no rows.
"""

from __future__ import annotations

from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import fanned

MODELS = ("GARCH-N", "GARCH-t", "GJR-t", "EGARCH-t")
PARAMETERS = ("mu", "omega", "alpha", "gamma", "beta", "nu")
#: Places in the search's vector, with where it begins (less the mean and log variance of the series) and its first step.
MU, LEVEL, KEPT, SHOCK, LEAN, FREEDOM = range(6)
BEGIN = (0.0, 0.0, 0.9, 0.08, 0.02, log(8.0))
STEP = (0.1, 0.2, 0.05, 0.05, 0.1, 0.3)
ROUNDS, FINEST = 160, 2.0**-12
#: How much of the drift, the sum of the steps taken, is left after a further one, and how far along it is tried.
FADING, ONWARD = 0.75, (0.25, 1.0, 4.0, -0.5)
#: Pairs of places that are also stepped together: they make up for one another, and three of them leave beta as it is.
TOGETHER = ((LEVEL, KEPT), (KEPT, SHOCK), (KEPT, LEAN), (SHOCK, LEAN))
MIN_N = 30
#: Decay and length of the weights of the first variance.
DECAY, DEPTH = 0.94, 75
NU_BOUNDS = (2.05, 500.0)
MEAN_ABS = sqrt(2 / pi)
#: Coefficients of Stirling's series, 1/12, -1/360, 1/1260, -1/1680.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
SHIFT = 10


def free(model: str) -> tuple[int, ...]:
    """Places of the search's vector that the model has."""
    return (MU, LEVEL, KEPT, SHOCK, *((LEAN,) if model[:2] in ("GJ", "EG") else ()), *((FREEDOM,) if model.endswith("-t") else ()))


def log_gamma(z: Column) -> Column:
    """Log of the gamma function of z > 0, by Stirling's series after SHIFT steps up."""
    up = z + SHIFT
    series = sum((F.lit(c) / F.pow(up, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda acc, k: acc + F.log(z + k))
    return (up - 0.5) * F.log(up) - up + 0.5 * log(2 * pi) + series - steps


def natural(model: str, p: Column) -> Column:
    """The model's parameters (struct) at a vector of the search."""
    at = lambda k: F.get(p, F.lit(k))
    gamma = at(LEAN) if LEAN in free(model) else F.lit(0.0)
    egarch = model.startswith("EGARCH")
    beta = at(KEPT) if egarch else at(KEPT) - at(SHOCK) - gamma / 2
    omega = (1 - at(KEPT)) * (at(LEVEL) if egarch else F.exp(at(LEVEL)))
    nu = F.exp(at(FREEDOM)) if FREEDOM in free(model) else F.lit(0.0)
    return F.struct(at(MU).alias("mu"), omega.alias("omega"), at(SHOCK).alias("alpha"), gamma.alias("gamma"), beta.alias("beta"), nu.alias("nu"))


def first_variance(x: Column, mu: Column) -> Column:
    """Weighted mean of the first squared residuals, the weights falling by DECAY."""
    weighted = F.aggregate(
        F.transform(F.slice(x, 1, DEPTH), lambda v, i: F.struct(((v - mu) * (v - mu)).alias("square"), F.pow(F.lit(DECAY), i.cast("double")).alias("weight"))),
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda acc, v: F.struct((acc["a"] + v["square"] * v["weight"]).alias("a"), (acc["b"] + v["weight"]).alias("b")),
    )
    return _once(weighted, lambda w: w["a"] / w["b"])


def _once(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _inside(model: str, q: Column) -> Column:
    if model.startswith("EGARCH"):
        fine = F.abs(q["beta"]) < 1
    else:
        fine = (q["omega"] > 0) & (q["alpha"] >= 0) & (q["beta"] >= 0) & (q["alpha"] + q["gamma"] >= 0) & (q["alpha"] + q["beta"] + q["gamma"] / 2 < 1)
    return fine & (q["nu"] > NU_BOUNDS[0]) & (q["nu"] < NU_BOUNDS[1]) if model.endswith("-t") else fine


def _next(model: str, q: Column, h: Column, e: Column) -> Column:
    """Variance after a residual e of variance h."""
    if model.startswith("EGARCH"):
        z = e / F.sqrt(h)
        return F.exp(q["omega"] + q["alpha"] * (F.abs(z) - MEAN_ABS) + q["gamma"] * z + q["beta"] * F.log(h))
    return q["omega"] + (q["alpha"] + F.when(e < 0, q["gamma"]).otherwise(0.0)) * e * e + q["beta"] * h


def _first(model: str, x: Column, q: Column) -> Column:
    """Variance of the first value; before it comes a shock of average size and either sign."""
    before = first_variance(x, q["mu"])
    return before if model.startswith("EGARCH") else q["omega"] + (q["alpha"] + q["gamma"] / 2 + q["beta"]) * before


def log_likelihood(model: str, x: Column, q: Column) -> Column:
    """Log-likelihood of the values x at parameters q (struct), null outside the model's bounds."""

    def of(q: Column) -> Column:
        def step(acc: Column, v: Column) -> Column:
            """The state holds the variance of the value to come and the sum so far."""
            e, h = v - q["mu"], acc["h"]
            if model.endswith("-t"):
                term = -0.5 * F.log(h) - (q["nu"] + 1) / 2 * F.log1p(e * e / (h * (q["nu"] - 2)))
            else:
                term = -0.5 * (F.log(h) + e * e / h)
            return F.struct(_next(model, q, h, e).alias("h"), (acc["ll"] + term).alias("ll"))

        each = log_gamma((q["nu"] + 1) / 2) - log_gamma(q["nu"] / 2) - 0.5 * F.log(pi * (q["nu"] - 2)) if model.endswith("-t") else F.lit(-0.5 * log(2 * pi))
        begin = F.struct(_first(model, x, q).alias("h"), F.lit(0.0).alias("ll"))
        return F.when(_inside(model, q), F.aggregate(x, begin, step, lambda acc: acc["ll"]) + F.size(x) * each)

    return _once(q, of)


def standardised(model: str, x: Column, q: Column) -> Column:
    """Array of the values less their mean over their conditional deviations."""

    def step(acc: Column, v: Column) -> Column:
        e = v - q["mu"]
        return F.struct(_next(model, q, acc["h"], e).alias("h"), F.concat(acc["z"], F.array(e / F.sqrt(acc["h"]))).alias("z"))

    begin = F.struct(_first(model, x, q).alias("h"), F.expr("cast(array() as array<double>)").alias("z"))
    return F.aggregate(x, begin, step, lambda acc: acc["z"])


def series(r: DataFrame, value: str = "x") -> DataFrame:
    """asset, n, mean, var and x, the array of its values by date."""
    lined = r.filter(F.col(value).isNotNull()).groupBy("asset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"),
        F.transform(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))), lambda s: s["v"]).alias("x"),  # one value a session
    )
    return lined.filter((F.col("n") >= MIN_N) & (F.col("var") > 0))


def moves(model: str) -> list[list[float]]:
    """A step up and one down in each of the model's parameters, and in each two that go together."""
    own = free(model)
    ways = [{j: sign} for j in own for sign in (1.0, -1.0)] + [{i: a, j: b} for i, j in TOGETHER if i in own and j in own for a in (1.0, -1.0) for b in (1.0, -1.0)]
    return [[way.get(k, 0.0) * STEP[k] for k in range(6)] for way in ways]


def fitted(lined: DataFrame, model: str) -> DataFrame:
    """asset, n, x, q (the parameters found) and loglik of every series()."""
    # the mean moves by shares of the series' deviation
    scaled = F.array(F.sqrt("var"), *(F.lit(1.0) for _ in range(5)))
    begin = F.array(F.col("mean"), F.log("var"), *(F.lit(b) for b in BEGIN[2:]))
    x = F.col("x")
    worst = F.lit(float("-inf"))
    value = lambda p: F.coalesce(log_likelihood(model, x, natural(model, p)), worst)

    add = lambda p, d, by: F.zip_with(p, d, lambda a, b: a + b * by)

    def round_(state: Column, _: Column) -> Column:
        steps = F.transform(F.lit(moves(model)), lambda d: add(state["p"], F.zip_with(d, F.col("unit"), lambda a, b: a * b), state["scale"]))
        tried = F.concat(steps, F.transform(F.lit(list(ONWARD)), lambda by: add(state["p"], state["drift"], by)))
        best = F.array_max(F.transform(tried, lambda p: F.struct(value(p).alias("ll"), p.alias("p"))))

        def go(b: Column) -> Column:
            drift = F.zip_with(state["drift"], add(b["p"], state["p"], -1.0), lambda a, c: a * FADING + c)
            moved = F.struct(b["p"].alias("p"), drift.alias("drift"), F.least(state["scale"] * 2, F.lit(1.0)).alias("scale"), b["ll"].alias("ll"))
            stayed = F.struct(state["p"].alias("p"), state["drift"].alias("drift"), (state["scale"] / 2).alias("scale"), state["ll"].alias("ll"))
            return F.when(b["ll"] > state["ll"], moved).otherwise(stayed)

        return F.when(state["scale"] < FINEST, state).otherwise(_once(best, go))

    at = F.struct(F.col("begin").alias("p"), F.lit([0.0] * 6).alias("drift"), F.lit(1.0).alias("scale"), value(F.col("begin")).alias("ll"))
    found = lined.withColumn("unit", scaled).withColumn("begin", begin).withColumn("found", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), at, round_))
    return found.select("asset", "n", "x", natural(model, F.col("found.p")).alias("q"), F.col("found.ll").alias("loglik"))


def profiles(r: DataFrame, models: tuple[str, ...] = MODELS, share: float = 0.01, value: str = "x") -> DataFrame:
    """asset, model, n, parameter, estimate, loglik, lower, higher and largest, one row a parameter of each fit.

    lower and higher are the log-likelihoods with the parameter alone less or more by a share of itself, null where that
    is out of bounds; largest tells whether neither is above the fit's.
    """
    dealt = fanned(series(r, value), "asset")
    out = None
    for model in models:
        own = [PARAMETERS[i] for i in ((0, 1, 2, 4) if model.startswith("GARCH") else (0, 1, 2, 3, 4))] + (["nu"] if model.endswith("-t") else [])

        def moved(name: str, by: float, model: str = model) -> Column:
            q = F.struct(*((F.col("q")[c] * (by if c == name else 1.0)).alias(c) for c in PARAMETERS))
            return log_likelihood(model, F.col("x"), q)

        rows = F.array(*(F.struct(F.lit(c).alias("parameter"), F.col("q")[c].alias("estimate"), moved(c, 1 - share).alias("lower"), moved(c, 1 + share).alias("higher")) for c in own))
        one = fitted(dealt, model).select("asset", F.lit(model).alias("model"), "n", "loglik", F.inline(rows))
        out = one if out is None else out.unionByName(one)
    none_above = F.greatest(F.coalesce("lower", F.lit(float("-inf"))), F.coalesce("higher", F.lit(float("-inf")))) <= F.col("loglik") + 1e-6
    return out.select("asset", "model", "n", "parameter", "estimate", "loglik", "lower", "higher", none_above.alias("largest"))


def residuals(r: DataFrame, model: str, value: str = "x") -> DataFrame:
    """asset, date (the place in the series) and x, the standardised residual under the model as fitted()."""
    found = fitted(fanned(series(r, value), "asset"), model)
    return found.select("asset", F.posexplode(standardised(model, F.col("x"), F.col("q"))).alias("date", "x"))


def persistence(r: DataFrame, model: str, value: str = "x") -> DataFrame:
    """asset, persistence, half_life (periods until half of a shock is left, null where none ends) and nu of each fit."""
    q = F.col("q")
    kept = q["beta"] if model.startswith("EGARCH") else q["alpha"] + q["beta"] + q["gamma"] / 2
    found = fitted(fanned(series(r, value), "asset"), model).select("asset", kept.alias("persistence"), q["nu"].alias("nu"))
    half = F.when((F.col("persistence") > 0) & (F.col("persistence") < 1), F.log(F.lit(0.5)) / F.log("persistence"))
    return found.select("asset", "persistence", half.alias("half_life"), "nu")
