"""Distribution functions that Spark lacks, as columns."""

from __future__ import annotations

from math import factorial, gamma, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series of erf below SPLIT; nodes of the integral of erfc above it.
TERMS, NODES, SPLIT = 36, 24, 2.0


def series_terms() -> list[float]:
    """Coefficients of erf(x) / x in powers of x squared."""
    return [2 / sqrt(pi) * (-1) ** k / (factorial(k) * (2 * k + 1)) for k in range(TERMS)]


def node_rates() -> list[float]:
    """1 / sin^2 of the midpoints of Craig's integral: erfc(x) is the mean of exp(-x^2 / sin^2)."""
    return [1 / sin((k + 0.5) * pi / (2 * NODES)) ** 2 for k in range(NODES)]


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    low = F.aggregate(F.lit(series_terms()[::-1]), F.lit(0.0), lambda acc, c: acc * (x * x) + c)
    return F.when(x < SPLIT, 1 - x * low).otherwise(_mean_exp(x, node_rates()))


def _mean_exp(x: Column, rates: list[float]) -> Column:
    """Mean of exp(-x^2 rate). A fold, so that the expression is small and compiles."""
    return F.aggregate(F.lit(rates), F.lit(0.0), lambda acc, rate: acc + F.exp(-x * x * rate)) / NODES


def normal_sf(x: Column) -> Column:
    """Upper tail of the standard normal."""
    tail = erfc(F.abs(x) / sqrt(2)) / 2
    return F.when(x >= 0, tail).otherwise(1 - tail)


#: Levels of the continued fraction of erfc above SPLIT.
LEVELS = 80


def fraction_steps() -> list[float]:
    """k / 2 from the innermost level out, of erfc(u) = exp(-u^2) / sqrt(pi) / (u + 1/2 / (u + 2/2 / (u + ...)))."""
    return [k / 2 for k in range(LEVELS, 0, -1)]


def half_log_tail(u: Column) -> Column:
    """log(erfc(u) / 2) of a column u >= 0, as exact far out as near zero: there by Laplace's continued fraction."""
    fraction = F.aggregate(F.lit(fraction_steps()), u, lambda t, c: u + c / t)
    return F.when(u < SPLIT, F.log(erfc(u) / 2)).otherwise(-u * u - F.log(2 * sqrt(pi) * fraction))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square with a whole number of degrees of freedom, in closed form."""
    if df <= 0:
        raise ValueError("df must be positive")
    half, total = x / 2, F.lit(0.0)
    for j in range((df + 1) // 2 - (df % 2)):
        power = j + 0.5 * (df % 2)
        total = total + F.pow(half, F.lit(power)) / F.lit(gamma(power + 1))
    tail = F.exp(-half) * total
    return tail + erfc(F.sqrt(half)) if df % 2 else tail


#: Acklam's rational approximation of the normal quantile, middle and tail, and where they meet.
MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
MEET = 0.02425


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, to nine digits."""
    q = p - 0.5
    middle = q * _polynomial(q * q, MIDDLE[0]) / _polynomial(q * q, MIDDLE[1])
    far = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(far, TAIL[0]) / _polynomial(far, TAIL[1])
    return F.when(F.abs(q) <= 0.5 - MEET, middle).when(q < 0, tail).otherwise(-tail)


def student5_quantile(p: Column) -> Column:
    """Inverse of Student's distribution with 5 degrees of freedom, by halving the angle atan(t / sqrt(5)) 50 times."""
    target = (p - 0.5) * pi
    step = lambda s, i: F.struct(
        F.when(_angle(s["at"]) < target, s["at"] + s["width"] / 2).otherwise(s["at"] - s["width"] / 2).alias("at"), (s["width"] / 2).alias("width")
    )
    begin = F.struct(F.lit(0.0).alias("at"), F.lit(pi / 2).alias("width"))
    return F.tan(F.aggregate(F.sequence(F.lit(1), F.lit(50)), begin, step, lambda s: s["at"])) * sqrt(5)


def _angle(a: Column) -> Column:
    """(F(t) - 1/2) pi of Student's distribution with 5 degrees of freedom at t = sqrt(5) tan(a)."""
    return a + F.sin(a) * F.cos(a) * (1 + F.cos(a) * F.cos(a) * 2 / 3)
