"""Verdicts on six stylised facts for each series: supported, partial or not supported, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05
NEGLIGIBLE = 0.10
SUPPORTED, PARTIAL, NOT_SUPPORTED = "Supported", "Partial", "Not supported"


def grade(full: Column, part: Column) -> Column:
    """Unknown counts as not."""
    return F.when(full, SUPPORTED).when(part, PARTIAL).otherwise(NOT_SUPPORTED)


def serial_correlation(portmanteau: DataFrame, acf: DataFrame) -> DataFrame:
    """Supported if the robust portmanteau never rejects; partial if every |rho| up to lag 20 is negligible."""
    worst = acf.filter("lag <= 20").groupBy("asset").agg(F.max(F.abs("raw")).alias("max_rho"), F.max_by("lag", F.abs("raw")).alias("at"))
    least = portmanteau.groupBy("asset").agg(F.min("p").alias("p"))
    evidence = F.format_string("least p %.3f; max |rho| %.2f at lag %d", "p", "max_rho", "at")
    return least.join(worst, "asset").select("asset", F.lit(1).alias("fact"), grade(F.col("p") >= ALPHA, F.col("max_rho") < NEGLIGIBLE).alias("verdict"), evidence.alias("evidence"))


def _p(tests: DataFrame, name: str, out: str) -> DataFrame:
    return tests.filter(F.col("test") == name).select("asset", F.col("p").alias(f"{out}_p"), F.col("stat").alias(f"{out}_stat"))


def fat_tails(described: DataFrame, tests: DataFrame) -> DataFrame:
    """Supported if Jarque-Bera rejects with significant positive kurtosis; partial if any normality test rejects."""
    j = described.select("asset", "kurt", "jb_p")
    for name, out in (("shapiro", "sw"), ("anderson", "ad"), ("kurtosis", "ku")):
        j = j.join(_p(tests, name, out), "asset")
    jb = F.col("jb_p") < ALPHA
    full = jb & (F.col("kurt") > 0) & (F.col("ku_p") < ALPHA)
    return j.select("asset", F.lit(2).alias("fact"), grade(full, jb | (F.col("sw_p") < ALPHA) | (F.col("ad_p") < ALPHA)).alias("verdict"), F.format_string("excess kurtosis %.2f; JB p %.3f", "kurt", "jb_p").alias("evidence"))


def negative_skew(tests: DataFrame) -> DataFrame:
    """How many of moment and quantile skewness are negative and significant: both, one, none."""
    j = _p(tests, "skew", "s").join(_p(tests, "quantile skew", "q"), "asset")
    a, b = ((F.col(f"{c}_stat") < 0) & (F.col(f"{c}_p") < ALPHA) for c in "sq")
    return j.select("asset", F.lit(3).alias("fact"), grade(a & b, a | b).alias("verdict"), F.format_string("skew %.2f, p %.3f; quantile skew %.2f, p %.3f", "s_stat", "s_p", "q_stat", "q_p").alias("evidence"))


def clustering(ljung: DataFrame, tests: DataFrame) -> DataFrame:
    """Supported if Ljung-Box of absolute and squared values and ARCH-LM reject at every lag; partial if some do."""
    p = ljung.filter("transform <> 'raw'").select("asset", "p").unionByName(tests.filter(F.col("test").startswith("arch-lm")).select("asset", "p"))
    n = p.groupBy("asset").agg(F.count_if(F.col("p") < ALPHA).alias("hits"), F.count(F.lit(1)).alias("of"))
    return n.select("asset", F.lit(4).alias("fact"), grade(F.col("hits") == F.col("of"), F.col("hits") > 0).alias("verdict"), F.format_string("%d of %d tests reject", "hits", "of").alias("evidence"))


def leverage(fits: DataFrame) -> DataFrame:
    """How many converged asymmetric models have a significant term of the leverage sign: both, one, none."""
    g = fits.filter((F.col("parameter") == "gamma") & F.col("model").isin("GJR-t", "EGARCH-t"))
    sign = F.when(F.col("model") == "GJR-t", 1.0).otherwise(-1.0)
    hit = F.col("converged") & (F.col("estimate") * sign > 0) & (F.col("p") < ALPHA)
    n = g.groupBy("asset").agg(F.count_if(hit).alias("hits"), F.count_if(~F.col("converged")).alias("failed"))
    return n.select("asset", F.lit(5).alias("fact"), grade(F.col("hits") == 2, F.col("hits") == 1).alias("verdict"), F.format_string("%d significant, %d not converged", "hits", "failed").alias("evidence"))


def conditional_normality(residuals: DataFrame, persisted: DataFrame, model: str = "GJR-t") -> DataFrame:
    """Supported if Jarque-Bera rejects on the residuals of a model that identifies clustering; partial if it doesn't identify any.

    residuals: what describe() gives of standardised residuals; persisted: what persistence() gives.
    """
    j = residuals.select("asset", "kurt", "jb_p").join(persisted.filter(F.col("model") == model).select("asset", "degenerate"), "asset")
    rejects = F.col("jb_p") < ALPHA
    return j.select("asset", F.lit(6).alias("fact"), grade(rejects & ~F.col("degenerate"), rejects).alias("verdict"), F.format_string("residual excess kurtosis %.2f; JB p %.3f", "kurt", "jb_p").alias("evidence"))
