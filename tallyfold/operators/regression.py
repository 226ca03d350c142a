"""Least squares as columns: one aggregation gives the cross products of many regressions, and elimination inside the
row solves each of them.

A regression is a key; its rows hold an array of features, the last of which is explained by the others. The cross
products are summed in parts before anything moves, and what is left for a key is a matrix as large as its features,
whatever its rows. Columns that depend on one another leave a pivot of zero and give null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf

#: A pivot below this share of its column's sum of squares counts as zero.
SINGULAR = 1e-12


def cross_products(rows: DataFrame, keys: tuple[str, ...], features: str) -> DataFrame:
    """keys, n and m, the matrix of sums of products of each two of the features, over the rows of a key."""
    size = F.size(features)
    pair = lambda i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get(features, i) * F.get(features, j)).alias("v")))
    each = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), pair))
    summed = rows.select(*keys, size.alias("size"), F.inline(each)).groupBy(*keys, "size", "i", "j").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))
    # as many rows a key as the matrix has places
    place = F.col("i") * F.col("size") + F.col("j")
    lined = summed.groupBy(*keys, "size", "n").agg(F.map_from_entries(F.collect_list(F.struct(place, "v"))).alias("at"))
    at = lambda i, j: F.element_at("at", F.least(i, j) * F.col("size") + F.greatest(i, j))
    every = F.sequence(F.lit(0), F.col("size") - 1)
    return lined.select(*keys, "n", F.transform(every, lambda i: F.transform(every, lambda j: at(i, j))).alias("m"))


def eliminated(m: Column) -> Column:
    """The matrix with all columns but the last cleared by their pivots (Gauss and Jordan); no pivot is zero in a regular one.

    The last row and column then hold the residual sum of squares, and the last column over the pivots the coefficients.
    """

    def clear(now: Column, k: Column) -> Column:
        row = F.get(now, k)
        pivot = F.get(row, k)
        usable = F.when(pivot > SINGULAR * F.get(F.get(m, k), k), pivot)
        return F.transform(now, lambda r, i: F.when(i == k, r).otherwise(F.transform(r, lambda v, j: v - F.get(r, k) / usable * F.get(row, j))))

    return F.aggregate(F.sequence(F.lit(0), F.size(m) - 2), m, clear)


def least_squares(products: DataFrame) -> DataFrame:
    """cross_products() with coefficients (array, in the order of the features), rss and, where the first feature is 1, tss."""
    solved = products.withColumn("e", eliminated(F.col("m")))
    last = F.size("m") - 1
    corner = lambda m: F.get(F.get(F.col(m), last), last)
    coefficients = F.transform(F.slice("e", 1, last), lambda r, i: F.get(r, last) / F.get(r, i))
    mean = F.get(F.get("m", F.lit(0)), last)
    return solved.withColumns({"coefficients": coefficients, "rss": corner("e"), "tss": corner("m") - mean * mean / F.col("n")}).drop("e")


def _lined(r: DataFrame, value: Column, deepest: int) -> DataFrame:
    """asset, lined: each value after the deepest ones before it, latest last, as far as they are there."""
    before = Window.partitionBy("asset").orderBy("date").rowsBetween(-deepest, Window.currentRow)
    return r.select("asset", F.collect_list(value).over(before).alias("lined"))


def arch_lm(r: DataFrame, lags: tuple[int, ...], value: str = "x") -> DataFrame:
    """asset, lags, n, lm and p: observations times R squared of squared demeaned values on as many of their lags.

    r: date, asset and a value; rows without one are left out. Values are scaled to a mean square of one, which changes
    no R squared.
    """
    known = r.filter(F.col(value).isNotNull())
    mean = known.groupBy("asset").agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    square = F.try_divide(F.pow(F.col(value) - F.col("mean"), F.lit(2.0)), F.col("var"))
    lined = _lined(known.join(mean, "asset").filter("var > 0"), square, max(lags))
    each = lined.select("asset", "lined", F.explode(F.array(*map(F.lit, lags))).alias("lags")).filter("size(lined) > lags")
    features = F.concat(F.array(F.lit(1.0)), F.slice("lined", -F.col("lags") - 1, F.col("lags") + 1))
    found = least_squares(cross_products(each.select("asset", "lags", features.alias("f")), ("asset", "lags"), "f"))
    lm = F.col("n") * (1 - F.try_divide("rss", "tss"))
    p = F.coalesce(*(F.when(F.col("lags") == k, chi2_sf(F.col("lm"), k)) for k in lags))
    return found.withColumn("lm", lm).select("asset", "lags", "n", "lm", p.alias("p"))


def autoregression(r: DataFrame, order: int = 1, value: str = "x") -> DataFrame:
    """asset, n, intercept, slopes (nearest lag first) and r2 of each value on as many before it."""
    lined = _lined(r.filter(F.col(value).isNotNull()), F.col(value), order).filter(F.size("lined") == order + 1)
    found = least_squares(cross_products(lined.select("asset", F.concat(F.array(F.lit(1.0)), "lined").alias("f")), ("asset",), "f"))
    return found.select("asset", "n", F.get("coefficients", F.lit(0)).alias("intercept"), F.reverse(F.slice("coefficients", 2, order)).alias("slopes"), (1 - F.try_divide("rss", "tss")).alias("r2"))
