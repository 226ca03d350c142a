"""Extreme eigenvalues of many symmetric matrices at once: power iteration, and the same on the inverse, as folds in a row.

A row holds one matrix as an array of its rows, as wide as a portfolio has assets. Iteration stops where the Rayleigh
quotient moves by less than TOL of itself, or after ROUNDS rounds; rounds tells how many were taken. A singular matrix
has a null smallest eigenvalue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, TOL = 400, 1e-13
#: A pivot at or below this counts as zero.
SINGULAR = 1e-14


def matrices(pairs: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """keys and m, the matrix of each key, from rows (keys, a, b, value) of every ordered pair, the diagonal too."""
    lined = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b", F.col(value).alias("v")))).alias("s"))  # as many as a portfolio has pairs
    n = F.sqrt(F.size("s")).cast("int")
    return lined.select(*keys, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.slice("s", i * n + 1, n), lambda c: c["v"])).alias("m"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def top(m: Column) -> Column:
    """Struct (value, rounds) of the eigenvalue of largest size, from a start along 1, 1/2, 1/3, ..."""

    def step(now: Column, _: Column) -> Column:
        moved = F.transform(m, lambda row: dot(row, now["v"]))

        def go(w: Column) -> Column:
            value, size = dot(now["v"], w), F.sqrt(dot(w, w))
            settled = F.abs(value - now["value"]) <= TOL * F.abs(value)
            return F.struct(F.transform(w, lambda x: x / size).alias("v"), value.alias("value"), (now["rounds"] + 1).alias("rounds"), settled.alias("done"))

        return F.when(now["done"], now).otherwise(F.get(F.transform(F.array(moved), go), F.lit(0)))

    start = F.transform(m, lambda _, i: 1 / (i + 1).cast("double"))
    length = F.sqrt(dot(start, start))
    begin = F.struct(F.transform(start, lambda x: x / length).alias("v"), F.lit(0.0).alias("value"), F.lit(0).alias("rounds"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.struct(s["value"].alias("value"), s["rounds"].alias("rounds")))


def inverse(m: Column) -> Column:
    """The inverse of a positive definite matrix by Gauss and Jordan, with nulls where it is singular."""
    n = F.size(m)
    wide = F.transform(m, lambda row, i: F.concat(row, F.transform(row, lambda _, j: F.when(i == j, 1.0).otherwise(0.0))))

    def clear(now: Column, k: Column) -> Column:
        pivot = F.get(F.get(now, k), k)
        own = F.transform(F.get(now, k), lambda v: v / F.when(F.abs(pivot) > SINGULAR, pivot))
        return F.transform(now, lambda row, i: F.when(i == k, own).otherwise(F.zip_with(row, own, lambda v, p: v - F.get(row, k) * p)))

    done = F.aggregate(F.sequence(F.lit(0), n - 1), wide, clear)
    return F.transform(done, lambda row: F.slice(row, n + 1, n))


def extremes(matrices: DataFrame) -> DataFrame:
    """The rows of matrices (m) with largest, smallest and rounds, the most that either iteration took."""
    found = matrices.withColumn("inverse", inverse(F.col("m"))).withColumn("up", top(F.col("m"))).withColumn("down", top(F.col("inverse")))
    return found.withColumns({"largest": F.col("up.value"), "smallest": F.try_divide(F.lit(1.0), F.col("down.value")), "rounds": F.greatest("up.rounds", "down.rounds")}).drop("inverse", "up", "down")
