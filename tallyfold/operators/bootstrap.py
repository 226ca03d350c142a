"""Circular moving-block bootstrap of skewness from prefix sums: a draw costs its blocks, not its values.

For each series the running sums of its centred values, their squares and cubes are one row of arrays, continued past
the end by a block's width so that a block that wraps is a plain difference. A draw adds such differences over its
blocks, whose starts come from a hash of seed, series, draw and block, so that any engine repeats them. Draws are dealt
over tasks in runs of DRAWS_A_TASK; nothing is drawn per value.

A series is held whole by one row, so it is bounded by the calendar's sessions. Series with fewer than MIN_N values, or
without variance, have null results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import fanned
from . import carry

#: Resamples, seed, and the share of n in the exponent of a block's width, n^(1/3).
DRAWS, SEED = 2000, 7
DRAWS_A_TASK = 100
MIN_N = 8


def prefix_sums(r: DataFrame, value: str = "x") -> DataFrame:
    """asset, n, width, mean and p1, p2, p3: sums of the first 0..n+width values, less the mean, of the wrapped series, and of their powers.

    r: date, asset and a value without nulls to count; dates of an asset are distinct.
    """
    base = r.filter(F.col(value).isNotNull()).select("date", "asset", F.col(value).alias("x"))
    size = base.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))
    centred = base.join(size, "asset").select("asset", "date", "n", "mean", (F.col("x") - F.col("mean")).alias("d"))
    d = F.col("d")
    summed = carry.running(centred, ("asset",), "date", F.year("date"), p1=carry.total(d), p2=carry.total(d * d), p3=carry.total(d * d * d))
    lined = summed.groupBy("asset", "n", "mean").agg(F.sort_array(F.collect_list(F.struct("date", "p1", "p2", "p3"))).alias("s"))  # one row a session
    width = F.greatest(F.lit(1), F.rint(F.pow(F.col("n").cast("double"), F.lit(1 / 3))).cast("int"))

    def wrapped(c: str) -> Column:
        sums = F.concat(F.array(F.lit(0.0)), F.transform("s", lambda v: v[c]))
        whole = F.element_at(F.col("s"), -1)[c]
        return F.concat(sums, F.transform(F.sequence(F.lit(1), F.col("width")), lambda j: whole + F.element_at(sums, j + 1))).alias(c)

    ready = lined.withColumn("width", width).filter(F.col("n") >= MIN_N)
    return ready.select("asset", "n", "width", "mean", wrapped("p1"), wrapped("p2"), wrapped("p3"))


def _start(label: Column, draw: Column, block: Column, n: Column) -> Column:
    """Start of a block: eight hexadecimal digits of the hash of label, draw and block / 4, scaled to 0..n-1."""
    h = F.md5(F.concat_ws(":", label, draw.cast("string"), F.floor(block / 4).cast("string")).cast("binary"))
    digits = F.substring(h, (block % 4).cast("int") * 8 + 1, F.lit(8))
    return F.shiftright(F.conv(digits, 16, 10).cast("long") * n, 32).cast("int")


def skew_draws(r: DataFrame, draws: int = DRAWS, seed: int = SEED, value: str = "x") -> DataFrame:
    """asset, draw, n and skew: the skewness (divisor n) of each resample of each series."""
    sums = prefix_sums(r, value)
    runs = sums.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_A_TASK))))
    first = F.col("run") * DRAWS_A_TASK
    spread = fanned(runs, "asset", "run").withColumn("draw", F.explode(F.sequence(first, F.least(first + DRAWS_A_TASK, F.lit(draws)) - 1)))
    n, width = F.col("n"), F.col("width")
    blocks = F.ceil(n / width).cast("int")
    label = F.concat_ws(":", F.lit(str(seed)), "asset")

    def add(acc: Column, b: Column) -> Column:
        at = _start(label, F.col("draw"), b, n)
        # the last block is cut so that a resample has n values
        to = at + F.when(b == blocks - 1, (n - b * width).cast("int")).otherwise(width)
        return F.struct(*((acc[c] + F.element_at(c, to + 1) - F.element_at(c, at + 1)).alias(c) for c in ("p1", "p2", "p3")))

    nothing = F.struct(*(F.lit(0.0).alias(c) for c in ("p1", "p2", "p3")))
    s = spread.select("asset", "draw", "n", F.aggregate(F.sequence(F.lit(0), blocks - 1), nothing, add).alias("s"))
    m, m2, m3 = (F.col(f"s.{c}") / F.col("n") for c in ("p1", "p2", "p3"))
    var = m2 - m * m
    return s.select("asset", "draw", "n", F.try_divide(m3 - 3 * m * m2 + 2 * m * m * m, F.pow(F.when(var > 0, var), F.lit(1.5))).alias("skew"))


def skew_tests(r: DataFrame, draws: int = DRAWS, seed: int = SEED, value: str = "x") -> DataFrame:
    """asset, n, skew, p, se, textbook of each series.

    p is the share of resamples whose skewness lies as far from their mean as the series' own from zero, se their
    standard deviation, textbook the standard error for normal values.
    """
    own = r.filter(F.col(value).isNotNull()).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.skewness(value).alias("own"))
    drawn = skew_draws(r, draws, seed, value).select("asset", "skew")
    # one number a draw, 2,000 of them a series
    middle = drawn.groupBy("asset").agg(F.avg("skew").alias("middle"), F.stddev_samp("skew").alias("se"), F.collect_list("skew").alias("skews"))
    far = F.size(F.filter("skews", lambda s: F.abs(s - F.col("middle")) >= F.abs(F.col("own"))))
    n = F.col("n")
    textbook = F.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))
    enough = n >= MIN_N
    return own.join(middle, "asset", "left").select(
        "asset", "n", F.col("own").alias("skew"),
        F.when(enough & (F.size("skews") > 0), far / F.size("skews")).alias("p"), F.when(enough, F.col("se")).alias("se"), textbook.alias("textbook"),
    )
