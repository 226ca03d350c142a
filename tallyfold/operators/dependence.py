"""Dependence between assets: pairs by blocks of arrays, summaries by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import written


#: Consecutive places of a series that are one array, and blocks that series are dealt over.
CHUNK, BLOCKS = 64, 16
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(df: DataFrame, keys: tuple[str, ...], order: str, item: str, value: str) -> DataFrame:
    """keys, a, b and sums n, x, y, xx, yy, xy over the places at which both of a pair a <= b of items have a value.

    Each item's values are cut into arrays of CHUNK places; arrays of a block of items are one row. Rows of the same
    chunk meet block by block, the upper triangle only, and give sums over a whole chunk for each pair of items. So
    what is joined and moved is smaller by CHUNK, and by the size of a block, than the pairs of values.
    order: whole numbers, each once for an item.
    """
    chunk, offset = F.floor(F.col(order) / CHUNK), F.pmod(F.col(order), F.lit(CHUNK)).cast("int")
    there = df.filter(F.col(value).isNotNull()).select(*keys, chunk.alias("chunk"), F.col(item).alias("item"), offset.alias("at"), F.col(value).cast("double").alias("v"))
    lined = there.groupBy(*keys, "chunk", "item").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.try_element_at("m", i))
    blocked = lined.select(*keys, "chunk", F.pmod(F.xxhash64("item"), F.lit(BLOCKS)).alias("block"), F.struct("item", places.alias("v")).alias("s"))
    rows = blocked.groupBy(*keys, "chunk", "block").agg(F.collect_list("s").alias("s"))
    right = rows.withColumnsRenamed({"block": "block2", "s": "s2"})

    def sums(p: Column, q: Column) -> Column:
        both = F.filter(F.zip_with(p["v"], q["v"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda t: t["x"].isNotNull() & t["y"].isNotNull())
        add = lambda acc, t: F.struct(
            (acc["n"] + 1).alias("n"), (acc["x"] + t["x"]).alias("x"), (acc["y"] + t["y"]).alias("y"),
            (acc["xx"] + t["x"] * t["x"]).alias("xx"), (acc["yy"] + t["y"] * t["y"]).alias("yy"), (acc["xy"] + t["x"] * t["y"]).alias("xy"),
        )
        return F.aggregate(both, F.struct(*(F.lit(0.0).alias(c) for c in _SUMS)), add)

    def pair(p: Column, q: Column) -> Column:
        return F.struct(p["item"].alias("a"), q["item"].alias("b"), sums(p, q).alias("s"))

    # within a block a pair stands in the order of its names; across blocks whichever comes first
    ordered = lambda p: F.transform("s2", lambda q: F.when(p["item"] <= q["item"], pair(p, q)).when(F.col("block") != F.col("block2"), pair(q, p)))
    met = rows.join(right, [*keys, "chunk"]).filter("block <= block2").select(*keys, F.inline(F.array_compact(F.flatten(F.transform("s", ordered)))))
    return met.groupBy(*keys, "a", "b").agg(*(F.sum(f"s.{c}").alias(c) for c in _SUMS)).filter("n > 0")


def moments(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, a, b, corr, cov (divisor n - 1) and n of every ordered pair of pair_sums(), the diagonal too."""
    n = F.col("n")
    cross, left, right = F.col("xy") - F.col("x") * F.col("y") / n, F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    both = F.array_distinct(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    own = sums.select(*keys, both.alias("both"), F.try_divide(cross, F.sqrt(left * right)).alias("corr"), F.try_divide(cross, n - 1).alias("cov"), n.cast("long").alias("n"))
    return own.select(*keys, F.inline("both"), "corr", "cov", "n")


def pair_moments(returns: DataFrame, value: str = "r") -> DataFrame:
    """a, b, corr, cov, n of every ordered pair of assets, from the sessions on which both have a value."""
    return moments(pair_sums(returns, (), "session", "asset", value))


def summary(pairs: DataFrame, universe: DataFrame) -> DataFrame:
    """Mean correlation of pairs, within and across sectors, and the two extreme pairs."""
    sector = universe.select("asset", "sector")
    named = pairs.filter("a < b").join(sector.select(F.col("asset").alias("a"), F.col("sector").alias("sa")), "a").join(sector.select(F.col("asset").alias("b"), F.col("sector").alias("sb")), "b")
    pair = F.concat_ws("/", "a", "b")
    return named.agg(
        F.avg("corr").alias("mean_corr"),
        F.avg(F.when(F.col("sa") == F.col("sb"), F.col("corr"))).alias("within"),
        F.avg(F.when(F.col("sa") != F.col("sb"), F.col("corr"))).alias("across"),
        F.max_by(pair, "corr").alias("max_pair"),
        F.min_by(pair, "corr").alias("min_pair"),
        F.count_if(F.col("corr") < 0).alias("n_negative"),
    )


def by_sector(pairs: DataFrame, universe: DataFrame, benchmark: str) -> DataFrame:
    """Mean correlation inside each sector, and of its assets with the benchmark."""
    sector = universe.select("asset", "sector")
    named = pairs.filter("a <> b").join(sector.select(F.col("asset").alias("a"), F.col("sector").alias("sa")), "a").join(sector.select(F.col("asset").alias("b"), F.col("sector").alias("sb")), "b")
    return named.groupBy(F.col("sa").alias("sector")).agg(
        F.avg(F.when(F.col("sa") == F.col("sb"), F.col("corr"))).alias("within"),
        F.avg(F.when(F.col("b") == benchmark, F.col("corr"))).alias("with_benchmark"),
        F.count_if(F.col("corr") < 0).alias("n_negative"),
    )


def with_others(pairs: DataFrame) -> DataFrame:
    """Each asset's mean correlation with the others and its spread."""
    return pairs.filter("a <> b").groupBy(F.col("a").alias("asset")).agg(F.avg("corr").alias("mean_corr"), F.stddev_samp("corr").alias("sd_corr"))


def squared(matrix: DataFrame) -> DataFrame:
    """a, b, x of a symmetric matrix times itself, over its trace."""
    right = matrix.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("x").alias("y"))
    product = matrix.join(right, "b").groupBy("a", "c").agg(F.sum(F.col("x") * F.col("y")).alias("x"))
    trace = product.filter("a = c").agg(F.sum("x").alias("trace"))
    return product.crossJoin(F.broadcast(trace)).select("a", F.col("c").alias("b"), (F.col("x") / F.col("trace")).alias("x"))  # one row


def top_eigenvalue(matrix: DataFrame, squarings: int) -> DataFrame:
    """One row (value): the largest eigenvalue of a symmetric matrix (a, b, x) without a larger negative one.

    After enough squarings only its own projection is left, whose product with the matrix has the eigenvalue as trace.
    """
    power = matrix
    for _ in range(squarings):
        power = written(squared(power))
    total = power.join(matrix.withColumnRenamed("x", "m"), ["a", "b"]).agg(F.sum(F.col("x") * F.col("m")).alias("value"))
    return total.crossJoin(power.filter("a = b").agg(F.sum("x").alias("trace"))).select((F.col("value") / F.col("trace")).alias("value"))  # one row each


def spectrum(pairs: DataFrame, squarings: int = 12) -> DataFrame:
    """Share of the largest eigenvalue, the smallest one and the condition number of the correlation matrix.

    By repeated squaring of the long table of pairs, so no task holds the matrix; the smallest is that of the matrix
    taken from the largest times one.
    """
    matrix = written(pairs.select("a", "b", F.col("corr").alias("x")))
    largest = written(top_eigenvalue(matrix, squarings).withColumnRenamed("value", "largest"))
    turned = matrix.crossJoin(F.broadcast(largest)).select("a", "b", (F.when(F.col("a") == F.col("b"), F.col("largest")).otherwise(0.0) - F.col("x")).alias("x"))  # one row
    gap = top_eigenvalue(written(turned), squarings).withColumnRenamed("value", "gap")
    size = matrix.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("x"))).alias("trace"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    one = largest.crossJoin(gap).crossJoin(size)  # one row each
    smallest = F.col("largest") - F.col("gap")
    return one.select("trace", "squares", (F.col("largest") / F.col("trace")).alias("first_share"), smallest.alias("smallest"), (F.col("largest") / smallest).alias("condition"))
