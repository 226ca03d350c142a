"""Market observations in long form, derived from an order book of line items.

An asset is a nation, its sector the region; a period's price is the mean unit price of what its customers bought,
damped by a power so that returns are of realistic size; the volume is the quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAMPING = 0.05


def period_end(day: Column, freq: str) -> Column:
    """Label of the period that holds day: the day, the Friday that ends its week, or the end of its month."""
    if freq == "daily":
        return day.cast("date")
    if freq == "weekly":
        return F.next_day(F.date_sub(day, 1), "FRI")
    if freq == "monthly":
        return F.last_day(day)
    raise ValueError(f"unknown frequency {freq!r}")


def daily_sums(spark: SparkSession, sf_dir: str, freq: str = "daily", level: str = "nation", end: str | None = None) -> DataFrame:
    """date (day), asset, total and n of the unit prices, volume: what the observations of any frequency are made from.

    end cuts days of periods whose date isn't before it.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    sold = sales(spark, sf_dir, freq, level, end)
    return sold.groupBy(F.to_date("l_shipdate").alias("date"), "asset").agg(F.sum(unit).alias("total"), F.count(unit).alias("n"), F.sum("l_quantity").alias("volume"))


def actions(spark: SparkSession, sf_dir: str, freq: str = "weekly", level: str = "nation") -> DataFrame:
    """date, asset, income and split of the periods with corporate actions, read off order lines of rare kinds.

    A line of one piece at the highest discount pays a quarter of its tax rate in income; one of the largest quantity at
    the highest discount and tax splits one share into 2, 3 or 1.25 by its return flag R, A or N. Of several the mean
    income and the largest split count; 0 is none.
    """
    income = F.when((F.col("l_quantity") == 1) & (F.col("l_discount") > 0.095), F.col("l_tax") / 4)
    ratio = F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "A", 3.0).otherwise(1.25)
    split = F.when((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075), ratio)
    sold = sales(spark, sf_dir, freq, level)
    found = sold.groupBy(period_end(F.col("l_shipdate"), freq).alias("date"), "asset").agg(F.coalesce(F.avg(income), F.lit(0.0)).alias("income"), F.coalesce(F.max(split), F.lit(0.0)).alias("split"))
    return found.filter("income <> 0 or split <> 0")


def sales(spark: SparkSession, sf_dir: str, freq: str = "daily", level: str = "nation", end: str | None = None) -> DataFrame:
    """Order lines with the asset of their customer."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    if end is not None:
        line = line.filter((F.col("l_shipdate") < F.lit(end).cast("date")) & (period_end(F.col("l_shipdate"), freq) < F.lit(end).cast("date")))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    if level == "region":
        nation = nation.join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.col("r_name" if level == "region" else "n_name").alias("asset"))
    owner = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return line.join(owner.select("o_orderkey", "asset"), line.l_orderkey == owner.o_orderkey)


def observations(spark: SparkSession, sf_dir: str, freq: str = "weekly", damping: float = DAMPING, level: str = "nation", end: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """date, asset, price, volume of every period in which an asset traded; level: nation, or region for small tables.

    end cuts periods whose date isn't before it; no day of the others comes after their date, so the scan stops there too.
    days: daily_sums() that were made before, for several frequencies.
    """
    if days is None:
        days = daily_sums(spark, sf_dir, freq, level, end)
    rolled = days.groupBy(period_end(F.col("date"), freq).alias("date"), "asset").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("volume").alias("volume"))
    return rolled.select("date", "asset", F.pow(F.try_divide(F.col("total"), F.col("n").cast("double")), F.lit(damping)).alias("price"), "volume")


def universe(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """asset, ord, sector, cost_bp: the fixed asset order and each asset's one-way cost in basis points."""
    if level == "region":
        region = spark.read.parquet(f"{sf_dir}/region.parquet")
        return region.select(F.col("r_name").alias("asset"), F.col("r_regionkey").cast("int").alias("ord"), F.lit("ALL").alias("sector"), (F.lit(2.0) + F.col("r_regionkey") % 4).alias("cost_bp"))
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_name").alias("asset"), F.col("n_nationkey").cast("int").alias("ord"), F.col("r_name").alias("sector"), (F.lit(2.0) + F.col("n_nationkey") % 4).alias("cost_bp"))


def risk_free(spark: SparkSession, sf_dir: str, freq: str = "weekly") -> DataFrame:
    """date, rf_pct: an annualised percentage for each period."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.groupBy(period_end(F.col("l_shipdate"), freq).alias("date")).agg((F.avg("l_tax") * 100).alias("rf_pct"))
