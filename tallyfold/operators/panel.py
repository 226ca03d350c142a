"""Aligning irregular prices to a calendar, filling short gaps, and auditing what was done.

Panels are long: session, date, asset, price_raw, price, with null for missing. A session is the place of its date in
the calendar. Only the calendar's numbering is a window without a key; it has one row a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import carry

FILL_LIMIT = 3
EXTREME_MOVE = 0.15
STALE = 1e-12
#: Sessions of a block of a series, about a year of days.
BLOCK = 256


def block() -> Column:
    return F.floor(F.col("session") / BLOCK)


def _by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("session")


def _so_far() -> WindowSpec:
    return _by_asset().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def calendar(obs: DataFrame, reference: str | None = None, start: str | None = None) -> DataFrame:
    """session, date: the dates on which the reference asset (or any) has a price."""
    dates = obs.filter("price is not null")
    if reference is not None:
        dates = dates.filter(F.col("asset") == reference)
    if start is not None:
        dates = dates.filter(F.col("date") >= F.lit(start).cast("date"))
    return dates.select("date").distinct().select(F.row_number().over(Window.orderBy("date")).alias("session"), "date")


def off_calendar(obs: DataFrame, cal: DataFrame) -> DataFrame:
    """asset, dropped: observations from the calendar's start on dates it lacks."""
    first = cal.agg(F.min("date").alias("first"))
    late = obs.crossJoin(F.broadcast(first)).filter("date >= first and price is not null").select("asset", "date")  # one row
    return late.join(cal, "date", "left_anti").groupBy("asset").agg(F.count(F.lit(1)).alias("dropped"))


def align(obs: DataFrame, cal: DataFrame, assets: DataFrame, limit: int = FILL_LIMIT) -> DataFrame:
    """The panel on calendar x assets; each gap's first limit sessions carry the last price, nothing comes before the first."""
    grid = cal.crossJoin(assets.select("asset"))  # every cell of the panel is a row of the result
    panel = grid.join(obs.select("date", "asset", F.col("price").alias("price_raw"), "volume"), ["date", "asset"], "left")
    there = F.when(F.col("price_raw").isNotNull(), F.struct("session", "price_raw"))
    carried = carry.running(panel, ("asset",), "session", block(), last=carry.last_seen(there))
    price = F.when(F.col("session") - F.col("last.session") <= limit, F.col("last.price_raw"))
    return carried.select("session", "date", "asset", "price_raw", price.alias("price"), "volume")


def align_series(series: DataFrame, cal: DataFrame, value: str, limit: int | None = FILL_LIMIT) -> DataFrame:
    """session, date, value of one series on the calendar, carried over at most limit sessions (None: any number)."""
    joined = cal.join(series, "date", "left")
    order = Window.orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col(value).isNotNull(), F.col("session")), ignorenulls=True).over(order)
    last = F.last(value, ignorenulls=True).over(order)
    return joined.select("session", "date", (last if limit is None else F.when(F.col("session") - seen <= limit, last)).alias(value))


def fill_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy("asset").agg(F.count_if(F.col("price_raw").isNull() & F.col("price").isNotNull()).alias("filled"))


def gap_islands(panel: DataFrame, column: str = "price") -> DataFrame:
    """asset, gap_start, gap_end, sessions of each run of missing values after the asset's first value."""
    first = panel.filter(F.col(column).isNotNull()).groupBy("asset").agg(F.min("session").alias("first"))
    missing = panel.filter(F.col(column).isNull()).join(first, "asset").filter("session > first")
    counted = carry.running(missing, ("asset",), "session", block(), nth=carry.total(F.lit(1)))
    island = counted.withColumn("island", F.col("session") - F.col("nth"))
    return island.groupBy("asset", "island").agg(F.min("date").alias("gap_start"), F.max("date").alias("gap_end"), F.count(F.lit(1)).alias("sessions")).drop("island")


def longest_gap(panel: DataFrame, column: str = "price_raw") -> DataFrame:
    """asset, longest: sessions of the longest run of missing values, 0 if there is none."""
    runs = gap_islands(panel, column).groupBy("asset").agg(F.max("sessions").alias("longest"))
    return panel.select("asset").distinct().join(runs, "asset", "left").select("asset", F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def first_complete(panel: DataFrame) -> DataFrame:
    """first_date: the first date on which every asset has a price."""
    full = panel.groupBy("date").agg(F.count_if(F.col("price").isNull()).alias("missing")).filter("missing = 0")
    return full.agg(F.min("date").alias("first_date"))


def log_returns(panel: DataFrame) -> DataFrame:
    """The panel, a row for every session of its assets, with r, the log return: a missing price leaves two returns missing."""
    return carry.with_before(panel, ("asset",), "session", BLOCK, before=F.col("price")).withColumn("r", F.ln("price") - F.ln("before")).drop("before")


def availability(obs: DataFrame, panel: DataFrame, min_years: float) -> DataFrame:
    """First observation, years and observations a year of each asset's history, median value traded in the panel."""
    last = panel.agg(F.max("date").alias("asof"), F.min("date").alias("opened"))
    value = F.col("price") * F.col("volume")
    per = obs.crossJoin(F.broadcast(last)).filter("price is not null").groupBy("asset", "asof").agg(  # one row
        F.min("date").alias("first_obs"), F.count(F.lit(1)).alias("n_obs"),
        F.median(F.when((value > 0) & (F.col("date") >= F.col("opened")), value)).alias("median_value"),
    )
    years = F.datediff("asof", "first_obs") / 365.25
    return per.select("asset", "first_obs", years.alias("years"), F.try_divide(F.col("n_obs").cast("double"), years).alias("obs_per_year"), (F.col("median_value") / 1e6).alias("median_value_m"), (years >= min_years).alias("long_enough"))


def quality(obs: DataFrame, cal: DataFrame, panel: DataFrame, move: float = EXTREME_MOVE) -> DataFrame:
    """Missing, filled and dropped observations, stale share and extreme days of each asset, and what was done."""
    first = F.min(F.when(F.col("price_raw").isNotNull(), F.col("session"))).over(Window.partitionBy("asset"))
    seen = log_returns(panel).withColumn("first", first).filter("session >= first")
    counts = seen.groupBy("asset").agg(
        F.min("date").alias("panel_start"),
        F.count("price").alias("n_obs"),
        F.count_if(F.col("price_raw").isNull()).alias("missing"),
        F.count_if(F.col("price_raw").isNull() & F.col("price").isNotNull()).alias("filled"),
        (100 * F.try_divide(F.count_if(F.abs("r") < STALE).cast("double"), F.count("r").cast("double"))).alias("stale_pct"),
        F.count_if(F.abs("r") > move).alias("extreme_days"),
    )
    joined = counts.join(longest_gap(panel), "asset", "left").join(off_calendar(obs, cal), "asset", "left").na.fill(0, ["dropped"])
    left = F.col("missing") - F.col("filled")
    done = F.concat_ws(
        "; ",
        F.when(F.col("dropped") > 0, F.concat(F.format_number("dropped", 0), F.lit(" off-calendar obs. dropped"))),
        F.when(F.col("filled") > 0, F.concat(F.col("filled").cast("string"), F.lit(" session(s) forward-filled"))),
        F.when(left > 0, F.concat(left.cast("string"), F.lit(" left as NaN"))),
    )
    return joined.withColumn("treatment", F.when(done == "", F.lit("None required")).otherwise(done))


def extreme_moves(panel: DataFrame, move: float = EXTREME_MOVE) -> DataFrame:
    """date, asset, r_pct and how many assets moved as far on that date."""
    far = log_returns(panel).filter(F.abs("r") > move)
    return far.select("date", "asset", (F.col("r") * 100).alias("r_pct"), F.count(F.lit(1)).over(Window.partitionBy("date")).alias("same_day"))


def explained(moves: DataFrame, notes: DataFrame, default: str = "No note") -> DataFrame:
    """Moves with the note for their date and asset, or a default."""
    return moves.join(notes, ["date", "asset"], "left").withColumn("note", F.coalesce("note", F.lit(default)))


def moves_by(moves: DataFrame, how: str) -> DataFrame:
    """Counts of moves by year or by asset, with the dates that several assets share."""
    key = F.year("date").alias("year") if how == "year" else F.col("asset")
    return moves.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("date").alias("dates"), F.count_if(F.col("same_day") > 1).alias("shared"))


def interpolate(panel: DataFrame) -> DataFrame:
    """price with interior gaps bridged linearly by row position; nothing outside the first and last value."""
    before = F.last(F.when(F.col("price_raw").isNotNull(), F.struct("session", "price_raw")), ignorenulls=True).over(_so_far())
    after = F.first(F.when(F.col("price_raw").isNotNull(), F.struct("session", "price_raw")), ignorenulls=True).over(_by_asset().rowsBetween(Window.currentRow, Window.unboundedFollowing))
    held = panel.withColumn("b", before).withColumn("a", after)
    share = F.try_divide((F.col("session") - F.col("b.session")).cast("double"), (F.col("a.session") - F.col("b.session")).cast("double"))
    blend = F.col("b.price_raw") + (F.col("a.price_raw") - F.col("b.price_raw")) * share
    return held.withColumn("price", F.coalesce("price_raw", blend)).drop("a", "b")


def buy_and_hold(panel: DataFrame, benchmark: str) -> DataFrame:
    """Growth, yearly growth and volatility of each asset from the first date that all have, and whether it beat the benchmark."""
    complete = panel.withColumn("gap", F.count_if(F.col("price").isNull()).over(Window.partitionBy("date"))).filter("gap = 0")
    r = carry.running(complete, ("asset",), "session", block(), before=carry.previous(F.col("price"))).withColumn("r", F.ln("price") - F.ln("before"))
    own = r.groupBy("asset").agg(
        (F.max_by("price", "session") / F.min_by("price", "session")).alias("growth"),
        (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
        F.stddev_samp("r").alias("sd"),
    )
    base = own.filter(F.col("asset") == benchmark).select(F.col("growth").alias("base"))
    return own.crossJoin(F.broadcast(base)).select("asset", "growth", (F.pow("growth", F.try_divide(F.lit(1.0), F.col("years"))) - 1).alias("cagr"), (F.col("sd") * F.sqrt(F.lit(52.0))).alias("vol"), (F.col("growth") > F.col("base")).alias("beats"))  # one row


def data_checks(obs: DataFrame) -> DataFrame:
    """Rows, missing, non-positive and non-finite prices of each asset."""
    bad = F.isnan("price") | (F.abs("price") == float("inf"))
    return obs.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price").isNull()).alias("missing"), F.count_if(F.col("price") <= 0).alias("not_positive"), F.count_if(bad).alias("not_finite"))


def complete_rows(returns: DataFrame, value: str = "r") -> DataFrame:
    """Rows of the dates on which no asset's value is missing; taken after returns, so a gap costs two dates."""
    gap = F.count_if(F.col(value).isNull()).over(Window.partitionBy("date"))
    return returns.withColumn("gap", gap).filter("gap = 0").drop("gap")


def _later_factors(prices: DataFrame, log_factor: Column) -> DataFrame:
    """prices with later: the sum of the log factors of all later rows of the asset, by blocks from the last one back."""
    back = prices.withColumn("back", -F.col("session")).withColumn("own", log_factor)
    summed = carry.running(back, ("asset",), "back", -block(), upto=carry.total(F.col("own")))
    return summed.withColumn("later", F.col("upto") - F.col("own")).drop("back", "own", "upto")


def _with_actions(prices: DataFrame, actions: DataFrame, *columns: str) -> DataFrame:
    there = prices.filter("price is not null").select("session", "date", "asset", "price")
    return there.join(actions.select("date", "asset", *columns), ["date", "asset"], "left").na.fill(0.0, list(columns))


def unadjusted(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """session, date, asset, price (as it was traded), dividend (an amount) and split of an adjusted series.

    actions: date, asset, income (share of the price before) and split (shares from one, 0 for none). Prices before an
    action were lowered by 1 / split and 1 - income; here that is undone. An asset's first price has none before, so an
    action on it does nothing; actions on dates without a price are left out.
    """
    joined = _with_actions(prices, actions, "income", "split")
    known = carry.running(joined, ("asset",), "session", block(), before=carry.previous(F.col("price")))
    acts = F.col("before").isNotNull()
    joined = known.withColumns({"income": F.when(acts, F.col("income")).otherwise(0.0), "split": F.when(acts, F.col("split")).otherwise(0.0)}).drop("before")
    ratio = F.when(F.col("split") > 0, F.col("split")).otherwise(1.0)
    traded = _later_factors(joined, F.log1p(-F.col("income")) - F.log(ratio)).withColumn("price", F.col("price") * F.exp(-F.col("later"))).drop("later")
    before = carry.running(traded, ("asset",), "session", block(), before=carry.previous(F.col("price")))
    return before.select("session", "date", "asset", "price", F.coalesce(F.col("income") * F.col("before"), F.lit(0.0)).alias("dividend"), "split")


def adjusted(traded: DataFrame) -> DataFrame:
    """session, date, asset, price: traded prices (session, date, asset, price, dividend, split) made comparable.

    Each price is lowered by the later splits, and by the later dividends as shares of the price before each.
    """
    known = carry.running(traded, ("asset",), "session", block(), before=carry.previous(F.col("price")))
    share = F.coalesce(F.try_divide(F.col("dividend"), F.col("before")), F.lit(0.0))
    ratio = F.when(F.col("split") > 0, F.col("split")).otherwise(1.0)
    later = _later_factors(known.withColumn("share", share), F.log1p(-F.col("share")) - F.log(ratio))
    return later.select("session", "date", "asset", (F.col("price") * F.exp("later")).alias("price"))


def adjustment_table(adjusted: DataFrame, unadjusted: DataFrame, actions: DataFrame) -> DataFrame:
    """Yearly growth of both price series over their common dates, the difference, and events after the first date.

    adjusted, unadjusted: date, asset, price (unadjusted ones already filled); actions: date, asset, dividend, split.
    """
    both = adjusted.select("date", "asset", F.col("price").alias("adj")).join(unadjusted.select("date", "asset", F.col("price").alias("raw")), ["date", "asset"]).filter("adj is not null and raw is not null")
    span = both.groupBy("asset").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min_by("adj", "date").alias("a0"), F.max_by("adj", "date").alias("a1"), F.min_by("raw", "date").alias("r0"), F.max_by("raw", "date").alias("r1"))
    events = actions.join(span.select("asset", "first", "last"), "asset").filter("date > first and date <= last").groupBy("asset").agg(F.count_if(F.coalesce("dividend", F.lit(0.0)) != 0).alias("dividends"), F.count_if(F.coalesce("split", F.lit(0.0)) != 0).alias("splits"))
    power = F.try_divide(F.lit(1.0), F.datediff("last", "first") / 365.25)
    grown = span.withColumn("adj_cagr", F.pow(F.col("a1") / F.col("a0"), power) - 1).withColumn("raw_cagr", F.pow(F.col("r1") / F.col("r0"), power) - 1)
    return grown.join(events, "asset", "left").select("asset", "first", "last", "adj_cagr", "raw_cagr", (F.col("adj_cagr") - F.col("raw_cagr")).alias("gap"), F.coalesce("dividends", F.lit(0).cast("long")).alias("dividends"), F.coalesce("splits", F.lit(0).cast("long")).alias("splits"))


def classify_actions(actions: DataFrame, returns: DataFrame) -> DataFrame:
    """Each split-like event as split (whole ratio, either way) or spin-off, with the log return of its day."""
    whole = lambda c: F.abs(c - F.round(c)) < 1e-6
    ratio = F.greatest(F.col("split"), F.try_divide(F.lit(1.0), F.col("split")))
    kind = F.when(whole(ratio), "split").otherwise("spin-off")
    return actions.filter("split is not null and split <> 0").select("date", "asset", "split", kind.alias("kind")).join(returns.select("date", "asset", "r"), ["date", "asset"], "left")


def with_value(table: DataFrame, column: str) -> DataFrame:
    """The rows that have a value in the column, such as the assets with a proxy."""
    return table.filter(F.col(column).isNotNull())
