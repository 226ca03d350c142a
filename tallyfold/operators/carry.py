"""Running measures over long series in two levels, so that a series isn't one task's work.

A series is cut into blocks, such as the years of its dates. Each block runs a window of its own; what it ends with is
aggregated to one row, its end state; a window over these few states gives what each block starts from; and a join
brings that to the block's rows. Tasks grow with series x blocks, and only end states, one row a block, meet by series.

Rows of a series need distinct values of the order column, and blocks must follow the order. Null keys or blocks get no
rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

_BLOCK = "_block"


@dataclass(frozen=True)
class Measure:
    """inner(rows, order): within the block; end(order): the block's end state; start(state, before): over the states of
    earlier blocks; joined(inner, start): the measure of the whole series so far."""

    inner: Callable[[WindowSpec, WindowSpec], Column]
    end: Callable[[Column], Column]
    start: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def total(value: Column) -> Measure:
    """Sum up to the row; null until there is a value."""
    both = lambda i, s: F.when(i.isNotNull() | s.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(s, F.lit(0)))
    return Measure(lambda rows, _: F.sum(value).over(rows), lambda _: F.sum(value), lambda state, before: F.sum(state).over(before), both)


def highest(value: Column) -> Measure:
    return Measure(lambda rows, _: F.max(value).over(rows), lambda _: F.max(value), lambda state, before: F.max(state).over(before), F.greatest)


def last_seen(value: Column) -> Measure:
    """The last value up to the row that isn't null."""
    return Measure(
        lambda rows, _: F.last(value, ignorenulls=True).over(rows),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda state, before: F.last(state, ignorenulls=True).over(before),
        F.coalesce,
    )


def previous(value: Column) -> Measure:
    """The value of the row before, null if that is null or the row is the first."""
    held = F.struct(value.alias("value"))
    return Measure(
        lambda _, ordered: F.lag(held).over(ordered),
        lambda order: F.max_by(held, order),
        lambda state, before: F.last(state).over(before),
        lambda inner, start: F.coalesce(inner, start)["value"],
    )


def _levels(keys: tuple[str, ...], order: str) -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    ordered = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), ordered, before


def running(df: DataFrame, keys: tuple[str, ...], order: str, block: Column, **measures: Measure) -> DataFrame:
    """df with a column for each of the measures, taken along order within keys."""
    rows, ordered, before = _levels(keys, order)
    cut = df.withColumn(_BLOCK, block)
    ends = cut.groupBy(*keys, _BLOCK).agg(*(m.end(F.col(order)).alias(f"_end_{c}") for c, m in measures.items()))
    starts = ends.select(*keys, _BLOCK, *(m.start(F.col(f"_end_{c}"), before).alias(f"_start_{c}") for c, m in measures.items()))
    inner = cut.withColumns({f"_inner_{c}": m.inner(rows, ordered) for c, m in measures.items()})
    found = {c: m.joined(F.col(f"_inner_{c}"), F.col(f"_start_{c}")).alias(c) for c, m in measures.items()}
    return inner.join(starts, [*keys, _BLOCK]).select(*(c for c in df.columns if c not in found), *found.values())


def paths(df: DataFrame, keys: tuple[str, ...], order: str, block: Column, growth: Column) -> DataFrame:
    """df with grown, the sum of growth up to the row, and peak, the highest grown so far.

    A block ends with its own sum and the highest of its own sums; its start is the sum of those before it, and the
    highest of their starts and own highest together.
    """
    rows, _, before = _levels(keys, order)
    local = df.withColumn(_BLOCK, block).withColumn("_grown", F.sum(growth).over(rows))
    ends = local.groupBy(*keys, _BLOCK).agg(F.max_by("_grown", F.when(F.col("_grown").isNotNull(), F.col(order))).alias("_sum"), F.max("_grown").alias("_top"))
    zero = F.lit(0.0)
    based = ends.withColumn("_base", F.sum("_sum").over(before))
    starts = based.select(*keys, _BLOCK, "_base", F.max(F.coalesce("_base", zero) + F.col("_top")).over(before).alias("_high"))
    joined = local.withColumn("_peak", F.max("_grown").over(rows)).join(starts, [*keys, _BLOCK])
    known = F.col("_base").isNotNull() | F.col("_grown").isNotNull()
    grown = F.when(known, F.coalesce("_base", zero) + F.coalesce("_grown", zero))
    return joined.select(*df.columns, grown.alias("grown"), F.greatest(F.coalesce("_base", zero) + F.col("_peak"), "_high").alias("peak"))


def with_before(df: DataFrame, keys: tuple[str, ...], order: str, rows: int, **values: Column) -> DataFrame:
    """df with values of the row before, where order counts the rows of a key without gaps.

    Blocks of so many rows; a block's last row is handed to the next block too, so nothing has to be joined.
    """
    at = F.floor(F.col(order) / rows)
    spread = df.withColumn(_BLOCK, F.explode(F.when(F.col(order) % rows == rows - 1, F.array(at, at + 1)).otherwise(F.array(at))))
    by = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    return spread.withColumns({c: F.lag(v).over(by) for c, v in values.items()}).filter(F.col(_BLOCK) == at).drop(_BLOCK)
