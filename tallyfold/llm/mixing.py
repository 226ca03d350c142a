"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) divided by its quality weight, with u from a hash of the seed and its
id. A source whose target is n whole epochs and a rest is taken n times in full; for the rest its documents, sorted by
key, are taken until their prefix sum of words meets the budget (the one on the edge if that brings the sum nearer).
The edge is found without sorting a source: sums over 1,024 ranges of the key locate the range with the edge, sums over
1,024 parts of that range the part, and so on for LEVELS levels; what is left is about a millionth of a source, and
only that is sorted, equal rows counted as one. Each window has 1,024 rows at most, or that rest.

Edge cases: null texts have size 0; a null source is a source of its own, ranked last; a source without words has
target 0; equal keys are ordered by id and size, and rows that repeat an id draw the same key and are counted row by
row; other columns are ignored; an empty table gives an empty result; a null id draws the key of the text "null".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, whole_text

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Keys are below 512; a level cuts a range of them in 1,024.
LEVELS = 3
LEVEL_BITS = 10
NOISE_CHARS = "0123456789#*$%&|<>{}[]\\^~=+_@"


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of characters other than digits and symbols."""
    n = F.length(text)
    clean = F.length(F.regexp_replace(text, r"[0-9#*$%&|<>{}\[\]\\^~=+_@]+", ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(clean.cast("double"), n.cast("double")), F.lit(0.1)))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of totals(source, source_size): share of all sizes dealt by weight, the excess over a cap dealt again.

    Dealing again until none is above its cap ends at min(cap, level * weight) with one level for all; sorted by
    cap / weight, the level is the first for which a source stays below its cap. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    full = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - full) / rest)
    open_level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return leveled.withColumn("open", open_level).select("source", "source_size", F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open")), F.col("cap")).otherwise(F.col("open") * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = SOURCE_WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 42,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) and the columns to keep of every row of docs.

    Columns to keep order rows of equal key, id and size.
    """
    text = whole_text(F.col(text_col))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    u = (draw + 0.5) / float(1 << 52)
    keyed = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), (-F.log(u) / quality_weight(text)).alias("key"), *keep))
    totals = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, max_epochs)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    budgets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    cell = F.floor(F.col("key") * float(1 << LEVEL_BITS * (LEVELS - 1) + 1)).cast("long")
    celled = keyed.withColumn("cell", cell)
    plan = budgets.withColumn("edge", F.lit(None).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for level in range(LEVELS):
        at = F.shiftright("cell", LEVEL_BITS * (LEVELS - 1 - level))
        above = F.shiftright("cell", LEVEL_BITS * (LEVELS - level))
        base = celled.withColumn("r_source", F.col("source")).drop("source").join(
            plan.select("source", "edge", F.col("before").alias("base"), "budget"),
            F.col("r_source").eqNullSafe(F.col("source")) & (F.lit(True) if level == 0 else above == F.col("edge")),
        )
        sums = base.groupBy("source", at.alias("part")).agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("budget").alias("budget"))
        up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("start", F.col("base") + F.sum("words").over(up_to) - F.col("words"))
        edge = sums.filter("start < budget and budget <= start + words").select(F.col("source").alias("e_source"), F.col("part").alias("edge"), F.col("start").alias("before"))
        plan = cut(plan.drop("edge", "before").join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source"))

    rows = celled.withColumnRenamed("source", "r_source").join(plan, F.col("r_source").eqNullSafe(F.col("source"))).drop("r_source")
    same = ("source", "key", "doc_id", "size", *keep)
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # equal rows stand next to each other; the first few of them that still fit are taken
    equal = rows.filter("cell = edge").groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("source_size", "target", "epochs", "budget", "before")))
    words = F.col("n") * F.col("size")
    room = F.col("budget") - (F.col("before") + F.sum(words).over(inside) - words)
    fit = F.when(F.col("size") == 0, F.when(room >= 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.greatest(F.lit(0), F.floor(F.try_divide(room, F.col("size").cast("double")) + 0.5))))
    on_edge = equal.withColumn("fit", fit.cast("long")).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("more", (F.col("nth") <= F.col("fit")).cast("long"))
    off_edge = rows.filter("edge is null or cell <> edge").withColumn("more", F.coalesce((F.col("cell") < F.col("edge")).cast("long"), F.lit(0).cast("long")))
    out = off_edge.unionByName(on_edge, allowMissingColumns=True).withColumn("copies", F.col("epochs") + F.col("more"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *keep)
