"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60
#: Edges that a task takes from what a round leaves, about.
TASK_EDGES = 16_384


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v) of each pair of columns; unlike a union, in the partitions of df."""
    both = F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs)))
    return df.select(both.alias("e")).select("e.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b) that isn't its component's root; root is the smallest node.

    Self-loops and nulls are ignored; repeated edges count once; no edges give no rows. Each round is two joins on
    node keys, each with pre-aggregated minima; what a round leaves is written to the checkpoint folder and read by as
    many tasks as it needs, so that a round over few edges needs no shuffle, whatever the number of partitions set.
    """
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(MAX_ROUNDS + 1):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        tasks = now[0] // TASK_EDGES + 1
        e = e.coalesce(tasks)
        # one partition needs no exchange, but a join takes one unless a side is sent: twice TASK_EDGES rows at most
        sent = F.broadcast if tasks == 1 else lambda df: df
        both = _each(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(sent(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(_each(large.join(sent(low), "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
