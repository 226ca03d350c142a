"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of surviving groups.

Built-in functions only. What survives a level is kept as a sieve: a bitmap of fixed size (SIEVE_BITS bits, 4 MB)
over the hashed group keys, so the next level can skip texts that are certainly unique without moving any text
through a shuffle. A wrong hit in the bitmap only costs one needless hash; it can't change a result, so a corpus with
more keys than bits has more texts hashed, no more. Rows that no other can equal are never shuffled.

Edge cases: null texts count as empty and equal each other; of equal texts the row with the largest id stays; rows
that repeat an id and its text are one document and are marked alike, each counting in group_size; null ids rank
below all others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sieve, sifted, whole_text

PREFIX_CHARS = 64


def _repeated(keys: DataFrame, *cols: str) -> DataFrame:
    """A sieve of the keys that more than one row has."""
    return sieve(keys.groupBy(*cols).count().filter("count > 1"), *cols)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t (the text) and shared: whether another row has its length and prefix, as far as the sieves tell."""
    text = whole_text(F.col(text_col))
    sized = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.octet_length(text).alias("len"))
    by_length = _repeated(sized.select("len"), "len")
    prefixed = sifted(sized, by_length, ("len",), "again").withColumn("prefix", F.when(F.col("again"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS))))
    by_prefix = _repeated(prefixed.filter("again").select("len", "prefix"), "len", "prefix")
    return sifted(prefixed, by_prefix, ("len", "prefix"), "met").select("doc_id", "t", (F.col("again") & F.col("met")).alias("shared"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    Groups are formed among the survivors of both sieves only; every other row is alone. With digest_all those get
    their text_sha256 as well, which decides nothing; without it theirs is null.
    """
    found = survivors(docs, id_col, text_col)
    hashed = found.filter("shared").select("doc_id", F.sha2("t", 256).alias("text_sha256"))
    groups = cut(hashed.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    # the groups come from a written table, so AQE can split the rows of a hot one
    joined = hashed.join(groups, "text_sha256", "left")
    single = F.col("group_size").isNull()
    together = joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    digest = F.sha2("t", 256) if digest_all else F.lit(None).cast("string")
    alone = found.filter("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest.alias("text_sha256"))
    return together.unionByName(alone)
