"""What the training-data operators share: reading, cutting lineage, word patterns."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009..U+000D.
SPACE_CHARS = " \t\n\x0b\f\r"
#: A word: a run of anything else (Java, RE2 and Python read it alike).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bits of a sieve: 4 MB, whatever the number of keys.
SIEVE_BITS = 1 << 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only on one machine (master local), where it is unset, a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyfold-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SIEVE_BITS)) + 1


def sieve(keys: DataFrame, *cols: str) -> DataFrame:
    """A bitmap over the hashed keys, as rows (bucket, bits) of 4 KB, SIEVE_BITS in all."""
    slot = keys.select(_slot(*cols).alias("slot"))
    return slot.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def sifted(df: DataFrame, by: DataFrame, cols: tuple[str, ...], flag: str) -> DataFrame:
    """df with flag: whether the sieve may have the row's key. The broadcast holds SIEVE_BITS / 8 bytes at most."""
    slot = _slot(*cols)
    place = F.bitmap_bit_position(slot)
    octet = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(by), "bucket", "left")
    return joined.withColumn(flag, F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")
