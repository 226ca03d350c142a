"""A corpus pipeline of five stages: language ID, exact dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents, but for the last, which returns the encoded documents. run() writes what a stage returns as Parquet in the
folder that the session names in spark.checkpoint.dir and reads it again for the next.

Decisions between documents are taken and applied by row, not by id: such a stage first writes its input once with a
number for each row.

Edge cases are those of the operators; rows without an id, and rows that repeat an id, are documents of their own in
every stage: of each group of copies exactly one row stays, and each row is mixed by itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import exact_dedup, language_id, mixing, near_dedup, piece_codec
from tallyfold.llm.common import cut, shared_folder, sieve, sifted
from tallyfold.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold; rejected documents go, lang is what was found."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.classify(docs, model, COLUMNS)
    return found.filter("not rejected").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with row, a number of its own for each row, written once so that every reading has the same ones."""
    path = scratch(spark, "rows")
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest id stays."""
    rows = numbered(spark, docs)
    keyed = rows.select(F.struct("doc_id", "row").alias("place"), "text")
    kept = exact_dedup.exact_dedup(keyed, "place").filter("kept").select("doc_id.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at a similarity of 0.8 or more on five-word shingles one row stays.

    It is the one with the smallest id, one without an id if the group has no other.
    """
    rows = numbered(spark, docs)
    groups = near_dedup.near_groups(rows).withColumnRenamed("node", "row")
    members = sifted(rows.select("row", "doc_id"), sieve(groups, "row"), ("row",), "member").filter("member").select("row", "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    found = members.join(groups, "row").select("root", "row", place.alias("place"))
    stays = found.groupBy("root").agg(F.min("place").alias("stays"))
    gone = cut(found.join(stays, "root").filter(F.col("row") != F.col("stays.row")).select("row"))
    flagged = sifted(rows, sieve(gone, "row"), ("row",), "suspect")
    checked = flagged.filter("suspect").join(gone, "row", "left_anti")
    return flagged.filter("not suspect").select(*COLUMNS).unionByName(checked.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = numbered(spark, docs)
    copies = mixing.mix_sources(rows, keep=("row",)).filter("copies > 0").select("row", "copies")
    joined = rows.join(copies, "row")
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return piece_codec.piece_digests(docs, piece_model())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mix_sources", mix),
    ("piece_codec", encode),
]

#: Language ID and SimHash components can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
