"""Sets of tables written together and read back: workbooks (a CSV folder a sheet) and snapshots (Parquet).

A version of a set is a folder named by its time stamp. Tables are written first and the manifest, with names, schemas,
row counts and the time, last; readers go by manifests, so a version whose writing broke off is never seen, and the
one before stays whole. Sheets are named as spreadsheets allow: 31 characters, none of a few; names that are alike
after cutting get a number, so none is written over another.

Edge cases: a set without tables has an empty manifest; empty tables keep their columns; an unknown set, version or
table raises LookupError; nulls and empty strings stay apart in both formats (in CSV a
text that is NULL_MARK alone reads as null).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a spreadsheet's sheet names can't hold, and how long they may be.
BARRED, LONGEST = r"[\[\]:*?/\\]", 31
MANIFEST = "_manifest"
FORMATS = ("csv", "parquet")
#: Text by which CSV tells null from the empty string.
NULL_MARK = "\\N"
_ROWS = "name string, sheet string, kind string, rows long, columns string, written_at timestamp, version string"


def sheet_names(names: list[str]) -> list[str]:
    """A sheet name for each of the names, in their order: barred characters become _, long ones are cut, and of equal
    ones (without regard to case) all but the first end in ~2, ~3, ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        plain = re.sub(BARRED, "_", name).strip("'")[:LONGEST] or "_"
        found, k = plain, 1
        while found.lower() in taken:
            k += 1
            mark = f"~{k}"
            found = plain[: LONGEST - len(mark)] + mark
        taken.add(found.lower())
        out.append(found)
    return out


def _folder(sheet: str) -> str:
    """A sheet's folder: its name with what a path or Spark's own files could mean something in spelled out."""
    return "t-" + re.sub(r"[^A-Za-z0-9 ~-]", lambda m: f"_{ord(m[0]):x}_", sheet).replace(" ", "_20_")


def save(tables: dict[str, DataFrame], folder: str, spark: SparkSession, kind: str = "csv", now: dt.datetime | None = None) -> str:
    """Write the tables as a new version of the set in folder; gives the version."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    at = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    version = f"{at:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    rows = []
    for (name, df), sheet in zip(tables.items(), sheet_names(list(tables))):
        path = f"{folder}/{version}/{_folder(sheet)}"
        if kind == "csv":
            df.write.option("header", True).option("nullValue", NULL_MARK).option("escape", '"').csv(path)
        else:
            df.write.parquet(path)
        rows.append((name, sheet, kind, _table(spark, path, kind, df.schema).count(), df.schema.json(), at, version))
    spark.createDataFrame(rows, _ROWS).coalesce(1).write.parquet(f"{folder}/{version}/{MANIFEST}")
    return version


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, sheet, kind, rows, columns, written_at and version of every table of every whole version in folder."""
    try:
        return spark.read.schema(_ROWS).parquet(f"{folder}/*/{MANIFEST}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise LookupError(f"no whole version in {folder}") from e
        raise


def load(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A table of a version of the set, the latest by default, with the types and the rows that were written."""
    found = manifest(spark, folder)
    version = version or found.agg(F.max_by("version", F.struct("written_at", "version"))).first()[0]
    row = found.filter((F.col("version") == version) & (F.col("name") == name)).first()
    if row is None:
        raise LookupError(f"no table {name!r} in version {version} of {folder}")
    return _table(spark, f"{folder}/{version}/{_folder(row['sheet'])}", row["kind"], StructType.fromJson(json.loads(row["columns"])))


def _table(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    if kind == "csv":
        return spark.read.schema(schema).option("header", True).option("nullValue", NULL_MARK).option("escape", '"').option("multiLine", True).csv(path)
    return spark.read.schema(schema).parquet(path)
