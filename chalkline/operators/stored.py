"""Stored snapshots: a table with a unique key in buckets of its key's hash, of which an upsert rewrites the touched ones.

Folder: ``data/<write>/bucket=<n>`` holds the files of a write, ``versions`` one small file a version, with a row a bucket
that names the write which made it.  That file is moved into place when its job commits, after all data is there, so
readers see the version before or the whole next one, and what a failed write leaves is named by no version.  Files are
never changed.  One writer at a time; a second that publishes the same version is found and refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from chalkline.operators.snapshots import Merge, upsert

MOST_BUCKETS = 65_536  # the driver holds one short row a bucket
LISTED = "version long, write string, bucket int, made_by string, buckets int, keys array<string>, schema string"


def _versions(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.schema(LISTED).parquet(f"{folder}/versions")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _listing(spark: SparkSession, folder: str, version: int | None = None) -> list:
    """Rows of a version, or of the newest; its row without a bucket comes first and is there even in an empty table."""
    versions = _versions(spark, folder)
    if versions is None:
        raise FileNotFoundError(f"no snapshot in {folder}")
    wanted = version if version is not None else versions.agg(F.max("version")).first()[0]
    rows = versions.where(F.col("version") == wanted).collect()
    if not rows:
        raise LookupError(f"no version {wanted} in {folder}")
    return sorted(rows, key=lambda r: -1 if r.bucket is None else r.bucket)


def _bucket(table: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[table[k] for k in keys]), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, folder: str, rows: Sequence, schema: StructType) -> DataFrame:
    paths = [f"{folder}/data/{r.made_by}/bucket={r.bucket}" for r in rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(table: DataFrame, folder: str, write: str, keys: Sequence[str], buckets: int) -> list[int]:
    """Writes the rows by bucket and returns the buckets that have any."""
    path = f"{folder}/data/{write}"
    table.withColumn("bucket", _bucket(table, keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    written = table.sparkSession.read.schema(StructType([*table.schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    return [r.bucket for r in written.select("bucket").distinct().collect()]


def _announce(spark: SparkSession, folder: str, version: int, write: str, made_by: Mapping[int, str], keys: Sequence[str], buckets: int, schema: StructType) -> int:
    common = (buckets, list(keys), schema.json())
    rows = [(version, write, None, None, *common), *((version, write, b, w, *common) for b, w in sorted(made_by.items()))]
    spark.createDataFrame(rows, LISTED).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    if len({r.write for r in _listing(spark, folder, version)}) > 1:
        raise RuntimeError(f"version {version} of {folder} was written twice")
    return version


def create(table: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> int:
    """Stores table (unique by ``keys``) as version 1 of a snapshot in a new folder; returns 1.

    About 128 MB a bucket is a good number of them; they stay as they are.  Columns named ``bucket`` are refused.
    """
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    if "bucket" in (c.lower() for c in table.columns):
        raise ValueError("a stored table has no column of its own named bucket")
    if _versions(table.sparkSession, folder) is not None:
        raise FileExistsError(f"there is a snapshot in {folder}")
    write = uuid4().hex
    filled = _write(table, folder, write, keys, buckets)
    return _announce(table.sparkSession, folder, 1, write, dict.fromkeys(filled, write), keys, buckets, table.schema)


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest version, or a named one."""
    head, *rows = _listing(spark, folder, version)
    return _files(spark, folder, rows, StructType.fromJson(json.loads(head.schema)))


def upsert_stored(batch: DataFrame, folder: str, merge: Mapping[str, Merge]) -> int:
    """Upserts ``batch`` (unique by the keys, columns of the table; others are left out) and returns the next version.

    Reads and writes the buckets that keys of the batch fall into; the other ones are taken over by name.  An empty batch
    makes a version equal to the one before.
    """
    spark = batch.sparkSession
    head, *rows = _listing(spark, folder)
    keys, buckets, schema = head["keys"], head.buckets, StructType.fromJson(json.loads(head.schema))
    typed = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])  # keys hash alike only in the table's types
    touched = {r[0] for r in typed.select(_bucket(typed, keys, buckets)).distinct().collect()}
    old = _files(spark, folder, [r for r in rows if r.bucket in touched], schema)
    write = uuid4().hex
    filled = _write(upsert(old, typed, keys, merge), folder, write, keys, buckets) if touched else []
    kept = {r.bucket: r.made_by for r in rows if r.bucket not in touched}
    return _announce(spark, folder, head.version + 1, write, kept | dict.fromkeys(filled, write), keys, buckets, schema)
