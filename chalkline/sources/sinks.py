"""Sinks: nested JSON, flat CSV, append-only audit tables, run manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ROWS = 1000  # so many rows are nested in one at most, as far as hashes deal them evenly


def nested(df: DataFrame, keys: Sequence[str], name: str, rows: int = ROWS) -> DataFrame:
    """keys, part, and the rows of a key as a sorted array of structs: a key with more than ``rows`` has several parts."""
    rest = [c for c in df.columns if c not in keys]
    parts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    dealt = df.join(parts, reduce(and_, same)).select(*df.columns, F.pmod(F.xxhash64(*rest), F.col("_parts")).cast("int").alias("part"))
    return dealt.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))


def write_json(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines, in a folder for each value of ``by``; non-finite numbers become null first."""
    finite = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(finite).write.mode("overwrite").partitionBy(*by).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema]
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)


def append_audit(df: DataFrame, path: str, run_date: str | Column) -> None:
    """Rows added to an audit table under the date of their run, one for all or a column."""
    df.withColumn("run_date", (F.lit(run_date) if isinstance(run_date, str) else run_date).cast("date")).write.mode("append").partitionBy("run_date").parquet(path)


def run_manifest(stages: Mapping[str, DataFrame]) -> DataFrame:
    """stage, status and n_rows of each stage's table."""
    rows = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), F.when(F.col("n_rows") > 0, "ok").otherwise("empty").alias("status"), "n_rows") for name, df in stages.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
