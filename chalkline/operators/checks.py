"""Cross-cutting checks: every check is a small table of rule names with violation counts or verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(one: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)])).alias("x")).select("x.*")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n: rows for which a rule does not hold (null counts as broken); one pass."""
    counted = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(rules.values())])
    return _rows(counted, list(rules), "rule", "n")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cardinality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether a join on key is one to one, many to one, and how many left rows have no partner."""
    r = right.groupBy(key).agg(F.count("*").alias("_n"))
    joined = left.groupBy(key).agg(F.count("*").alias("_l")).join(r, key, "left")
    return joined.agg((F.max("_l") <= 1).alias("left_unique"), (F.coalesce(F.max("_n"), F.lit(0)) <= 1).alias("right_unique"), F.sum(F.when(F.col("_n").isNull(), F.col("_l")).otherwise(0)).alias("unmatched"))


def manifest(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """check, passed: named aggregate conditions over a manifest, in one aggregation."""
    return _rows(df.agg(*[F.coalesce(c, F.lit(False)).alias(f"_{i}") for i, c in enumerate(checks.values())]), list(checks), "check_name", "passed")
