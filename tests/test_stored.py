"""Stored snapshots: whole versions, untouched files, failed writes, odd keys and empty tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from chalkline.operators import snapshots, stored

SCHEMA = "id long, name string, n int"
MERGE = {"n": snapshots.add}


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/data/**/*.parquet", recursive=True)}


def rows(table):
    return sorted(((r.id, r.name, r.n) for r in table.collect()), key=str)


def test_upserts_equal_unstored_ones_and_leave_other_buckets_alone(spark, tmp_path):
    folder = f"{tmp_path}/t"
    base = spark.range(500).select("id", F.concat(F.lit("k"), F.col("id")).alias("name"), F.lit(1).alias("n"))
    first = base.unionByName(spark.createDataFrame([(None, "no id", 7)], SCHEMA))
    assert stored.create(first, folder, ["id"], buckets=16) == 1
    before = files(folder)
    batch = spark.createDataFrame([(3, "new", 5), (None, "still none", 1), (900, "more", 2)], "id int, name string, n int")  # keys in another type
    assert stored.upsert_stored(batch, folder, MERGE) == 2
    after = files(folder)
    assert {p: after[p] for p in before} == before  # nothing written is ever changed
    touched = {p.split("bucket=")[1].split("/")[0] for p in set(after) - set(before)}
    assert 1 <= len(touched) <= 3 and len({p.split("bucket=")[1].split("/")[0] for p in before}) == 16
    assert rows(stored.load(spark, folder)) == rows(snapshots.upsert(first, batch, ["id"], MERGE))
    assert rows(stored.load(spark, folder, 1)) == rows(first)
    read = {p for p in stored.load(spark, folder).inputFiles()}
    assert sum("bucket=" in p and any(p.endswith(b[len(str(tmp_path)) :]) for b in before) for p in read) == len({p for p in before if p.split("bucket=")[1].split("/")[0] not in touched})


def test_failed_write_is_never_seen(spark, tmp_path):
    folder = f"{tmp_path}/t"
    table = spark.createDataFrame([(i, "a", i) for i in range(50)], SCHEMA)
    stored.create(table, folder, ["id"], buckets=8)
    failing = {"n": lambda old, new: F.when(new == 40, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.coalesce(new, old))}
    batch = spark.createDataFrame([(i, "b", i) for i in range(50)], SCHEMA)
    with pytest.raises(Exception, match="lost"):
        stored.upsert_stored(batch, folder, failing)
    assert rows(stored.load(spark, folder)) == rows(table)
    assert stored.upsert_stored(batch, folder, {}) == 2 and rows(stored.load(spark, folder)) == rows(batch)


def test_empty_tables_batches_and_refusals(spark, tmp_path):
    folder, none = f"{tmp_path}/t", spark.createDataFrame([], SCHEMA)
    with pytest.raises(FileNotFoundError):
        stored.load(spark, folder)
    assert stored.create(none, folder, ["id", "name"], buckets=4) == 1 and stored.load(spark, folder).count() == 0
    assert stored.upsert_stored(none, folder, MERGE) == 2 and stored.load(spark, folder).schema == none.schema
    some = spark.createDataFrame([(1, "x", 1), (1, None, 2)], SCHEMA)
    assert stored.upsert_stored(some.withColumn("extra", F.lit(1)), folder, MERGE) == 3 and rows(stored.load(spark, folder)) == rows(some)
    assert stored.upsert_stored(none, folder, MERGE) == 4 and rows(stored.load(spark, folder)) == rows(some)
    for refused, error in ((lambda: stored.create(some, folder, ["id"]), FileExistsError), (lambda: stored.load(spark, folder, 9), LookupError), (lambda: stored.create(some.withColumn("Bucket", F.lit(1)), f"{tmp_path}/u", ["id"]), ValueError)):
        with pytest.raises(error):
            refused()
