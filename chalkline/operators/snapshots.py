"""Memory, queue and review tables as snapshots: upserts, counters, status changes, reviews.

A snapshot is a table with a unique key.  An upsert folds the batch by key, joins it to the old snapshot by a full outer
join and lets every column choose between old and new; the result is the next snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Merge = Callable[[Column, Column], Column]


def newest(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep_old(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def greatest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def ranked(order: Sequence[str]) -> Merge:
    """The value that comes first in ``order``."""
    place = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, order)), c), F.lit(len(order) + 1))
    return lambda old, new: F.when(old.isNull(), new).when(new.isNull(), old).when(place(new) < place(old), new).otherwise(old)


def protected(values: Sequence[str]) -> Merge:
    """The new value unless the old one is decided."""
    return lambda old, new: F.when(old.isin(*values), old).otherwise(F.coalesce(new, old))


def upsert(old: DataFrame, batch: DataFrame, keys: Sequence[str], merge: Mapping[str, Merge]) -> DataFrame:
    """The next snapshot; ``batch`` is unique by key.  Columns without a rule take the new value where there is one."""
    rest = [c for c in old.columns if c not in keys]
    new = batch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in rest])
    same = [old[k].eqNullSafe(new[f"_k_{k}"]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = old.join(new, on, "full_outer")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"_k_{k}")).alias(k) for k in keys], *[merge.get(c, newest)(F.col(c), F.col(f"_n_{c}")).alias(c) for c in rest]).select(*old.columns)


def bump(table: DataFrame, used: DataFrame, key: str, counter: str, stamp: str) -> DataFrame:
    """counter + number of uses and the last use's time, for (key, ts) uses."""
    uses = used.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    joined = table.join(uses, table[key] == F.col("_key"), "left")
    return joined.withColumn(counter, F.col(counter) + F.coalesce("_n", F.lit(0))).withColumn(stamp, F.coalesce("_ts", stamp)).drop("_key", "_n", "_ts")


def page(table: DataFrame, where: Column, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A window of the matching rows in a stated order."""
    return table.where(where).orderBy(*order).offset(offset).limit(limit)


def split_valid(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, broken rows with the names of the rules)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = rows.withColumn("problems", broken)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def apply_corrections(table: DataFrame, corrections: DataFrame, key: str, columns: Sequence[str], flag: str) -> DataFrame:
    """The latest correction (by ts) of a row overrides its columns and sets the flag."""
    last = corrections.groupBy(F.col(key).alias("_key")).agg(*[F.max_by(c, "ts").alias(f"_{c}") for c in columns])
    joined = table.join(last, table[key] == F.col("_key"), "left")
    values = {c: F.coalesce(f"_{c}", c) for c in columns}
    return joined.withColumns({**values, flag: F.col("_key").isNotNull() | F.col(flag)}).drop("_key", *[f"_{c}" for c in columns])


def review(entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities (id, status, value) after decisions (id, action, new_value, ts), audit rows of the changes).

    approve, reject and disable set the status; correct also sets the value.  The latest decision of a row counts.
    """
    last = latest(decisions, ["id"], F.desc("ts"), F.col("action"))
    joined = entities.join(last, "id", "left")
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").when(F.col("action") == "disable", "disabled").when(F.col("action") == "correct", "approved").otherwise(F.col("status"))
    value = F.when(F.col("action") == "correct", F.coalesce("new_value", "value")).otherwise(F.col("value"))
    both = joined.withColumn("_status", status).withColumn("_value", value)
    after = both.select("id", F.col("_status").alias("status"), F.col("_value").alias("value"))
    audit = both.where("action is not null").select("id", "action", F.to_json(F.struct("status", "value")).alias("old"), F.to_json(F.struct(F.col("_status").alias("status"), F.col("_value").alias("value"))).alias("new"))
    return after, audit
