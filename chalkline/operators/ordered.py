"""Walks over ordered groups: a group of any length streams through its task, only the walk's own state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 10_000


def walk_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], made: StructType, walk: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """keys and what ``walk`` makes (``made``) of the ``values`` of each group's rows, which it gets in order, one by one.

    One shuffle by keys and a sort inside partitions.  The walk may stop early; what it leaves is skipped.
    """
    types = [*(f for f in rows.select(*keys).schema), *made]
    schema, n = StructType(types), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        give = lambda found: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kinds)], schema=kinds)
        told = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: list[tuple] = []
        for key, group in groupby(told, lambda row: row[:n]):
            for one in walk(row[n:] for row in group):
                found.append((*key, *one))
                if len(found) >= ROWS:
                    yield give(found)
                    found = []
        if found:
            yield give(found)

    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *values)
    return sorted_rows.mapInArrow(run, schema)
