"""Shared helpers of the training-data operators.

Words are always the contract's ``[^\\x20\\x09-\\x0D]+``.  Python's ``bytes.split()`` cuts at exactly those six
bytes and ``bytes.lower()`` touches only A-Z, so the Arrow kernels work on UTF-8 bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, because kernels hold working arrays for a whole batch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the session's checkpoint folder.

    Where neither is set, a local master gets a temporary one (driver and tasks are one process there); a cluster raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


ROWS_PER_FILE = 100_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes with the application, or earlier with ``scratch``.  rows: how many narrow rows it has at most; small tables then get few files, each of about ROWS_PER_FILE rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // ROWS_PER_FILE)).write.parquet(path)
    where, files = _storage(spark, path)
    files.deleteOnExit(where)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _storage(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder written to shared storage."""
    where, files = _storage(spark, path)
    files.delete(where, True)


def written() -> int:
    """How many materialized tables there are; marks a place for ``drop_written``."""
    return len(_written)


def drop_written(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the tables materialized since the mark, but for the ``keep`` newest."""
    end = len(_written) - keep
    for path in _written[since:end]:
        discard(spark, path)
    del _written[since:end]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are deleted at the end; what was computed from them must be written by then."""
    before = written()
    try:
        yield
    finally:
        drop_written(spark, before)


def row_hash() -> Column:
    """With doc_id, tells rows apart whose doc_id is null or repeated; rows equal in doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def quoted(name: str) -> str:
    """A column name as it is, also where it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def map_rows(docs: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of docs through a kernel over Arrow batches, which gets the place of ``text``; columns may have any names."""
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(lambda batches: kernel(batches, at), plain.schema).toDF(*docs.columns)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that columns put beside it clash with none of them."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def id_key(column: str = "doc_id") -> Column:
    """doc_id for ordering and joins; null counts as the last document."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def word_array(text: Column) -> Column:
    """Native words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Native number of words without building a second array."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_BREAK)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def texts(batch: pa.RecordBatch, column: int | str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    at = column if isinstance(column, int) else batch.schema.get_field_index(column)
    for value in batch.column(at).cast(pa.large_binary()):
        yield value.as_py() or b""
