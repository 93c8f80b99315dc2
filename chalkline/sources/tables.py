"""Readers: chunk files and registered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<chunk_id:bigint,text:string>"


def _records(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """file, chunks (of an object with such a list, or one element of a bare list) and record, what is neither of these."""
    schema = f"chunks array<{CHUNK}>, chunk_id bigint, text string, _corrupt_record string"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", multi_line).json(path)
    one = F.when(F.col("chunk_id").isNotNull() | F.col("text").isNotNull(), F.array(F.struct("chunk_id", "text").cast(CHUNK)))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.coalesce("chunks", one).alias("chunks"), F.coalesce("_corrupt_record", F.lit("no list of chunks")).alias("record"))


def read_chunks(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False) -> DataFrame:
    """One row a chunk from .json files of a folder: objects with a list ``chunks``, or bare lists of chunks.

    A record a line, or with multi_line a record a file.  What has no such list fails the read, naming its file; unless
    ``strict``, it is left out, and ``rejected_chunks`` has it.
    """
    found = _records(spark, path, multi_line)
    missing = F.raise_error(F.concat(F.lit("no list of chunks in "), "file")).cast(f"array<{CHUNK}>")
    rows = found.select(F.coalesce("chunks", missing).alias("chunks")) if strict else found.where("chunks is not null")
    return rows.select(F.explode("chunks").alias("c")).select("c.*")


def rejected_chunks(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """file, record: what ``read_chunks`` cannot read, broken records as they stand."""
    return _records(spark, path, multi_line).where("chunks is null").select("file", "record")


def discover_chunk_files(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """file, n_chunks of every file under a folder that has one of the two chunk shapes."""
    return _records(spark, path, multi_line).where("chunks is not null").groupBy("file").agg(F.sum(F.size("chunks")).alias("n_chunks"))


def registered_pairs(documents: DataFrame) -> DataFrame:
    """(pair_key, document_type, doc_id) folded to one paper and one scheme per key, with a status."""
    of = lambda kind: F.col("document_type") == kind
    folded = documents.groupBy("pair_key").agg(
        F.min(F.when(of("question_paper"), F.col("doc_id"))).alias("question_paper"), F.min(F.when(of("mark_scheme"), F.col("doc_id"))).alias("mark_scheme"),
        F.count_if(of("question_paper")).alias("nq"), F.count_if(of("mark_scheme")).alias("nm"),
    )
    status = F.when((F.col("nq") > 1) | (F.col("nm") > 1), "duplicate").when((F.col("nq") == 0) | (F.col("nm") == 0), "incomplete").otherwise("complete")
    return folded.select("pair_key", "question_paper", "mark_scheme", status.alias("status"))


def eligible(documents: DataFrame, labels: DataFrame, turns: DataFrame, languages: tuple[str, ...] = ("en", "fr", "de")) -> DataFrame:
    """Documents that may be retrieved: seven conditions over three joined tables."""
    good = documents.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("lang").isin(*languages) & (F.col("n_chars") >= 200)).drop("text")
    return good.join(labels.where("quality = 1 and toxic = 0"), "doc_id").join(turns.where("turns >= 2"), "doc_id")


SPLIT = 128 << 20


def spread(table: DataFrame, least: int = 1 << 20) -> DataFrame:
    """table, dealt to all cores where its files are too small to fill them with splits: one row group is one task.

    Tables of under ``least`` bytes, or with a split for every core, stay as they are; no result depends on it.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if least <= size < cores * SPLIT else table
