"""Operator 4: SimHash near-duplicates with pivot distance tables.

A fingerprint's pivot table holds its Hamming distances to ``PIVOTS`` reference fingerprints, kept per 16-bit segment
(their sum is the distance to the whole pivot).  Two fingerprints within 2 bits agree in at least two of the four
segments, so their distances to every pivot agree there: those parts of the table are the cell in which partners meet.
Pairs of a cell whose tables differ by more than 2 in any coordinate are discarded (a distance changes by at most the
bits that differ); survivors are verified bit by bit.

A cell of more than ``MAX_CELL`` distinct fingerprints forms no pairs.  Its members differ only outside the two agreed
segments, and two of them are within 2 bits exactly when they share a fingerprint within 1 bit of both.  Each member
visits its 33 candidates for such a middle; at most 33 members meet in one middle and are chained to the smallest.

The distances to whole pivots (``table``) only sift the pairs of small cells; the cells themselves, and the middles of
large ones, rest on the distances inside segments.

Defined results: null text counts as empty; fewer than 3 words make one shingle, none makes fingerprint zero, linked
like any other; repeated rows share fingerprint and component; a null doc_id counts as largest; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import LAST_ID, id_key, materialize, row_hash, small, texts, whole_row
from chalkline.llm.components import components

SHINGLE, MAX_BITS, PIVOTS, SEGMENTS, MAX_CELL = 3, 2, 24, 4, 24
HOT_ROWS = 1_000_000  # fingerprints of more rows are sent to all tasks: at most one for each million rows
WIDTH = 64 // SEGMENTS
_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


REFERENCES = [signed(_xxh64(b"pivot %d" % i)) for i in range(PIVOTS)]


def fingerprint(raw: bytes) -> int:
    """Majority bits of the shingles' XXH64, as a signed 64-bit number."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else iter([b" ".join(words)])
    hashes = np.fromiter(map(_xxh64, shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = pa.array([fingerprint(raw) for raw in texts(batch)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _mask(segment: int) -> int:
    return signed(((1 << WIDTH) - 1) << (segment * WIDTH))


def pivot_tables(nodes: DataFrame) -> DataFrame:
    """Adds seg0..seg3 (distances to all pivots inside a segment) and table (distances to the whole pivots)."""
    near = lambda s: F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_mask(s)))).cast("tinyint") for p in REFERENCES])
    out = nodes.select("*", *[near(s).alias(f"seg{s}") for s in range(SEGMENTS)])
    add: Column = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: (x + y).cast("tinyint")), [F.col(f"seg{s}") for s in range(SEGMENTS)])
    return out.withColumn("table", add)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that hold together all those within MAX_BITS."""
    pairs = list(combinations(range(SEGMENTS), 2))
    cell = lambda k, s, t: F.struct(F.lit(k).alias("kind"), F.xxhash64(F.lit(k), F.col(f"seg{s}"), F.col(f"seg{t}")).alias("key"))
    cells = pivot_tables(nodes.select("fp")).select("fp", "table", F.explode(F.array(*[cell(k, s, t) for k, (s, t) in enumerate(pairs)])).alias("c")).select("c.kind", "c.key", "fp", "table")
    cells = materialize(cells, "cells")
    sizes = materialize(cells.groupBy("kind", "key").count().where("count > 1"), "sizes", cells.count())
    small = cells.join(sizes.where(F.col("count") <= MAX_CELL), ["kind", "key"], "left_semi")
    a, b = small.alias("a"), small.alias("b")
    far = F.array_max(F.zip_with("a.table", "b.table", lambda x, y: F.abs(x - y)))
    close = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (far <= MAX_BITS))
    verified = close.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    free = [[bit for s in range(SEGMENTS) if s not in pair for bit in range(s * WIDTH, (s + 1) * WIDTH)] for pair in pairs]
    flips = F.lit([[0, *(signed(1 << b) for b in bits)] for bits in free])
    hot = cells.join(sizes.where(F.col("count") > MAX_CELL), ["kind", "key"], "left_semi").select("kind", "fp")
    middles = hot.select("fp", F.explode(F.element_at(flips, F.col("kind") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    chained = middles.groupBy("middle").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1).select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a <> b")
    return verified.union(chained).distinct()


def _labels(found: DataFrame) -> DataFrame:
    """fp, number of rows, label of its component and component_id (smallest doc_id reachable) of every fingerprint in found
    (doc_id, fp)."""
    nodes = materialize(found.groupBy("fp").agg(F.min(id_key()).alias("rep"), F.count("*").alias("n")), "nodes", found.count())
    joined = materialize(links(nodes), "links")
    labels = components(joined, 2 * joined.count()).withColumnRenamed("node", "fp")
    labelled = nodes.join(labels, "fp", "left").select("fp", "n", "rep", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    return labelled.join(least, "label").select("fp", "n", "label", F.when(F.col("component") != LAST_ID, F.col("component")).alias("component_id"))


def _with_labels(found: DataFrame, hot_rows: int) -> DataFrame:
    """found with label and component_id of each row's fingerprint; no task gathers the rows of a frequent one."""
    of = materialize(_labels(found), "components")
    hot, rest = F.broadcast(of.where(F.col("n") > hot_rows)), of.where(F.col("n") <= hot_rows)
    return found.join(hot, "fp").union(found.join(hot, "fp", "left_anti").join(rest, "fp")).drop("n")


def near_duplicates(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document."""
    found = materialize(fingerprints(docs), "fingerprints")
    return _with_labels(found, hot_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of every component (the smallest doc_id, null last, then the smallest hash of the text), all columns kept.

    A row is known by doc_id and a hash of its text, so every component keeps a row, also one in which all ids are null
    or belong to other components as well; among rows equal in both, one stays.  A component's keeper is found on
    (doc_id, hash, component) rows alone; texts are touched only by the last join.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("hash"), "text")
    found = materialize(rows.mapInArrow(_fingerprints, "doc_id long, hash long, fp long"), "fingerprints")
    labelled = _with_labels(found, hot_rows)
    least = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("row"))
    keepers = least.select(F.coalesce("row.doc_id", F.lit(LAST_ID)).alias("key"), F.col("row.hash").alias("hash"))
    whole = docs.select(whole_row(docs).alias("doc"), id_key().alias("key"), row_hash().alias("hash"))
    return whole.join(keepers, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"]).select("doc.*")
