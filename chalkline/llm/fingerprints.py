"""Operator 1: document fingerprints by a homomorphic multiset hash.

Every paragraph (non-empty ``\\n`` line) is hashed to a wide vector and the vectors are summed lane by lane modulo
2**16.  The sum does not depend on paragraph order, and a paragraph is inserted or deleted by adding or subtracting
its vector.  A vector has two parts:

* ``DENSE`` lanes expanded from SHAKE-128 of the whole paragraph: equality of multisets;
* ``SIGN`` lanes: the sum of +-1 vectors of the paragraph's clauses (runs ended by punctuation).  The dot product of
  two such sums estimates how many clauses two texts share, so the cosine is a likeness that survives edits.

Defined results: null text counts as empty; the empty text has the all-zero fingerprint; equal fingerprints have
likeness 1; texts whose paragraphs are a permutation of each other are equal by design; rows that share a doc_id follow each
other in order of a hash of their text; a null doc_id comes last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import id_key, row_hash, small

DENSE, SIGN = 64, 128
CLAUSE = re.compile(r"[^.,;:!?]+")


class Fingerprint:
    """A multiset of paragraphs as lanes modulo 2**16; supports insert, delete and likeness."""

    __slots__ = ("dense", "sign")

    def __init__(self, text: str = "") -> None:
        self.dense, self.sign = np.zeros(DENSE, np.uint16), np.zeros(SIGN, np.uint16)
        self.insert(text)

    def insert(self, text: str) -> Fingerprint:
        return self._add(text, 1)

    def delete(self, text: str) -> Fingerprint:
        return self._add(text, -1)

    def copy(self) -> Fingerprint:
        other = Fingerprint()
        other.dense, other.sign = self.dense.copy(), self.sign.copy()
        return other

    def _add(self, text: str, times: int) -> Fingerprint:
        wide, signs = [], []
        for paragraph in text.split("\n"):
            if paragraph:
                wide.append(hashlib.shake_128(paragraph.encode()).digest(2 * DENSE))
                signs += [xxhash.xxh3_128_digest(c.encode()) for c in map(str.strip, CLAUSE.findall(paragraph)) if c]
        if wide:
            lanes = np.frombuffer(b"".join(wide), "<u2").reshape(-1, DENSE).sum(0, dtype=np.uint16)
            self.dense = self.dense + lanes if times > 0 else self.dense - lanes
        if signs:
            bits = np.unpackbits(np.frombuffer(b"".join(signs), np.uint8).reshape(-1, SIGN // 8), axis=1)
            lanes = (2 * bits.sum(0, dtype=np.int64) - len(signs)).astype(np.uint16)
            self.sign = self.sign + lanes if times > 0 else self.sign - lanes
        return self

    def hex(self) -> str:
        return (self.dense.astype("<u2").tobytes() + self.sign.astype("<u2").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        """Cosine of the signed lanes, clipped to 0..1; 1 for equal fingerprints."""
        if np.array_equal(self.dense, other.dense) and np.array_equal(self.sign, other.sign):
            return 1.0
        a, b = self.sign.view(np.int16).astype(np.float64), other.sign.view(np.int16).astype(np.float64)
        size = float(np.sqrt((a @ a) * (b @ b)))
        return min(max(float(a @ b) / size, 0.0), 1.0) if size else 0.0


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by the head of the next text, and where the change begins."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n], len(text) - n


def _rows(pairs: Iterable[tuple]) -> Iterator[tuple]:
    """(bucket, role, doc_id, text) in order -> result rows; role 0 is a document, others only close a bucket."""
    before = None
    for bucket, role, doc_id, text in pairs:
        text = text or ""
        now = (bucket, doc_id, text, Fingerprint(text), role)
        if before is not None and before[0] == bucket and not before[4]:
            _, own_id, own, own_print, _ = before
            changed, at = edited(own, text)
            start = own.rfind("\n", 0, at) + 1
            its = own_print.copy().delete(own[start:]).insert(changed[start:])
            yield (own_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), own_print.hex(), its.hex(), own_print.likeness(its), own_print.likeness(now[3]))
        before = now


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs() -> Iterator[tuple]:
        for batch in small(batches):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out: list[tuple] = []
    for row in _rows(pairs()):
        out.append(row)
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)


LEAST = -(2**63)
Place = tuple[int, int]


def _places(cuts: list[Place]) -> Column:
    return F.arrays_zip(F.lit([k for k, _ in cuts]).cast("array<long>").alias("key"), F.lit([h for _, h in cuts]).cast("array<long>").alias("hash"))


def _range(cuts: list[Place], step: int = 256) -> Column:
    """How many of the sorted cuts are at or before (key, hash)."""
    if not cuts:
        return F.lit(0)
    passed = lambda some: F.size(F.filter(some, lambda c: (c["key"] < F.col("key")) | (c["key"] == F.col("key")) & (c["hash"] <= F.col("hash"))))
    block = passed(_places(cuts[::step]))
    within = passed(F.slice(_places(cuts), (block - 1) * step + 1, step))
    return F.when(block == 0, 0).otherwise((block - 1) * step + within)


def range_cuts(rows: DataFrame, parts: int, n: int, per_part: int = 32) -> list[Place]:
    """Sorted starts (key, hash) of up to ``parts`` ranges of about equally many rows, the first one left out.

    A sample of keys by hash only places the cuts.  A key that would be cut more than once (many rows share an id, or have
    none) is cut into equal shares of the hashes, and one more pass finds the first row of each range.
    """
    seen = rows.select("key").where(F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(max(1, n // (parts * per_part)))) == 0)
    keys = sorted(r.key for r in seen.collect())
    wanted = Counter(keys[len(keys) * i // parts] for i in range(1, parts)) if keys else Counter()
    cuts = sorted((key, LEAST + (j << 64) // times) for key, times in wanted.items() for j in range(times))
    if len(wanted) == len(cuts):
        return cuts
    starts = rows.groupBy(_range(cuts)).agg(F.min(F.struct("key", "hash")).alias("least")).collect()
    return sorted((r.least.key, r.least.hash) for r in starts)[1:]


def fingerprint_successors(docs: DataFrame, docs_per_bucket: int = 2000, max_buckets: int = 65_536) -> DataFrame:
    """Fingerprint each text and its edited text, and compare it with the next document's.

    Documents are dealt into ranges of (doc_id, hash of the text), one shuffle of the texts.  The first document of a range
    is also sent, as a closing row, to the range before, and the very first to the last range, so no range needs to look into
    another.  Ranges hold about ``docs_per_bucket`` documents, more beyond ``max_buckets`` ranges (at 100 TB some 1.5 GB);
    they are sorted by Spark and streamed.
    """
    rows = docs.select(id_key().alias("key"), row_hash().alias("hash"), "doc_id", "text")
    n, first = rows.agg(F.count("*"), F.min("key")).first()
    parts = min(max_buckets, max(1, -(-n // docs_per_bucket)))
    cuts = [c for c in range_cuts(rows, parts, n) if c > (first, LEAST)] if parts > 1 else []
    at = lambda b, role: F.struct(b.cast("int").alias("bucket"), F.lit(role).alias("role"))
    start = F.element_at(_places(cuts), F.greatest(F.col("b"), F.lit(1))) if cuts else None
    # a cut from the sample stands before all rows of its id; one of them is enough to close a range
    starts = (F.col("b") > 0) & (F.col("key") == start["key"]) & ((start["hash"] == LEAST) | (start["hash"] == F.col("hash"))) if cuts else F.lit(False)
    places = F.array_compact(F.array(at(F.col("b"), 0), F.when(starts, at(F.col("b") - 1, 1)), F.when((F.col("key") == F.lit(first)) & (F.col("b") == 0), at(F.lit(len(cuts)), 2))))
    dealt = rows.withColumn("b", _range(cuts)).select(F.explode(places).alias("p"), "key", "hash", "doc_id", "text").select("p.bucket", "p.role", "key", "hash", "doc_id", "text")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "role", "key", "hash")
    return ordered.select("bucket", "role", "doc_id", "text").mapInArrow(_compare, DDL)
