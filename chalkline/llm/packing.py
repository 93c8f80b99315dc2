"""Operator 9: best-fit packing by sums of squares.

Documents become token pieces of at most ``CAPACITY`` (only longer ones are cut; the first piece takes the remainder).
A piece goes to the open bin that makes the sum of squared counts of open bins per residual gap smallest; a bin opens
only where no open one fits, and pieces come longest first, which leaves fewer bins than arrival order.  Full pieces are
sequences by themselves.  The rest is packed in groups of about ``GROUP`` pieces, dealt by content and by the row of the
written table of pieces, so that pieces with equal ids, or none, spread as well: only ids, lengths and checksums are
shuffled, and each group ends with a handful of open bins whatever the corpus's size.

Defined results: null text counts as empty and still has the closing id; repeated rows are pieces of their own; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import materialize, small, texts

CAPACITY, CLOSING_ID, GROUP = 2048, 0, 40_000
SPECIAL = "<|endoftext|>"
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@cache
def _exact():
    """The tokenizer, loaded by tasks that meet a text with the special token only: each worker would hold it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


@cache
def _fast():
    """The same vocabulary as ranks, which gives the same ids several times faster where a text has no special token."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str) -> list[int]:
    return _exact().encode(text, add_special_tokens=False).ids if SPECIAL in text else _fast().encode_ordinary(text)


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids."""
    first = n % capacity or capacity
    cuts = [0, *range(first, n + 1, capacity)]
    return [(s, e - s) for s, e in zip(cuts, cuts[1:])]


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for doc_id, raw in zip(batch.column(0).to_pylist(), texts(batch)):
            ids = np.array([*token_ids(raw.decode()), CLOSING_ID], "<u4")
            out += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(pieces(len(ids)))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, given longest first."""
    count = np.zeros(capacity + 1, np.int64)  # open bins per residual gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.int64(1) << 60
    for i, n in enumerate(lengths.tolist()):
        gap, open_bins = capacity, count[n:capacity]
        if len(open_bins):
            change = 2 * (count[: capacity - n] - open_bins) + 2
            change[0] = 1 - 2 * open_bins[0]  # the bin is full then and counts no more
            change[open_bins == 0] = never
            best = int(change.argmin())
            if change[best] < never:
                gap = n + best
        if gap == capacity:
            at, opened = opened, opened + 1
        else:
            at = bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = at, capacity - gap
        if gap > n:
            bins[gap - n].append(at)
            count[gap - n] += 1
    return where, offset


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    where, offset = pack(rows["length"].to_numpy())
    rows["sequence_id"], rows["offset"] = rows["part"].to_numpy() * (1 << 32) + where, offset
    return rows.drop(columns="part")


def packed_sequences(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut, PIECE_DDL), "pieces")
    full = cut.where(F.col("length") == CAPACITY).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < CAPACITY)
    parts = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)))
    return full.union(dealt.groupBy("part").applyInPandas(_pack_group, PIECE_DDL + ", sequence_id long, offset long"))
