"""Operator 10: byte-level dedup with a logarithmic family of suffix arrays.

Suffixes are sampled at anchors (``repeats``): those that begin at most 80 bytes before a repeated 20-byte anchor.  They are
dealt by anchor to shards, where equal suffixes meet, and a shard takes its documents in order, batch by batch:

1. A batch gets a suffix array: its suffixes in order of (anchor, distance to it, the 100 bytes that follow), sorted eight
   bytes at a time, only among those still tied.
2. It is merge-scanned against every level: the runs of both arrays that share an anchor and a distance are merged, and
   where a suffix of the batch comes to stand after one of the level with a common prefix of 100 bytes, it is a repeat.
   The first suffix of a context goes first, and its match is extended byte by byte as far as both texts agree; only what
   such long matches leave open is indexed suffix by suffix.
3. Suffixes that are new become the smallest level, with the bytes of their contexts.  Levels of about equal size merge, so
   a shard of n suffixes has O(log n) levels and each suffix is merged O(log n) times.

The number of shards follows the number of repeated anchors, so the memory of a task does not grow with the corpus.

Defined results: null text counts as empty; texts under 100 bytes lose nothing; a document may repeat itself; rows that
share a doc_id (or have none) are documents of their own, ordered by a hash of the text, and rows equal in doc_id and text
are one document; a null doc_id comes last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm.common import small
from chalkline.llm.repeats import HOT, KNOWN, U, _longs, _spread, covered, repeated_contexts, with_runs

WIDTH, GRAM = 100, 20
BATCH = 16_384  # contexts (some 40 suffixes each) in a suffix array's batch
DISTANCE = U(127)  # low bits of a bucket: the distance from the suffix to its anchor
RUN = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def words(blob: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in byte order (a view)."""
    return np.ndarray((max(0, len(blob) - 7),), ">u8", blob, strides=(1,))


def _steps(width: int) -> list[int]:
    return [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]


def _run_heads(same: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


def arrange(blob: np.ndarray, bucket: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of suffixes by (bucket, next width bytes), and which ones equal the one before over all of these."""
    eight, order = words(blob), np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(order) else np.zeros(0, bool)
    for step in _steps(width):
        tied = same.copy()
        tied[:-1] |= same[1:]
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        within = same[idx]
        value = eight[at[order[idx]] + step].astype(np.uint64)
        if (within[1:] & (value[1:] < value[:-1])).any():
            by = np.lexsort((value, np.cumsum(~within)))
            order[idx], value = order[idx[by]], value[by]
        same[idx] = np.concatenate([[False], within[1:] & (value[1:] == value[:-1])])
    return order, same


class SuffixArray(NamedTuple):
    """Suffixes in order of (bucket, bytes).  blob: the contexts' bytes and 8 more; ends: where contexts end, ascending."""

    blob: np.ndarray
    ends: np.ndarray
    bucket: np.ndarray
    at: np.ndarray

    def within(self, at: np.ndarray) -> np.ndarray:
        """Bytes from each place to the end of its context."""
        return self.ends[np.searchsorted(self.ends, at, side="right")] - at

    def merged(self, other: SuffixArray, width: int) -> SuffixArray:
        shift = len(self.blob) - 8
        blob, at = np.concatenate([self.blob[:-8], other.blob]), np.concatenate([self.at, other.at + np.int32(shift)])
        bucket = np.concatenate([self.bucket, other.bucket])
        order, _ = arrange(blob, bucket, at, width)
        return SuffixArray(blob, np.concatenate([self.ends, other.ends + shift]), bucket[order], at[order])

    def matches(self, other: SuffixArray, width: int) -> np.ndarray:
        """Merge scan: for each suffix of the other array a place here with the same next width bytes, or -1."""
        out = np.full(len(other.at), -1, np.int64)
        low, high = np.searchsorted(self.bucket, other.bucket), np.searchsorted(self.bucket, other.bucket, side="right")
        mine = np.flatnonzero(high > low)
        if not len(mine):
            return out
        new = np.concatenate([[True], np.diff(low[mine]) > 0])
        own = _spread(low[mine][new], (high - low)[mine][new])
        shift = len(self.blob)
        at = np.concatenate([self.at[own].astype(np.int64), other.at[mine] + shift])
        order, same = arrange(np.concatenate([self.blob, other.blob]), np.concatenate([self.bucket[own], other.bucket[mine]]), at, width)
        head = order[_run_heads(same)]
        hit = (order >= len(own)) & (head < len(own))
        out[mine[order[hit] - len(own)]] = at[head[hit]]
        return out


class LevelFamily:
    """Suffix arrays whose sizes grow geometrically."""

    def __init__(self, width: int = WIDTH) -> None:
        self.levels: list[SuffixArray] = []
        self.width = width

    def scan(self, array: SuffixArray) -> Iterator[tuple[SuffixArray, np.ndarray]]:
        """Each level with the matches of the array's suffixes in it."""
        for level in self.levels:
            yield level, level.matches(array, self.width)

    def add(self, array: SuffixArray) -> None:
        """A new smallest level; then levels no larger than twice the one after them are merged with it."""
        if len(array.at):
            self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2].at) <= 2 * len(self.levels[-1].at):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last, self.width)


def extended(blob: np.ndarray, at: np.ndarray, size: np.ndarray, other: np.ndarray, there: np.ndarray, room: np.ndarray, width: int) -> np.ndarray:
    """How far texts that agree over width bytes agree further, in steps of eight bytes (all of the shorter at most)."""
    most, length = np.minimum(size, room), np.full(len(at), width, np.int64)
    left, right, todo = words(blob), words(other), np.flatnonzero(most > width)
    while len(todo):
        to = np.minimum(length[todo] + 8, most[todo])
        ok = left[at[todo] + to - 8] == right[there[todo] + to - 8]
        todo, to = todo[ok], to[ok]
        length[todo] = to
        todo = todo[to < most[todo]]
    return length


def _known_heads(family: LevelFamily, blob: np.ndarray, ends: np.ndarray, bucket: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first windows of each context are inside a long match of its first suffix, earlier in the batch or in a level."""
    width, count = family.width, np.zeros(len(begin), np.int64)
    order, same = arrange(blob, bucket, begin, width)
    head = order[_run_heads(same)]
    later, first = head != order, np.flatnonzero(head == order)
    i, j = order[later], head[later]
    count[i] = extended(blob, begin[i], size[i], blob, begin[j], size[j], width) - width + 1
    array = SuffixArray(blob, ends, bucket[order[first]], begin[order[first]])
    for level, place in family.scan(array):
        hit = np.flatnonzero(place >= 0)
        i, there = order[first[hit]], place[hit]
        count[i] = np.maximum(count[i], extended(blob, begin[i], size[i], level.blob, there, level.within(there), width) - width + 1)
    return count


def repeated_windows(family: LevelFamily, blob: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch of contexts in document order -> runs of windows that start earlier (context, first window, last window).

    Adds the new suffixes to the family.  blob has at least 8 bytes behind the last context.
    """
    width = family.width
    windows, ends = size - width + 1, begin + size
    bucket_of = lambda k, offset: key[k] & ~DISTANCE | ((lead[k] - offset).astype(np.uint64) & DISTANCE)
    known = _known_heads(family, blob, ends, bucket_of(np.arange(len(begin)), np.zeros(len(begin), np.int64)), begin, size)
    whole = np.flatnonzero(known == windows)
    rest = np.flatnonzero(known < windows)
    row, offset = np.repeat(rest, windows[rest]), _spread(np.zeros(len(rest), np.int64), windows[rest])
    flags = offset < known[row]
    todo = np.flatnonzero(~flags)
    at, bucket = begin[row[todo]] + offset[todo], bucket_of(row[todo], offset[todo])
    order, same = arrange(blob, bucket, at, width)
    lone = order[~same]
    array = SuffixArray(blob, ends, bucket[lone], at[lone])
    old = np.zeros(len(lone), bool)
    for _, place in family.scan(array):
        old |= place >= 0
    repeated = np.ones(len(todo), bool)
    repeated[lone] = old
    flags[todo] = repeated
    family.add(_compact(blob, begin, size, row[todo[lone[~old]]], bucket[lone[~old]], at[lone[~old]]))
    spot = np.flatnonzero(flags)
    if len(spot):
        new = np.concatenate([[True], (np.diff(spot) > 1) | (np.diff(row[spot]) > 0)])
        head, tail = spot[new], spot[np.concatenate([new[1:], [True]])]
    else:
        head = tail = spot
    return np.concatenate([whole, row[head]]), np.concatenate([np.zeros(len(whole), np.int64), offset[head]]), np.concatenate([windows[whole] - 1, offset[tail]])


def _compact(blob: np.ndarray, begin: np.ndarray, size: np.ndarray, row: np.ndarray, bucket: np.ndarray, at: np.ndarray) -> SuffixArray:
    """The suffixes with only those contexts' bytes that they are in."""
    used, own = np.unique(row, return_inverse=True)
    ends = np.cumsum(size[used])
    held = np.concatenate([blob[_spread(begin[used], size[used])], np.zeros(8, np.uint8)])
    return SuffixArray(held, ends, bucket, (at - begin[row] + (ends - size[used])[own]).astype(np.int32))


def _batched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _runs(width: int, rows: int) -> Callable:
    """Contexts of a shard in document order -> runs of positions covered by windows that start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, before = LevelFamily(width), None
        for batch in _batched(batches, rows):
            key, doc, row, start, kind, lead = (_longs(batch.column(i)) for i in range(6))
            _, offsets, data = batch.column(6).buffers()
            places = np.frombuffer(offsets, np.int32)[batch.column(6).offset :][: batch.num_rows + 1].astype(np.int64)
            blob = np.concatenate([np.frombuffer(data, np.uint8)[: places[-1]], np.zeros(8, np.uint8)])
            known = np.flatnonzero(kind == KNOWN)
            if len(known):
                refs = blob[_spread(places[known], np.full(len(known), 24))].view(np.int64).reshape(-1, 3)
                known = known[(refs[:, 0] != doc[known]) | (refs[:, 1] != row[known]) | (refs[:, 2] != start[known])]
                yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(row[known]), pa.array(start[known]), pa.array(start[known] + np.int32(width))], schema=RUN)
            use = np.flatnonzero(kind != KNOWN)
            if not len(use):
                continue
            # equal rows give the same contexts, one after the other
            again = (np.diff(doc[use]) == 0) & (np.diff(row[use]) == 0) & (np.diff(start[use]) == 0)
            last, before = before, (doc[use[-1]], row[use[-1]], start[use[-1]])
            use = use[~np.concatenate([[last == (doc[use[0]], row[use[0]], start[use[0]])], again])]
            if not len(use):
                continue
            which, first, final = repeated_windows(family, blob, places[use], places[use + 1] - places[use], key[use].view(np.uint64), lead[use].astype(np.int64))
            own = use[which]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(row[own]), pa.array((start[own] + first).astype(np.int32)), pa.array((start[own] + final + width).astype(np.int32))], schema=RUN)

    return run


def repeated_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """(doc, row, start, stop): bytes covered by windows that also start earlier; runs may overlap."""
    contexts = repeated_contexts(docs, "bytes", width, gram, hot)
    return contexts.sortWithinPartitions("doc", "row", "start", "key").mapInArrow(_runs(width, batch), "doc long, row long, start int, stop int")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for key, doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = (text or "").encode()
            spans = covered([(r["start"], r["stop"]) for r in runs or () if r["doc"] == key])
            digest, at, removed = hashlib.sha256(), 0, 0
            for s, e in spans:
                digest.update(data[at:s])
                at, removed = e, removed + e - s
            digest.update(data[at:])
            out.append((doc_id, len(data), removed, len(spans), digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, SHA-256 of the remaining bytes."""
    return with_runs(docs, repeated_runs(docs, width, gram, hot, batch)).mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
pos AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d WHERE len(x) >= 200),
h AS (SELECT doc_id, i, md5_number(x[2 * i + 1:2 * i + 200]) AS h FROM pos),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
isl AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS p FROM dup)),
run AS (SELECT doc_id, g, min(i) AS s, max(i) + 100 AS e FROM isl GROUP BY doc_id, g),
cut AS (SELECT r.doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY r.doc_id ORDER BY s), 0) AS before, x FROM run r JOIN d ON r.doc_id = d.doc_id),
kept AS (SELECT doc_id, string_agg(x[2 * before + 1:2 * s], '' ORDER BY s) AS head, max(e) AS last, sum(e - s) AS n, count(*) AS c FROM cut GROUP BY doc_id)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(k.n, 0)::BIGINT AS n_removed, coalesce(k.c, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.head, '') || x[2 * coalesce(k.last, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
