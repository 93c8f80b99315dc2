"""Operator 7: substring dedup by relative Lempel-Ziv parsing over words.

Reference blocks are the stretches of 20-word windows around sampled anchors (``repeats``).  Every distinct block is
indexed: a trie of its runs of windows, whose nodes know the place where each run first starts.  The next block with the
same anchor is factored greedily against all of them: at a window the longest run that some indexed block holds becomes a
factor (at least 20 words long, a window), and the walk goes on at the first window that straddles the factor's end.  A
block equal to an indexed one is a single factor.

A document's factors that continue each other on the same diagonal of the same reference text are joined, and the
document is parsed greedily: from where the last factor ended, the one that reaches farthest among those beginning at or
before that word, so that repeats that straddle a boundary are found.  The chosen factors are the spans to remove.

Blocks agree when their 64-bit window hashes do, under the same 64-bit anchor hash.

Defined results: null text counts as empty; texts shorter than a window lose nothing; a document may repeat itself; rows
that share a doc_id (or have none) are documents of their own, ordered by a hash of the text, and rows equal in doc_id and
text are one document; a null doc_id comes last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm.common import small
from chalkline.llm.repeats import KNOWN, repeated_contexts, with_runs

WIDTH, GRAM = 20, 8
HOT = 8_000  # anchors with more occurrences are taken window by window, which bounds a trie
FACTOR = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("ref_doc", pa.int64()), ("ref_row", pa.int64()), ("ref_start", pa.int32())])
FACTOR_DDL = "doc long, row long, start int, stop int, ref_doc long, ref_row long, ref_start int"
Place = tuple[int, int, int]


class Reference:
    """The indexed blocks of one anchor; a block is its windows' hashes, a place (doc, row, start)."""

    def __init__(self) -> None:
        self.blocks: dict[bytes, Place] = {}
        self.trie: dict[tuple[int, int], tuple[int, Place]] = {}

    def factors(self, block: bytes) -> Iterator[tuple[int, int, Place]]:
        """Greedy factors (first window, number of windows, place) of a block against all indexed ones."""
        if (whole := self.blocks.get(block)) is not None:
            yield 0, len(block) // 8, whole
            return
        windows, i = np.frombuffer(block, np.uint64).tolist(), 0
        while i < len(windows):
            node, end, place = 0, i, None
            while end < len(windows) and (hit := self.trie.get((node, windows[end]))) is not None:
                (node, place), end = hit, end + 1
            if place is not None:
                yield i, end - i, place
            i = max(end, i + 1)

    def index(self, block: bytes, place: Place) -> None:
        """Add a block with all runs of its windows; runs known already keep their first place."""
        if block in self.blocks:
            return
        self.blocks[block] = place
        windows = np.frombuffer(block, np.uint64).tolist()
        for i in range(len(windows)):
            node, start = 0, (place[0], place[1], place[2] + i)
            for window in windows[i:]:
                hit = self.trie.get((node, window))
                if hit is None:
                    hit = self.trie[node, window] = len(self.trie) + 1, start
                node = hit[0]


def _factors(width: int) -> Callable:
    """Contexts sorted by (key, doc, row, start) -> factors against the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, reference = None, None, Reference()
        for batch in batches:
            out: list[tuple] = []
            for key, doc, row, start, kind, _, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = doc, row, start
                if kind == KNOWN:
                    ref = tuple(np.frombuffer(context, np.int64).tolist())
                    if ref != place:
                        out.append((*place, start + width, *ref))
                    continue
                if key != current:
                    current, before, reference = key, None, Reference()
                if place == before:
                    continue  # a row equal to the one before
                before = place
                for at, n, ref in reference.factors(context):
                    out.append((doc, row, start + at, start + at + n - 1 + width, *ref))
                reference.index(context, place)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FACTOR)], schema=FACTOR)

    return run


def factors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """FACTOR rows: words start..stop of (doc, row) repeat what starts at ref_start of (ref_doc, ref_row)."""
    contexts = repeated_contexts(docs, "words", width, gram, hot)
    return contexts.sortWithinPartitions("key", "doc", "row", "start").mapInArrow(_factors(width), FACTOR_DDL)


def diagonals(found: list[tuple]) -> list[tuple[int, int]]:
    """(start, stop) of factors (start, stop, ref_doc, ref_row, ref_start), those that go on word by word in the same
    reference text joined."""
    out: list[list[int]] = []
    last: tuple | None = None
    for diagonal, start, stop in sorted(((doc, row, ref - start), start, stop) for start, stop, doc, row, ref in found):
        if diagonal == last and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
        last = diagonal
    return [(s, e) for s, e in out]


def parse(found: list[tuple]) -> list[tuple[int, int]]:
    """Greedy parse of a document: disjoint (start, stop), each the part of a factor beyond the end of the one before."""
    todo, out, at, k = sorted(diagonals(found)), [], 0, 0
    while k < len(todo):
        at = max(at, todo[k][0])
        farthest = at
        while k < len(todo) and todo[k][0] <= at:
            farthest = max(farthest, todo[k][1])
            k += 1
        if farthest > at:
            out.append((at, farthest))
            at = farthest
    return out


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())])


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for s, e in spans:
        out += words[at:s]
        at = e
    return out + words[at:]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for key, doc_id, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = (text or "").encode().split()
            parsed = parse([(r["start"], r["stop"], r["ref_doc"], r["ref_row"], r["ref_start"]) for r in found or () if r["doc"] == key])
            kept = kept_words(words, parsed)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), len(parsed)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Per document: words, removed words, SHA-256 of the kept words joined by one space, number of factors."""
    return with_runs(docs, factors(docs, width, gram, hot)).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM h) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM dup, range(20) t(k)),
each AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i, len(words) AS n FROM d),
kept AS (SELECT e.doc_id, string_agg(w, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
