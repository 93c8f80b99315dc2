"""Windows of a fixed width that occur earlier in a corpus: the machinery of operators 7 and 10.

A document is a sequence of symbols (bytes, or hashed words).  Every window of ``width`` symbols has one anchor: its
leftmost ``gram``-symbol run of smallest hash.  Equal windows have equal anchors, so only a sample of positions (about
2 in ``width - gram + 2``) is indexed, and still every pair of equal windows meets:

1. ``anchors``: one scan emits (anchor hash, row, position); sorting by hash finds the hashes that occur twice.
2. ``contexts``: documents that hold such anchors emit the windows around them, keyed by the anchor.
3. a resolver (one per operator) sees windows of an anchor in document order and reports those seen before.  Anchors are
   dealt to so many shards that each takes about ``SHARD`` contexts, whatever the corpus's size.

A document is known by doc_id (null last) and a hash of id and text (``row_hash``), which also orders documents that share
an id; rows equal in both are one document.

Hot anchors: a task that meets an anchor again says so once and then sends its rows under a spread key; an anchor with
more than ``HOT`` occurrences has its windows keyed one by one, of which a task sends only the earliest so far.  So the
rows of one key grow with the number of tasks, not with the number of occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import id_key, materialize, row_hash

CHUNK, HOT, SHARD = 1 << 20, 50_000, 150_000
MOST_SEEN, MOST_LEADS = 4_000_000, 100_000  # what a task remembers; beyond it starts anew and only sends more rows
U = np.uint64
BASE, SPREAD = U(0x9E3779B97F4A7C15 | 5), U(0xD6E8FEB86659FD93)
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0..n-1."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        inverse = pow(int(BASE), -1, 1 << 64)
        for k, base in enumerate((BASE, U(inverse))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols start..end from prefix sums; equal runs hash equal wherever they stand."""
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


@dataclass
class Chunk:
    """Several documents as one symbol sequence."""

    values: np.ndarray  # a 64-bit value for each symbol
    bounds: np.ndarray  # start of each document, and the end


def byte_symbols(raw: list[bytes]) -> Chunk:
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return Chunk(BYTE_VALUE[np.frombuffer(b"".join(raw), np.uint8)], np.concatenate([[0], np.cumsum(lengths)]))


def word_symbols(raw: list[bytes]) -> Chunk:
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = _BREAK[data]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = prefix(BYTE_VALUE[data])
    values = mix(run_hash(sums, starts, ends) + (ends - starts).astype(np.uint64))
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    return Chunk(values, np.searchsorted(starts, begins + 1))


SYMBOLS: dict[str, Callable[[list[bytes]], Chunk]] = {"bytes": byte_symbols, "words": word_symbols}


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, v
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


@dataclass
class Anchors:
    doc: np.ndarray  # document within the chunk
    at: np.ndarray  # position in the chunk
    first: np.ndarray  # first and last window start that choose the anchor
    last: np.ndarray
    hash: np.ndarray
    sums: np.ndarray


def anchors_of(chunk: Chunk, width: int, gram: int) -> Anchors:
    n = len(chunk.values)
    none = np.zeros(0, np.int64)
    if n < width:
        return Anchors(none, none, none, none, np.zeros(0, np.uint64), np.zeros(1, np.uint64))
    sums = prefix(chunk.values)
    grams = (sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n + 1 - gram]
    low = (U(1) << U(int(n).bit_length())) - U(1)
    ranked = (grams * SPREAD) & ~low | np.arange(len(grams), dtype=np.uint64)
    chosen = (sliding_min(ranked, width - gram + 1) & low).astype(np.int64)
    doc_of = np.repeat(np.arange(len(chunk.bounds) - 1), np.diff(chunk.bounds))
    starts = np.flatnonzero(doc_of[: n - width + 1] == doc_of[width - 1 :])
    chosen = chosen[starts]
    if not len(starts):
        return Anchors(none, none, none, none, np.zeros(0, np.uint64), sums)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (np.diff(starts) > 1)]))
    at = chosen[new]
    last = starts[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    return Anchors(doc_of[at], at, starts[new], last, mix(grams[at]), sums)


def chunks(raw: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, each with the number of its first text."""
    at = 0
    while at < len(raw):
        end, size = at + 1, len(raw[at])
        while end < len(raw) and size + len(raw[end]) <= CHUNK:
            size += len(raw[end])
            end += 1
        yield at, raw[at:end]
        at = end


class Seen:
    """A set of hashes as sorted arrays whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def has(self, values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(values), bool)
        for part in self.parts:
            found |= part[np.minimum(np.searchsorted(part, values), len(part) - 1)] == values
        return found

    def add(self, values: np.ndarray) -> None:
        """Sorted values that are not in the set."""
        if len(values):
            self.parts.append(values)
        while len(self.parts) > 1 and len(self.parts[-2]) <= 2 * len(self.parts[-1]):
            last = self.parts.pop()
            self.parts[-1] = np.sort(np.concatenate([self.parts[-1], last]), kind="stable")
        if sum(map(len, self.parts)) > MOST_SEEN:
            self.parts = []


PLAIN, TELLS, KNOWN = 0, 1, 2
ANCHOR = pa.schema([("key", pa.int64()), ("spread", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("kind", pa.int8())])
ANCHOR_DDL = "key long, spread long, row long, at int, kind byte"


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _emit_anchors(symbols: str, width: int, gram: int) -> Callable:
    """key: the anchor's hash, for KNOWN rows another one that spreads them; hash = key ^ spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, told = Seen(), Seen()
        for batch in batches:
            rows = _longs(batch.column(0))
            for first_text, part in chunks(_texts(batch.column(1))):
                chunk = SYMBOLS[symbols](part)
                a = anchors_of(chunk, width, gram)
                if not len(a.at):
                    continue
                row = rows[first_text + a.doc]
                distinct, first, inverse, count = np.unique(a.hash, return_index=True, return_inverse=True, return_counts=True)
                old, said = seen.has(distinct), told.has(distinct)
                again = old | (count > 1)
                kind = np.where(again[inverse], KNOWN, PLAIN).astype(np.int8)
                kind[first[again & ~said]] = TELLS
                seen.add(distinct[~old])
                told.add(distinct[again & ~said])
                key = np.where(kind == KNOWN, mix(a.hash + row.astype(np.uint64) * BASE + a.at.astype(np.uint64)), a.hash)
                at = (a.at - chunk.bounds[a.doc]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array((key ^ a.hash).view(np.int64)), pa.array(row), pa.array(at), pa.array(kind)], schema=ANCHOR)

    return run


REPEATED = pa.schema([("hash", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> those whose key stands twice, or that are known to repeat; one row is held over."""
    held: pa.RecordBatch | None = None
    told = False  # whether the held row's key stands before it

    def marked(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
        nonlocal told
        key, spread, kind = (_longs(rows.column(i)) for i in (0, 1, 4))
        same = (key[1:] == key[:-1]) & (kind[1:] != KNOWN) & (kind[:-1] != KNOWN)
        before, after = np.concatenate([[told], same]), np.concatenate([same, [False]])
        told = bool(before[-1])
        use = np.flatnonzero((before | after | (kind != PLAIN))[:n])
        return pa.RecordBatch.from_arrays([pa.array((key ^ spread)[use]), rows.column(2).take(pa.array(use)), rows.column(3).take(pa.array(use))], schema=REPEATED)

    for batch in batches:
        if batch.num_rows:
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            yield marked(rows, rows.num_rows - 1)
            held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield marked(held, 1)


CONTEXT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("kind", pa.int8()), ("lead", pa.int32()), ("context", pa.binary())])
CONTEXT_DDL = "key long, doc long, row long, start int, kind byte, lead int, context binary"


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), then the same from first[1], and so on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)


def _contexts(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CONTEXT)], schema=CONTEXT)


def _emit_contexts(symbols: str, width: int, gram: int) -> Callable:
    """Windows around repeated anchors; context is the raw bytes (byte symbols) or the window hashes (words), lead the
    number of symbols from the first window's start to the anchor.

    Windows of hot anchors come one by one.  The first of a window in this task, and each that is earlier in document
    order than all before, is PLAIN under the window's own key; the others are KNOWN, with the place of an earlier one as
    context, under keys of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leads: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            rows, docs = _longs(batch.column(0)), _longs(batch.column(1))
            repeated, hot = ([x.values.to_numpy().astype(np.int64) for x in batch.column(i)] for i in (3, 4))
            for first_text, part in chunks(_texts(batch.column(2))):
                chunk = SYMBOLS[symbols](part)
                a = anchors_of(chunk, width, gram)
                begin = chunk.bounds[:-1]
                wanted = np.concatenate([begin[k] + repeated[first_text + k] for k in range(len(part))])
                is_hot = np.isin(a.at, np.concatenate([begin[k] + hot[first_text + k] for k in range(len(part))]))
                use = np.flatnonzero(np.isin(a.at, wanted) & ~is_hot)
                blob = b"".join(part) if symbols == "bytes" else b""
                if len(use):
                    own, count = a.doc[use], a.last[use] - a.first[use] + 1
                    if symbols == "bytes":
                        context = [blob[s:e] for s, e in zip(a.first[use].tolist(), (a.last[use] + width).tolist())]
                    else:
                        s = _spread(a.first[use], count)
                        hashes, stops = run_hash(a.sums, s, s + width).tobytes(), (8 * np.cumsum(count)).tolist()
                        context = [hashes[x:y] for x, y in zip([0, *stops], stops)]
                    yield _contexts([a.hash[use].view(np.int64), docs[first_text + own], rows[first_text + own], a.first[use] - begin[own], np.full(len(use), PLAIN), a.at[use] - a.first[use], context])
                picked = np.flatnonzero(np.isin(a.at, wanted) & is_hot)
                if not len(picked):
                    continue
                count = a.last[picked] - a.first[picked] + 1
                s, own = _spread(a.first[picked], count), np.repeat(a.doc[picked], count)
                doc, row, h = docs[first_text + own], rows[first_text + own], run_hash(a.sums, s, s + width)
                order = np.lexsort((s, row, doc))
                own_key, spread_key = mix(h + U(1)), mix(h + row.astype(np.uint64) * BASE + s.astype(np.uint64))
                out: list[list] = [[] for _ in CONTEXT]
                for i in order.tolist():
                    token = blob[s[i] : s[i] + width] if symbols == "bytes" else h[i].tobytes()
                    place = (int(doc[i]), int(row[i]), int(s[i] - begin[own[i]]))
                    lead = leads.get(token)
                    if known := lead is not None and lead <= place:
                        key, context = spread_key[i], np.array(lead, np.int64).tobytes()
                    else:
                        key, context = own_key[i], token
                        leads[token] = place
                    for col, value in zip(out, (key.view(np.int64), *place, KNOWN if known else PLAIN, 0, context)):
                        col.append(value)
                if len(leads) > MOST_LEADS:
                    leads.clear()
                yield _contexts(out)

    return run


def keyed_texts(docs: DataFrame) -> DataFrame:
    """row, key (doc_id, null last), doc_id, text; the exchange of this frame by row is shared by both text passes."""
    return docs.select(row_hash().alias("row"), id_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _with_hot(rows: DataFrame, many: DataFrame, limit: int = 100_000, salts: int = 64) -> DataFrame:
    """rows with ``hot`` set for the listed hashes, without gathering a hash's rows in one task: a short list is sent to
    all tasks, a longer one is copied to every salt."""
    if many.count() <= limit:
        return rows.join(F.broadcast(many), "hash", "left")
    salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(salts)).cast("int")).join(salted, ["hash", "salt"], "left").drop("salt")


def repeated_contexts(docs: DataFrame, symbols: str, width: int, gram: int, hot: int = HOT) -> DataFrame:
    """Rows of CONTEXT for all anchors that occur more than once, dealt by key to shards (steps 1 and 2)."""
    rows = keyed_texts(docs)
    found = rows.select("row", "text").mapInArrow(_emit_anchors(symbols, width, gram), ANCHOR_DDL)
    by_key = found.repartition("key").sortWithinPartitions("key", F.col("kind").desc())
    twice = materialize(by_key.mapInArrow(_repeated, "hash long, row long, at int"), "anchors")
    n = twice.count()
    many = materialize(twice.groupBy("hash").count().where(F.col("count") > hot).select("hash", F.lit(True).alias("hot")), "hot", n // max(1, hot))
    per_row = _with_hot(twice, many).groupBy("row").agg(F.collect_set("at").alias("at"), F.collect_set(F.when(F.col("hot"), F.col("at"))).alias("hot"))
    held = rows.join(per_row, "row").select("row", "key", "text", "at", "hot", "doc_id")  # doc_id: for the shared exchange
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n // SHARD)
    return held.mapInArrow(_emit_contexts(symbols, width, gram), CONTEXT_DDL).repartition(shards, "key")


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """key, doc_id, text and the array of its runs (null without any) for every document; a run also says its ``doc``, for
    documents whose row hashes are equal by chance."""
    rows = keyed_texts(docs)
    fields = [c for c in runs.columns if c != "row"]
    gathered = runs.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("runs"))
    return rows.join(gathered, "row", "left").select("key", "doc_id", "text", "runs")


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open runs as maximal disjoint runs, in order."""
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
