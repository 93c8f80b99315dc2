"""Operator 2: language-model scoring by a subword lattice.

The pieces of an existing subword vocabulary with their log weights span a lattice over each word: every way of cutting the
word into pieces is a path, and the sum over all paths - a forward recursion in log space - is the word's probability.  A
text's score adds the log10 probabilities of its words and of one end symbol.

Only byte-pair vocabularies are at hand, whose scores are merge ranks (-1, -2, ...) and no probabilities, and a fixed
vocabulary learns nothing from the training rows.  So the ranks become first weights 1 / (10 + rank); ``vocabulary_score`` is
the likelihood under these alone, and ``score`` that after one round of expectation-maximisation over all training tokens.

Scale: tokens are counted in one aggregation (pre-aggregated in batches), and each distinct token's lattice is computed once,
in that table.  Expectation adds one vector over the vocabulary per task.  Counts and scores of the commonest tokens (at
most ``FREQUENT``, none longer than ``LONGEST`` bytes) travel to the tasks, a bounded table that covers most tokens; all
others are joined on the token, in rows that carry a document's id and a count, never text.

Defined results: null text counts as empty (only the end symbol); a null doc_id is in fold 0; every row is scored by itself,
also where ids or whole rows repeat; with no training rows all counts are 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fold, materialize, row_hash, small, texts
from chalkline.llm.repeats import BASE, BYTE_VALUE, U, mix, prefix, run_hash

FREQUENT, LONGEST, HELD_OUT, END = 65_536, 256, 1, b""
SPACE = "▁".encode()
VOCABULARY = "piece_bpe_32k.model"
SLICE = 1 << 17  # bytes of words whose lattices are computed together
LONG = 1 << 12  # words from this length on are walked place by place, in blocks of arcs
BLOCK = 1 << 14


@cache
def vocabulary(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Piece surfaces (pieces and single bytes; last the end symbol) and log weights from their ranks."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        surface = bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.encode()
        weight[surface] = weight.get(surface, 0.0) + 1.0 / (10.0 - model.get_score(i))
    for b in range(256):
        weight.setdefault(bytes([b]), 1e-6)
    surfaces = [*weight, END]
    values = np.array([*weight.values(), max(weight.values())])
    return surfaces, np.log(values / values.sum())


class Lattice:
    """Forward (and backward) sums over all segmentations of words, for many words at once."""

    def __init__(self, surfaces: list[bytes], logs: np.ndarray) -> None:
        self.end = float(logs[-1])
        pieces = surfaces[:-1]
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        sums = prefix(BYTE_VALUE[joined])
        keys = run_hash(sums, ends - [len(p) for p in pieces], ends)
        self.longest = max(map(len, pieces))
        bits = 19
        self.shift = U(64 - bits)
        self.table_key = np.zeros((1 << bits) + 64, np.uint64)
        self.table_piece = np.full((1 << bits) + 64, -1, np.int32)
        for piece, (key, slot) in enumerate(zip(keys, ((keys * BASE) >> self.shift).tolist())):
            while self.table_piece[slot] >= 0:
                slot += 1
            self.table_key[slot], self.table_piece[slot] = key, piece
        run, self.reach = 0, 0
        for used in self.table_piece >= 0:
            run = run + 1 if used else 0
            self.reach = max(self.reach, run)
        self.lengths = sorted({len(p) for p in pieces})
        self.piece_logs = np.append(logs[:-1], -np.inf)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        slot = ((keys * BASE) >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.reach + 1):
            piece = self.table_piece[slot[todo]]
            hit = (piece >= 0) & (self.table_key[slot[todo]] == keys[todo])
            out[todo[hit]] = piece[hit]
            todo = todo[(piece >= 0) & ~hit]
            if not len(todo):
                break
            slot[todo] += 1
        return out

    def _arcs(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Words marked with the space piece, as one array: begin and end of each, and arcs (from, to, piece)."""
        marked = [SPACE + w for w in words]
        data = np.frombuffer(b"".join(marked), np.uint8)
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        end = np.cumsum(size)
        begin = end - size
        sums = prefix(BYTE_VALUE[data])
        stop = np.repeat(end, size)
        place = np.arange(len(data))
        froms, tos, which = [], [], []
        for n in self.lengths:
            s = place[place + n <= stop]
            piece = self.find(run_hash(sums, s, s + n))
            s, piece = s[piece >= 0], piece[piece >= 0]
            froms.append(s)
            tos.append(s + n)
            which.append(piece)
        return size, begin, np.concatenate(froms), np.concatenate(tos), np.concatenate(which)

    def _sweep(self, size: np.ndarray, begin: np.ndarray, source: np.ndarray, target: np.ndarray, logs: np.ndarray, total: int, backward: bool) -> np.ndarray:
        """Log sums of all paths from the word's start to each place (or from each place to its end).

        Places of a word are numbered begin + word number + offset, so neighbours do not share one.  Arcs are taken in
        order of the offset they end at, all words at once.
        """
        alpha = np.full(total, -np.inf)
        alpha[begin + (size if backward else 0)] = 0.0
        step = (size[self._word_of] - (source - begin[self._word_of])) if backward else target - begin[self._word_of]
        order = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[order], np.arange(1, (size.max() if len(size) else 0) + 2))
        into, out_of = (source, target) if backward else (target, source)
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            idx = order[a:b]
            spot = into[idx]
            by = np.argsort(spot, kind="stable")
            idx, spot = idx[by], spot[by]
            value = alpha[out_of[idx]] + logs[idx]
            first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
            top = np.maximum.reduceat(value, first)
            top = np.where(np.isfinite(top), top, 0.0)
            counts = np.diff(np.append(first, len(spot)))
            total_ = np.add.reduceat(np.exp(value - np.repeat(top, counts)), first)
            with np.errstate(divide="ignore"):
                alpha[spot[first]] = np.log(total_) + top
        return alpha

    def _run(self, words: list[bytes], both: bool):
        size, begin, source, target, piece = self._arcs(words)
        self._word_of = np.searchsorted(begin, source, side="right") - 1
        source, target, begin = source + self._word_of, target + self._word_of, begin + np.arange(len(begin))
        logs = self.piece_logs[piece]
        total = int(size.sum()) + len(size)
        alpha = self._sweep(size, begin, source, target, logs, total, False)
        score = alpha[begin + size]
        if not both:
            return score, None, None
        beta = self._sweep(size, begin, source, target, logs, total, True)
        return score, piece, np.exp(alpha[source] + logs + beta[target] - score[self._word_of])

    def _long_arcs(self, sums: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from, to, piece) that start in the block of places from ``begin`` on, in order of their start."""
        place = np.arange(begin, min(begin + BLOCK, len(sums) - 1))
        found = []
        for n in self.lengths:
            s = place[place + n < len(sums)]
            piece = self.find(run_hash(sums, s, s + n))
            found.append((s[piece >= 0], s[piece >= 0] + n, piece[piece >= 0]))
        source, target, piece = map(np.concatenate, zip(*found))
        by = np.argsort(source, kind="stable")
        return source[by], target[by], piece[by]

    def _long(self, word: bytes, use: np.ndarray | None = None, weight: float = 0.0) -> float:
        """The same sums for one long word in bounded arrays; adds its pieces' expected uses, times weight, to ``use``."""
        sums = prefix(BYTE_VALUE[np.frombuffer(SPACE + word, np.uint8)])
        n = len(sums) - 1

        def walk(blocks: list[int], backward: bool) -> list[float]:
            reach = [-math.inf] * (n + 1)
            reach[n if backward else 0] = 0.0
            for begin in blocks:
                source, target, piece = self._long_arcs(sums, begin)
                arcs = zip(source.tolist(), target.tolist(), self.piece_logs[piece].tolist())
                for s, t, log in reversed(list(arcs)) if backward else arcs:
                    old, new = (reach[s], reach[t] + log) if backward else (reach[t], reach[s] + log)
                    high, low = (old, new) if old > new else (new, old)
                    reach[s if backward else t] = high if low == -math.inf else high + math.log1p(math.exp(low - high))
            return reach

        blocks = list(range(0, n, BLOCK))
        alpha = walk(blocks, False)
        if use is not None:
            ahead, behind = np.array(alpha), np.array(walk(blocks[::-1], True))
            for begin in blocks:
                source, target, piece = self._long_arcs(sums, begin)
                use += weight * np.bincount(piece, np.exp(ahead[source] + self.piece_logs[piece] + behind[target] - alpha[n]), len(use))
        return alpha[n]

    def _slices(self, words: list[bytes]) -> tuple[list[int], list[list[int]]]:
        """Numbers of the long words, and of the others in slices of similar words of at most SLICE bytes."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        slices, size = [], SLICE
        while order and len(words[order[-1]]) >= LONG:
            slices.append(order.pop())
        long, slices = slices, []
        for i in order:
            if size + len(words[i]) + len(SPACE) > SLICE:
                slices.append([])
                size = 0
            slices[-1].append(i)
            size += len(words[i]) + len(SPACE)
        return long, slices

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        long, slices = self._slices(words)
        for i in long:
            out[i] = self._long(words[i])
        for part in slices:
            out[part] = self._run([words[i] for i in part], False)[0]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece over the weighted words."""
        out = np.zeros(len(self.piece_logs) - 1)
        long, slices = self._slices(words)
        for i in long:
            self._long(words[i], out, weights[i])
        for part in slices:
            _, piece, share = self._run([words[i] for i in part], True)
            out += np.bincount(piece, share * weights[part][self._word_of], len(out))
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens with their training counts, a batch at a time; held-out rows count 0; the end symbol is the empty token."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
        counts.clear()
        return out

    for batch in small(batches):
        for held_out, raw in zip(batch.column(0).to_pylist(), texts(batch)):
            tokens = raw.lower().split()
            if not held_out:
                counts.update(tokens)
                counts[END] += 1
            else:
                for token in tokens:
                    counts.setdefault(token, 0)
                counts.setdefault(END, 0)
        if len(counts) >= 300_000:
            yield flush()
    if counts:
        yield flush()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) for every token of docs; c counts it in the rows outside the held-out fold."""
    rows = docs.select((fold(5) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def learn(counts: DataFrame, smooth: float = 0.1) -> np.ndarray:
    """Log probability of each vocabulary piece (last: the end) after one expectation round over all counts."""
    surfaces, _ = vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*vocabulary()), np.zeros(len(surfaces) - 1)
        for batch in batches:
            total += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    found = counts.where((F.length("token") > 0) & (F.col("c") > 0)).mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    ends = counts.where(F.length("token") == 0).agg(F.sum("c")).first()[0] or 0
    values = np.full(len(surfaces), smooth)
    for row in sorted(found):
        values[row.piece] += row.n
    values[-1] += ends
    return np.log(values / values.sum())


def scored_tokens(counts: DataFrame, logs: np.ndarray) -> DataFrame:
    """counts with log10 probabilities: score under ``logs``, given under the vocabulary's own weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces, start = vocabulary()
        made = [Lattice(surfaces, x) for x in (logs, start)]
        for batch in batches:
            tokens = batch.column(0).to_pylist()
            scores = [np.where([not t for t in tokens], lattice.end, lattice.scores(tokens)) / math.log(10) for lattice in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scores)], names=["token", "c", "score", "given"])

    return counts.mapInArrow(run, "token binary, c long, score double, given double")


def _band() -> Column:
    """Counts in bands of a sixteenth of a doubling, at most about a thousand at any size; tokens not seen in training, or
    too long to be sent around, are below all."""
    return F.when((F.col("c") > 0) & (F.length("token") <= LONGEST), F.floor(F.log2("c") * 16)).otherwise(-1)


def frequent_from(counts: DataFrame, most: int) -> int:
    """The lowest band from which on at most ``most`` tokens are that frequent; only band sizes reach the driver."""
    total, bound = 0, None
    for row in sorted(counts.groupBy(_band().alias("band")).count().where("band >= 0").collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        bound = row.band
    return 1 << 20 if bound is None else bound


BAG = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("token", pa.binary()), ("tf", pa.int64()), ("docs", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("given", pa.float64())])
BAG_DDL = "doc_id long, row long, held_out boolean, token binary, tf long, docs long, n_tokens long, n_known long, base double, score double, given double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score of every document.

    A document's rows are gathered under its id and a hash of its text; rows equal in both have equal results and are told
    apart again by their number.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(docs), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens = materialize(scored_tokens(counts, learn(counts)), "tokens")
    floor = total + 0.5 * (distinct + 1)
    bound = frequent_from(counts, FREQUENT)
    known = {bytes(r.token): (math.log10((r.c + 0.5) / floor), r.score, r.given) for r in tokens.where(_band() >= bound).collect()}
    sent = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in small(batches):
            rare: list[tuple] = []
            main: list[tuple] = []
            for i, (doc_id, row, held_out, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), texts(batch))):
                bag = Counter(raw.lower().split())
                bag[END] += 1
                n, hits, base, score, given = 0, 0, 0.0, 0.0, 0.0
                for token, tf in bag.items():
                    n += tf
                    value = known.get(token)
                    if value is None:
                        rare.append((doc_id, row, held_out, token, tf))
                    else:
                        hits += tf
                        base += tf * value[0]
                        score += tf * value[1]
                        given += tf * value[2]
                main.append((doc_id, row, held_out, b" %d %d" % (row, i), 0, 1, n, hits, base, score, given))  # a blank is in no token
            if rare:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rare), BAG)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.zeros(len(rare)), f.type) for f in list(BAG)[5:])], schema=BAG)
            if main:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*main), BAG)], schema=BAG)

    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row"), (fold(5) == HELD_OUT).alias("held_out"), "text").mapInArrow(run, BAG_DDL)
    rest = tokens.where(_band() < bound).select("token", F.col("c").alias("of"), F.col("score").alias("its_score"), F.col("given").alias("its_given"))
    tf = F.col("tf")
    plus = lambda name, value: (F.col(name) + F.coalesce(value, F.lit(0))).alias(name)
    joined = bags.join(rest, "token", "left").select(
        "doc_id", "row", "held_out", "docs", "n_tokens", plus("n_known", F.when(F.col("of") > 0, tf)), plus("base", tf * F.log10((F.col("of") + 0.5) / F.lit(floor))),
        plus("score", tf * F.col("its_score")), plus("given", tf * F.col("its_given")),
    )
    summed = joined.groupBy("doc_id", "row", "held_out").agg(*[F.sum(c).alias(c) for c in ("docs", "n_tokens", "n_known", "base", "score", "given")])
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "docs")))
    per = lambda name: (F.col(name) / F.col("docs"))
    return each.select("doc_id", "held_out", per("n_tokens").cast("long").alias("n_tokens"), per("n_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), per("base").alias("base_score"), per("score").alias("score"), per("given").alias("vocabulary_score"))
