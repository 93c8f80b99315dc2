"""Operator 6: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its hashed byte n-grams (3 to 5 bytes, with word edges).  Bags are averaged over segments of
``SEGMENT`` words (a word equal to the one before adds nothing; short bags are padded to ``MIN_GRAMS`` zero vectors) and go into a softmax with two outputs; embeddings and softmax are trained jointly in numpy.  Toxic
words are few in a text, so a text counts as its worst segment: in training, a toxic text learns from the segments
that score highest, a clean text from all of its segments.  Unseen misspellings share most n-grams with known words.

Training uses a bounded sample (``max_toxic`` and ``max_clean`` texts of at most ``max_chars`` characters, first by hash) of
labelled rows outside the held-out fold; scoring covers every document, in one scan without shuffle.  As softmax over an average is linear in
each n-gram, the model is sent to tasks as one logit per n-gram bucket (1 MB).

Defined results: null and blank texts score the model's prior for an empty bag, below the threshold; without labelled rows of both kinds every
score is 0; repeated rows are scored row by row; labels of repeated ids join each row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fold, map_rows, row_hash, small

BUCKET_BITS, DIM, SEGMENT, SIZES = 18, 8, 24, (3, 4, 5)
MIN_GRAMS = 150
THRESHOLD, HELD_OUT, TOXIC_WEIGHT = 0.7, 1, 2.0
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[32, *range(9, 14)]] = True


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram buckets, segment of each n-gram, text of each segment); every text has at least one segment."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = 1 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text_of = np.repeat(np.arange(len(texts)), lengths + 1)  # of the bytes after the first
    data = _LOWER[data]
    space = _BREAK[data]
    data = np.where(space, np.uint8(32), data)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    owner = text_of[starts - 1] if len(starts) else np.zeros(0, np.int64)
    first = np.searchsorted(owner, np.arange(len(texts)))
    within = (np.arange(len(starts)) - first[owner]) // SEGMENT if len(starts) else owner
    per_text = np.ones(len(texts), np.int64)
    np.maximum.at(per_text, owner, within + 1)
    base = np.concatenate([[0], np.cumsum(per_text)])
    word_segment = base[owner] + within
    word_of = np.cumsum(space[:-1] & ~space[1:])  # word number + 1 of each byte position after the first
    word_of = np.concatenate([[0], word_of]) - 1
    inner = np.cumsum(space)
    fresh = np.ones(len(data), bool)
    if len(starts) > 1:
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        place = np.arange(starts[0], len(data) - 1, dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data) - 1)))
        sums = np.add.reduceat(np.where(space[starts[0] : -1], 0, (data[starts[0] : -1].astype(np.int64) + 7) * (place * place + 31)), starts - starts[0])
        again = np.flatnonzero((sums[1:] == sums[:-1]) & (np.diff(starts) > 0) & ((ends - starts)[1:] == (ends - starts)[:-1]) & (owner[1:] == owner[:-1])) + 1
        for k in again.tolist():
            if np.array_equal(data[starts[k] : ends[k]], data[starts[k - 1] : ends[k - 1]]):
                fresh[starts[k] - 1 : ends[k]] = False
    grams, owners = [], []
    mixed = data.astype(np.uint32) + 1
    rolling = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        rolling = rolling[:m] * np.uint32(16777619) ^ mixed[n - 1 :]
        if n in SIZES:
            # a gram may touch the blank at either edge of one word, but holds no blank inside
            ok = (inner[n - 2 : m + n - 2] - inner[:m] == 0) & (n > 2)
            ok &= ~(space[:m] & space[n - 1 :])
            at = np.flatnonzero(ok & fresh[:m])
            h = rolling[at]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            grams.append(h >> np.uint32(32 - BUCKET_BITS))
            owners.append(word_segment[word_of[at + 1]])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.repeat(np.arange(len(texts)), per_text)
    return np.concatenate(grams).astype(np.int32), np.concatenate(owners).astype(np.int32), np.repeat(np.arange(len(texts)), per_text)


@dataclass
class Model:
    """One logit (toxic minus clean) per n-gram bucket, and a bias."""

    logits: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the worst segment of each text."""
        out = np.zeros(len(texts))
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            grams, owner, text = segments(texts[at:end])
            n = np.bincount(owner, minlength=len(text))
            z = np.bincount(owner, self.logits[grams], len(text)) / np.maximum(n, MIN_GRAMS) + self.bias
            worst = np.full(end - at, -np.inf)
            np.maximum.at(worst, text, z)
            out[at:end] = 1 / (1 + np.exp(-worst))
            at = end
        return out


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 7, rate: float = 2.0, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax by Adagrad on averaged bags; rounds after the first pick worst segments."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), -np.inf)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (1 << BUCKET_BITS, DIM)).astype(np.float32) / DIM
    soft, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32) / DIM, np.zeros(2, np.float32)
    g_table, g_soft = np.full(1 << BUCKET_BITS, 1e-6, np.float32), 1e-6
    parts = [segments([t]) for t in texts]
    shift = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])])
    grams = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + np.int32(k) for p, k in zip(parts, shift)])
    text = np.repeat(np.arange(len(texts)), np.diff(shift))
    by = np.argsort(owner, kind="stable").astype(np.int32)
    grams, owner = grams[by], owner[by]
    begin = np.searchsorted(owner, np.arange(len(text) + 1))
    size = np.diff(begin)
    y = labels[text]
    for epoch in range(epochs):
        flat = (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
        z = np.bincount(owner, flat[grams], len(text)) / np.maximum(size, MIN_GRAMS) + float(bias[1] - bias[0])
        worst = np.full(len(labels), -np.inf)
        np.maximum.at(worst, text, z)
        use = np.flatnonzero((size > 0) & ((y == 0) | (epoch < 2) | (z >= np.minimum(worst[text], 2.0))))
        weight = np.where(y == 1, min(TOXIC_WEIGHT, (y == 0).sum() / max(1, (y[use] == 1).sum())), 1.0)
        rng.shuffle(use)
        for part in np.array_split(use, max(1, len(use) // 256)):
            lens = size[part]
            idx = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            g = grams[idx]
            cut = np.concatenate([[0], np.cumsum(lens)[:-1]])
            bag = np.maximum(lens, MIN_GRAMS)[:, None]
            mean = np.add.reduceat(table[g], cut, axis=0) / bag
            out = mean @ soft + bias
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[part][:, None] / len(part)
            back = (p @ soft.T) / bag
            grad_soft = mean.T @ p
            g_soft += float((grad_soft**2).sum())
            soft -= (rate / 4 / np.sqrt(g_soft) * grad_soft).astype(np.float32)
            bias -= (rate / 4 * p.sum(0)).astype(np.float32)
            u, inv = np.unique(g, return_inverse=True)
            rows = np.repeat(back, lens, axis=0)
            grad = np.stack([np.bincount(inv, rows[:, k], len(u)) for k in range(DIM)], 1)
            g_table[u] += (grad**2).mean(1)
            table[u] -= (rate * 0.1 / np.sqrt(g_table[u])[:, None] * grad).astype(np.float32)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> tuple[list[bytes], np.ndarray]:
    """A bounded, deterministic sample of labelled rows outside the held-out fold: the first by hash of each kind."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(fold(3) != HELD_OUT).withColumn("h", F.xxhash64("doc_id"))
    picked = known.where("toxic = 1").orderBy("h", "doc_id").limit(max_toxic).union(known.where("toxic = 0").orderBy("h", "doc_id").limit(max_clean))
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text", row_hash().alias("row"))
    rows = short.join(F.broadcast(picked), "doc_id").orderBy("h", "doc_id", "row").limit(2 * (max_toxic + max_clean)).select("text", "toxic", "h").collect()
    rows.sort(key=lambda r: (r.h, r.text or ""))
    return [(r.text or "").encode() for r in rows], np.array([r.toxic for r in rows], np.int64)


RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def toxicity_model(docs: DataFrame, labels: DataFrame, max_toxic: int = 500, max_clean: int = 700, max_chars: int = 200_000) -> Model:
    return train(*labelled_sample(docs, labels, max_toxic, max_clean, max_chars))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= THRESHOLD) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            score = model.score([t or b"" for t in batch.column(2).cast(pa.large_binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(3) == HELD_OUT).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text scores below the threshold, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            score = model.score([t or b"" for t in batch.column(at).cast(pa.large_binary()).to_pylist()])
            yield batch.filter(pa.array(score < THRESHOLD))

    return map_rows(docs, run)
