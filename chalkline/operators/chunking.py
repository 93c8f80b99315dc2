"""Chunking: ordered sequence operators over sentences, units and chunks."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce
from itertools import islice
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from chalkline.operators.ordered import walk_groups

# Phrases that announce a change of topic, one pattern an entry.
STRONG = (
    r"\bnext (?:chapter|topic|concept|section|question)\b",
    r"\bthe next (?:chapter|topic|concept|section|question)\b",
    r"\bstart (?:the )?(?:next )?chapter\b",
    r"\bbegin (?:the )?(?:next )?chapter\b",
    r"\bchapter (?:number )?\d+\b",
    r"\bnew (?:chapter|topic|concept|section)\b",
    r"\bmove on to (?:the )?(?:next )?(?:chapter|topic|concept|section)\b",
    r"\blet'?s move on to (?:the )?next (?:thing|one|question)\b",
    r"\bmove on to (?:the )?next (?:thing|one|question)\b",
    r"\blet'?s look at (?:the )?next question\b",
    r"\blet'?s go to (?:the )?next question\b",
)
SOFT = (
    r"\blet'?s move on\b",
    r"\bmove on to\b",
    r"\bmoving on\b",
    r"\blet'?s talk about\b",
    r"\blet'?s discuss\b",
    r"\blet'?s look at\b",
    r"\bnext one\b",
    r"\bnext thing\b",
    r"\bnow (?:we can|we will|let'?s) move\b",
    r"\bnow (?:we can|we will|let'?s) (?:talk|discuss|look)\b",
)
NEEDED = ("next", "chapter", "new ", "mov", "let", "now ")  # every phrase above has one of these
HEAD = 220


def transition(sentence: Column, strong: tuple[str, ...] = STRONG, soft: tuple[str, ...] = SOFT) -> Column:
    """strong, soft or null by the first characters of a sentence."""
    head = F.lower(F.substring(sentence, 1, HEAD))
    found = F.when(head.rlike("|".join(strong)), "strong").when(head.rlike("|".join(soft)), "soft")
    if (strong, soft) != (STRONG, SOFT):
        return found
    return F.when(reduce(or_, (head.contains(w) for w in NEEDED)), found)  # most sentences have none, which no pattern must tell


def split_hard(sentences: DataFrame, longest: int = 42) -> DataFrame:
    """Sentences cut into pieces of at most ``longest`` words: adds piece_no, piece."""
    starts = F.sequence(F.lit(0), F.expr(f"(greatest(size(words), 1) - 1) div {longest}"))
    cut = sentences.select("*", F.explode(starts).alias("piece_no"))
    return cut.withColumn("piece", F.array_join(F.slice("words", F.col("piece_no") * longest + 1, longest), " "))


# Words and pairs of words before which a spoken sentence may be cut.
MARKERS = ("but", "however", "whereas", "therefore", "because", "although", "though", "meanwhile", "finally", "next", "now", "so", "if", "when", "while", "then")
PAIRS = ("for example", "for instance", "on the", "in this", "we can", "we have", "we now", "let us")


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, though ``use`` reads it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_EDGES = re.compile("^[^a-z0-9]+|[^a-z0-9]+$")


def _cuts(words: list[str], longest: int, window: int, least: int) -> list[int]:
    """Where the pieces of a sentence begin; only words near a limit are looked at."""
    bare = lambda i: _EDGES.sub("", words[i].lower())
    marked = lambda i: bare(i) in MARKERS or (i > 0 and f"{bare(i - 1)} {bare(i)}" in PAIRS)
    cuts = [0]
    while len(words) - cuts[-1] > longest:
        limit = cuts[-1] + longest
        cuts.append(next((i for i in range(limit, max(cuts[-1] + least, limit - window) - 1, -1) if marked(i)), limit))
    return cuts


def split_long(sentences: DataFrame, longest: int = 42, window: int = 12, least: int = 12) -> DataFrame:
    """doc_id, pos, piece_no, piece: sentences of more than ``longest`` words cut before the last discourse marker of the
    ``window`` words before the limit, else at the limit.  One walk over a sentence; blank ones (no words) fall out."""
    rows = sentences.select("doc_id", "pos", "words")
    schema = StructType([*rows.drop("words").schema, StructField("piece_no", IntegerType()), StructField("piece", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch, picked, numbers, pieces = whole.slice(start, 500), [], [], []
                for row, words in enumerate(batch.column(2).to_pylist()):
                    cuts = _cuts(words, longest, window, least) if words else []
                    for number, (at, to) in enumerate(zip(cuts, [*cuts[1:], None])):
                        picked.append(row)
                        numbers.append(number)
                        pieces.append(" ".join(words[at:to]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(picked, pa.int32())) for i in (0, 1)), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def split_numbered(sentences: DataFrame, longest: int = 42, window: int = 12, least: int = 12) -> DataFrame:
    """doc_id, pos, sentence: the pieces of ``split_long``, numbered through each document, whose sentences (doc_id, sentence: words
    with single blanks) lie one after the other, as an explode leaves them.  No shuffle, and no words of what is short enough."""
    kind = sentences.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, number = None, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch, picked, numbers, pieces = whole.slice(start, 1000), [], [], []
                for row, (of, sentence) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                    if of != doc:
                        doc, number = of, 0
                    if sentence.count(" ") < longest:
                        made = [sentence]
                    else:
                        words = sentence.split(" ")
                        cuts = _cuts(words, longest, window, least)
                        made = [" ".join(words[at:to]) for at, to in zip(cuts, [*cuts[1:], None])]
                    pieces += made
                    picked += [row] * len(made)
                    numbers += range(number, number + len(made))
                    number += len(made)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(picked, pa.int32())), pa.array(numbers, pa.int32()), pa.array(pieces, pa.string())], names=["doc_id", "pos", "sentence"])

    return sentences.select("doc_id", "sentence").mapInArrow(run, StructType([kind, StructField("pos", IntegerType()), StructField("sentence", StringType())]))


def unit_walk(least: int = 60, tail: int = 30) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """The walk of ``units``: (pos, n_words, transition) of a document in order -> unit_no, first_pos, last_pos, n_words, transition."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        number, before, now = 0, None, None
        for pos, n_words, t in rows:
            if now is None or t is not None or now[2] >= least:
                if before is not None:
                    yield (number, *before)
                    number += 1
                before, now = now, [pos, pos, n_words, t]
            else:
                now[1], now[2] = pos, now[2] + n_words
        if before is not None and now[2] < tail and now[3] is None:
            before[1], before[2], now = now[1], before[2] + now[2], None
        for last in (before, now):
            if last is not None:
                yield (number, *last)
                number += 1

    return walk


def units(sentences: DataFrame, least: int = 60, tail: int = 30) -> DataFrame:
    """doc_id, unit_no, first_pos, last_pos, n_words, transition: runs of sentences of at least ``least`` words.

    A sentence with a transition starts a new unit; a short last unit without one joins the unit before.  One walk over
    a document's sentences in order, which holds two units.
    """
    made = StructType([StructField(c, IntegerType()) for c in ("unit_no", "first_pos", "last_pos", "n_words")]).add("transition", StringType())
    rows = sentences.select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("n_words").cast("int").alias("n_words"), transition(F.col("sentence")).alias("t"))
    return walk_groups(rows, ["doc_id"], ["pos"], ["pos", "n_words", "t"], made, unit_walk(least, tail))


def rounded(value: Column | str, digits: int) -> Column:
    """round as engines on binary doubles have it: half away from zero of the scaled value, where Spark's own rounds the
    shortest decimal (0.31625, whose scaled value is under 3162.5, to 0.3163)."""
    scale = F.lit(10.0**digits)
    return F.round((F.col(value) if isinstance(value, str) else value) * scale, 0) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def neighbour_similarity(vectors: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """vectors with ``similarity`` to the one before in the group (null for the first)."""
    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    return vectors.withColumn("_before", before).withColumn("similarity", F.when(F.col("_before").isNotNull(), dot(F.col("_before"), F.col(vector)))).drop("_before")


def thresholds(similarities: DataFrame, group: str, share: float = 0.15, low: float = 0.10, high: float = 0.45) -> DataFrame:
    """group, threshold: a low percentile of the group's similarities, clamped; ``high`` where there are none."""
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), F.percentile("similarity", F.lit(share))))
    return similarities.groupBy(group).agg(F.coalesce(F.bround(clamped, 4), F.lit(high)).alias("threshold"))


def boundaries(units: DataFrame, soft_cap: float = 0.35, soft_slack: float = 0.10) -> DataFrame:
    """units (similarity to the unit before, threshold, transition) with reason and strength of the boundary before them,
    both null where there is none: a shift of meaning, an announced transition (a soft one only with little similarity),
    or both."""
    shift = F.coalesce(F.col("similarity") <= F.col("threshold"), F.lit(False))
    soft = F.coalesce((F.col("transition") == "soft") & (F.col("similarity") <= F.least(F.lit(soft_cap), F.col("threshold") + soft_slack)), F.lit(False))
    announced = F.col("similarity").isNotNull() & (F.coalesce(F.col("transition") == "strong", F.lit(False)) | soft)
    reason = F.when(shift & announced, "semantic_shift+transition_phrase").when(announced, "transition_phrase").when(shift, "semantic_shift")
    return units.withColumn("reason", reason).withColumn("strength", F.when(announced, F.col("transition")))


def threshold(similarities: Sequence[float], share: float = 0.15, low: float = 0.10, high: float = 0.45) -> float:
    """thresholds of one group: (n - 1) * share between the ordered values, clamped, half to even at four digits."""
    if not similarities:
        return high
    values, at = sorted(similarities), (len(similarities) - 1) * share
    below, above = math.floor(at), math.ceil(at)
    value = values[below] if below == above or values[below] == values[above] else (above - at) * values[below] + (at - below) * values[above]
    return float(Decimal(repr(max(low, min(high, value)))).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))


def boundary(similarity: float | None, limit: float, transition: str | None, soft_cap: float = 0.35, soft_slack: float = 0.10) -> tuple[str | None, str | None]:
    """reason and strength that ``boundaries`` gives a unit."""
    if similarity is None:
        return None, None
    shift = similarity <= limit
    announced = transition == "strong" or (transition == "soft" and similarity <= min(soft_cap, limit + soft_slack))
    reason = "semantic_shift+transition_phrase" if shift and announced else "transition_phrase" if announced else "semantic_shift" if shift else None
    return reason, transition if announced else None


def plan_walk(most: int = 550, least: int = 150, least_strong: int = 80, target: int = 350, size_weight: float = 0.12, strong_bonus: float = 0.10, soft_bonus: float = 0.04) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """The walk of ``plan``: (n_words, similarity, reason, strength) of a document's units in order -> plan_no, first_unit,
    last_unit, n_words, reason, similarity."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        ahead, words, ended, first, number = deque(), 0, False, 0, 0
        while True:
            while not ended and (words <= most + least or len(ahead) < 2):
                row = next(rows, None)
                ended = row is None
                if not ended:
                    ahead.append(row)
                    words += row[0]
            if not ahead:
                return
            best, roomy, size, end = None, None, ahead[0][0], 0
            for n_words, similarity, why, how in islice(ahead, 1, None):  # the boundary before this unit, after ``size`` words
                if size > most:
                    break
                after = words - size
                if after >= least:
                    roomy = end
                if why is not None and size >= (least_strong if how == "strong" else least) and not 0 < after < least:
                    cost = similarity + size_weight * abs(size - target) / target - {"strong": strong_bonus, "soft": soft_bonus}.get(how, 0.0)
                    if best is None or cost < best[0]:
                        best = (cost, end, why)
                size, end = size + n_words, end + 1
            if best is not None:
                last, why = best[1:]
            elif ended and words <= most:
                last, why = len(ahead) - 1, "end_of_transcript"
            else:
                last, why = roomy or 0, "max_size"
            taken = sum(ahead.popleft()[0] for _ in range(last + 1))
            yield number, first, first + last, taken, why, ahead[0][1] if ahead else None
            words, first, number = words - taken, first + last + 1, number + 1

    return walk


def plan(units: DataFrame, most: int = 550, least: int = 150, least_strong: int = 80, target: int = 350, size_weight: float = 0.12, strong_bonus: float = 0.10, soft_bonus: float = 0.04) -> DataFrame:
    """doc_id, plan_no, first_unit, last_unit, n_words, reason, similarity: chunk ends at the cheapest allowed boundary.

    units: doc_id, unit_no, n_words, and similarity, reason and strength of the boundary before the unit.  One walk over a
    document's units in order, which holds those of the next ``most + least`` words: what lies behind them decides nothing.
    """
    made = StructType([StructField(c, IntegerType()) for c in ("plan_no", "first_unit", "last_unit", "n_words")]).add("reason", StringType()).add("similarity", DoubleType())
    rows = units.select("doc_id", "unit_no", F.col("n_words").cast("int").alias("n_words"), F.col("similarity").cast("double").alias("similarity"), "reason", "strength")
    return walk_groups(rows, ["doc_id"], ["unit_no"], ["n_words", "similarity", "reason", "strength"], made, plan_walk(most, least, least_strong, target, size_weight, strong_bonus, soft_bonus))


def materialise(plans: DataFrame, sentences: DataFrame, overlap_sentences: int = 2) -> DataFrame:
    """plans (doc_id, chunk_id, first_pos, last_pos, reason) with text, n_words and the overlap taken from before a
    forced cut."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    forced = F.coalesce(F.lag("reason").over(order) == "max_size", F.lit(False))
    begin = F.when(forced, F.greatest(F.lit(0), F.col("first_pos") - overlap_sentences)).otherwise(F.col("first_pos"))
    ranged = plans.withColumn("from_pos", begin)
    wide = ranged.select("*", F.explode(F.sequence("from_pos", "last_pos")).alias("pos"))
    told = wide.join(sentences.select("doc_id", "pos", "sentence", F.col("n_words").alias("w")), ["doc_id", "pos"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return told.groupBy("doc_id", "chunk_id").agg(text.alias("text"), F.sum("w").alias("n_words"), F.sum(F.when(F.col("pos") < F.col("first_pos"), F.col("w")).otherwise(0)).alias("overlap_words"))


def segments(chunks: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_id, reason) with segment number, place in it, root chunk and continuation flag: a chunk
    continues the one before when that was cut only for its size."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    continues = F.coalesce(F.lag("reason").over(order) == "max_size", F.lit(False))
    marked = chunks.withColumn("is_continuation", continues)
    numbered = marked.withColumn("segment", F.sum(F.when(F.col("is_continuation"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "segment")
    place = F.row_number().over(inside.orderBy("chunk_id"))
    size = F.count("*").over(inside)
    position = F.when(size == 1, "single").when(place == 1, "start").when(place == size, "end").otherwise("middle")
    return numbered.select("*", place.alias("segment_index"), size.alias("segment_size"), F.min("chunk_id").over(inside).alias("root_chunk"), position.alias("position"))


def metrics(chunks: DataFrame) -> DataFrame:
    """Per document: number of chunks, least, mean and most words, words in all."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("n_words").alias("min_words"), F.avg("n_words").alias("mean_words"), F.max("n_words").alias("max_words"), F.sum("n_words").alias("words"))


def violations(chunks: DataFrame, most: int = 550) -> DataFrame:
    """Chunks (doc_id, chunk_id, first_pos, last_pos, n_words) that break contiguity or size limits, with the rule."""
    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    gap = F.coalesce(F.lag("last_pos").over(order), F.lit(-1)) + 1 != F.col("first_pos")
    rules = F.array_compact(F.array(F.when(gap, F.lit("gap")), F.when(F.col("n_words") > most, F.lit("too_long")), F.when(F.col("n_words") == 0, F.lit("empty"))))
    return chunks.withColumn("rules", rules).select("doc_id", "chunk_id", F.explode("rules").alias("rule"))
