"""Embeddings and vector search.  Vectors are unit length, so a dot product is a cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StructField, StructType

from chalkline.operators.chunking import dot, named, rounded
from chalkline.operators.held import cut

DIGITS = 6
ENCODED = 256  # texts that go to an encoder at once


def similarity(a: Column, b: Column) -> Column:
    """Cosine rounded to DIGITS, so that engines that add in another order agree."""
    return rounded(dot(a, b), DIGITS)


def half_away(scores: np.ndarray) -> np.ndarray:
    """scores to DIGITS as ``rounded`` has them: numpy's own rounds halves to even."""
    scaled = scores * 10.0**DIGITS
    return np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**DIGITS


def encode(texts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], text: str = "text") -> DataFrame:
    """Adds ``embedding`` from any batch encoder; blank texts get null.  The encoder is loaded once per task."""

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = []
            for start in range(0, len(batch), ENCODED):  # never more than so many texts are Python's own
                part = batch.slice(start, ENCODED).to_pylist()
                full = [t for t in part if t is not None and t.strip()]
                of = iter(encoder(full) if full else [])
                made.append(pa.array([list(next(of)) if t is not None and t.strip() else None for t in part], pa.list_(pa.float32())))
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float32()))

    return texts.withColumn("embedding", run(text))


def hash_encode(tokens: Column, width: int = 384, longest: int = 2) -> Column:
    """A model-free vector: counts of hashed 1..n-grams, unit length; native."""
    def runs(n: int) -> Column:
        last = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        made = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(last > 0, made).otherwise(F.array().cast("array<string>"))

    grams = F.concat(tokens, *map(runs, range(2, longest + 1)))
    slots = F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % width).cast("int"))
    counts = named(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return named(counts, lambda c: named(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def hashed_features(words: DataFrame, key: str, width: int = 384, longest: int = 2) -> DataFrame:
    """key, slot, value of the same encoding in sparse rows: (key, pos, word) -> counts by slot, unit length.

    This form scales with the text, not with the width.
    """
    ordered = Window.partitionBy(key).orderBy("pos")
    grams = words.select(key, F.col("word").alias("gram"))
    for n in range(2, longest + 1):
        after = [F.lead("word", k).over(ordered) for k in range(1, n)]
        grams = grams.union(words.select(key, F.when(after[-1].isNotNull(), F.concat_ws(" ", "word", *after)).alias("gram")).where("gram is not null"))
    slot = (F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long") % width).cast("int")
    counts = grams.groupBy(key, slot.alias("slot")).agg(F.count("*").alias("n"))
    return counts.select(key, "slot", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("value"))


def _slot(word: Column, width: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % width).cast("int")


def hashed_vectors(words: DataFrame, by: Sequence[str], width: int = 384) -> DataFrame:
    """by, at, embedding: unit vectors of hashed word counts, as the slots that are not 0 and their values."""
    counted = words.groupBy(*by, _slot(F.col("word"), width).alias("slot")).agg(F.count("*").alias("n"))
    listed = counted.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e["n"] * e["n"]))
    return listed.withColumn("norm", norm).select(*by, F.transform("x", lambda e: e["slot"]).alias("at"), F.transform("x", lambda e: e["n"] / F.col("norm")).alias("embedding"))


def hashed_scores(words: DataFrame, references: DataFrame, keys: Sequence[str], of: str, floor: float | None = None, wanted: DataFrame | None = None, width: int = 384) -> DataFrame:
    """keys, ``of``, semantic_score: cosine of the hashed word counts of texts (keys, word) and references (of, word).

    The pairs of at least ``floor``, by products of blocks (texts stream past the references), and those that are ``wanted``
    (keys, of; each once), whatever their score, each by one walk over its text's slots.  Both sides' vectors are written once.
    """
    ours, theirs = hashed_vectors(words, keys, width), cut(hashed_vectors(references, [of], width))
    ours, found = ours if floor is None or wanted is None else cut(ours), None
    if floor is not None:
        texts = ours.select(F.struct(*keys).alias("vec_id"), "at", "embedding")
        met = _meet(theirs.select(F.col(of).alias("query_id"), "at", "embedding"), texts, width=width, floor=floor)
        found = met.select(*[F.col("vec_id")[k].alias(k) for k in keys], F.col("query_id").alias(of), F.col("score").alias("semantic_score"))
    if wanted is None:
        return found
    entries = F.map_from_arrays("at", "embedding")
    dense = theirs.select(of, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0))).alias("dense"))
    few = F.broadcast(dense) if theirs.count() <= HELD_ROWS else dense
    pairs = wanted.select(*keys, of).join(ours, list(keys)).join(few, of)
    score = rounded(F.aggregate(F.zip_with("at", "embedding", lambda i, v: v * F.get("dense", i)), F.lit(0.0), lambda a, x: a + x), DIGITS)
    asked = pairs.select(*keys, of, score.alias("semantic_score"))
    return asked if found is None else asked.unionByName(found.join(wanted.select(*keys, of), [*keys, of], "left_anti"))


def norm_violations(vectors: DataFrame, width: int, tolerance: float = 1e-4) -> DataFrame:
    """vec_id and rule of vectors that are not unit length or not of the expected width."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rules = F.array_compact(F.array(F.when(F.abs(norm - 1) > tolerance, F.lit("norm")), F.when(F.size("embedding") != width, F.lit("width"))))
    return vectors.select("vec_id", F.explode(rules).alias("rule"))


def embedding_text(rows: DataFrame, budget: int) -> DataFrame:
    """Adds embed_text, n_tokens and truncated: header and question whole, as much context as the budget leaves.

    The budget counts blank-separated words.
    """
    base = F.concat_ws("\n", "header", "question")
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    context = F.filter(F.split(F.coalesce("context", F.lit("")), r"\s+"), lambda w: w != "")
    room = F.greatest(F.lit(0), F.lit(budget) - count(base))
    part = F.array_join(F.slice(context, 1, room), " ")
    text = F.when(part != "", F.concat_ws("\n", base, part)).otherwise(base)
    return rows.select("*", text.alias("embed_text"), (count(base) + F.least(room, F.size(context))).alias("n_tokens"), (F.size(context) > room).alias("truncated"))


def hash_key(*columns: str) -> Column:
    """SHA-256 of the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def index_decisions(rows: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """(id, text_hash) against (id, text_hash, model, status): what to embed again and why."""
    old = index.select("id", F.col("text_hash").alias("_hash"), F.col("model").alias("_model"), F.col("status").alias("_status"))
    missing = F.col("_hash").isNull()
    why = F.array_compact(F.array(
        F.when(missing, F.lit("new")), F.when(~missing & (F.col("_hash") != F.col("text_hash")), F.lit("text_changed")),
        F.when(~missing & (F.col("_model") != model), F.lit("model_changed")), F.when(~missing & (F.col("_status") == "failed"), F.lit("previous_failure")),
    ))
    return rows.join(old, "id", "left").select("id", why.alias("reasons")).withColumn("needs_index", F.size("reasons") > 0)


def stale(index: DataFrame, eligible: DataFrame) -> DataFrame:
    return index.join(eligible, "id", "left_anti")


def patch_payload(vectors: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New payload values of matching ids over the old ones; vectors and other rows untouched."""
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    merged = vectors.join(new, key, "left")
    return merged.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


LANE_ROWS = 50_000  # vectors of a group that one task sees
HELD_ROWS, SLICE = 5000, 1024  # a task holds a block of so many queries and multiplies it with so many vectors at once


def _meet(queries: DataFrame, vectors: DataFrame, width: int | None = None, k: int | None = None, floor: float | None = None, held_rows: int = HELD_ROWS, lane_rows: int | None = None, whole: bool = False) -> DataFrame:
    """query_id, vec_id, score: all pairs of queries (query_id) and vectors (vec_id), or of these the ``k`` best of a query in
    each lane, or those of at least ``floor``; both have ``embedding``, and ``at``, its slots, where it is sparse (``width``).

    Queries are cut into blocks of about ``held_rows``, and every block is sent to as many lanes as there are shuffle
    partitions; vectors are dealt to the lanes, once for each block.  A lane holds its block as a matrix, and its vectors
    stream past it.  Nothing passes the driver and the plan is the same for any number of queries.  With ``lane_rows`` only
    rows of equal ``group`` meet: each group has blocks by its queries and a lane for about so many of its vectors.  ``whole``:
    vec_id is a (chunk_id, unit_no), a chunk's units go to one lane, and of them a query gets the best, the first of equals.
    """
    if lane_rows is None:
        lanes = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(1, -(-queries.count() // held_rows))
        sized = lambda t: t.withColumns({"_blocks": F.lit(blocks), "_lanes": F.lit(lanes), "_group": F.lit(0)})
    else:
        cells = lambda t, rows, name: t.where("embedding is not null").groupBy(F.col("group").alias("_group")).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
        sizes = cells(queries, held_rows, "_blocks").join(cells(vectors, lane_rows, "_lanes"), "_group")
        sized = lambda t: t.join(sizes, t["group"] == sizes["_group"])
    ids = {c: t.schema[c].dataType for t, c in ((queries, "query_id"), (vectors, "vec_id"))}

    def side(t: DataFrame, kind: int, block: Column, lane: Column) -> DataFrame:
        at = F.col("at") if width else F.lit(None).cast("array<int>")
        cells = sized(t.where("embedding is not null")).select("*", F.explode(block).alias("_block")).select("*", F.explode(lane).alias("_lane"))
        own = [F.col(c) if c in t.columns else F.lit(None).cast(kind_of).alias(c) for c, kind_of in ids.items()]
        return cells.select(F.xxhash64("_group", "_block", "_lane").alias("cell"), F.lit(kind).alias("kind"), *own, at.alias("at"), F.col("embedding").cast("array<double>").alias("embedding"))

    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of = lambda c, n: F.array(F.pmod(F.xxhash64(c), F.col(n)).cast("int"))
    rows = side(queries, 0, of("query_id", "_blocks"), every("_lanes")).unionByName(side(vectors, 1, every("_blocks"), of("vec_id.chunk_id" if whole else "vec_id", "_lanes")))

    def matrix(at: pa.Array, values: pa.Array) -> np.ndarray:
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if width is None:
            return flat.reshape(len(values), -1)
        full = np.zeros((len(values), width))
        full[np.repeat(np.arange(len(values)), np.diff(values.offsets.to_numpy())), at.flatten().to_numpy(zero_copy_only=False)] = flat
        return full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked, best, over = None, [], [], None, None

        def give(q: np.ndarray, vec_ids: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([asked[0].take(pa.array(q)), vec_ids, pa.array(scores)], names=["query_id", "vec_id", "score"])

        def of_chunks(ids: pa.StructArray, values: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """The best unit of each chunk; the last chunk may go on in the next slice, so its units wait."""
            nonlocal over
            if over is not None:
                ids, values = pa.concat_arrays([over[0], ids]), np.concatenate([over[1], values])
            chunk = ids.field(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1])
            end = len(chunk) if last else starts[-1]
            over = None if last else (ids.slice(end), values[end:])
            if over is not None and len(over[0]) > 1:  # a waiting chunk keeps its best units only
                used, place = np.unique(over[1].argmax(axis=0), return_inverse=True)
                kept = np.where(place[None, :] == np.arange(len(used))[:, None], over[1][used], -np.inf)
                over = (over[0].take(pa.array(used)), kept)
            for a, b in zip(starts, [*starts[1:], len(chunk)]):
                if b > end:
                    break
                unit = values[a:b].argmax(axis=0)
                yield give(np.arange(values.shape[1]), ids.take(pa.array(a + unit)), values[a:b][unit, np.arange(values.shape[1])])

        def rest() -> Iterator[pa.RecordBatch]:
            if over is not None:
                yield from of_chunks(over[0].slice(0, 0), over[1][:0], True)
            if best is not None:
                q, v = np.nonzero(best[0] > -np.inf)
                yield give(q, best[1].take(pa.array(best[2][q, v])), best[0][q, v])

        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1), len(cells)]
            for start, end in zip(edges, edges[1:]):
                if cells[start] != cell:
                    yield from rest()
                    cell, held, asked, best, over = cells[start], [], [], None, None
                part = batch.slice(start, end - start)
                if kinds[start] == 0:
                    held.append(matrix(part.column(4), part.column(5)))
                    asked.append(part.column(2))
                    continue
                if not held:
                    continue
                if len(held) > 1 or len(asked) > 1:
                    held, asked = [np.concatenate(held)], [pa.concat_arrays(asked)]
                for at in range(0, part.num_rows, SLICE):
                    few = part.slice(at, SLICE)
                    scores = half_away(held[0] @ matrix(few.column(4), few.column(5)).T)
                    if whole:
                        yield from of_chunks(few.column(3), scores.T, False)
                        continue
                    if k is None:
                        q, v = np.nonzero(scores >= (-np.inf if floor is None else floor))
                        yield give(q, few.column(3).take(pa.array(v)), scores[q, v])
                        continue
                    # the k best so far and the new ones: ids of what stays are carried, ties go by id in the end and so all stay
                    known = pa.concat_arrays([best[1], few.column(3)]) if best is not None else few.column(3)
                    places = np.broadcast_to(np.arange(len(few)) + (len(best[1]) if best is not None else 0), scores.shape)
                    if best is not None:
                        scores, places = np.concatenate([best[0], scores], axis=1), np.concatenate([best[2], places], axis=1)
                    if scores.shape[1] > k:
                        limit = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                        width_now = int((scores >= limit).sum(axis=1).max())
                        order = np.argsort(-scores, axis=1, kind="stable")[:, :width_now]
                        scores, places = np.take_along_axis(scores, order, axis=1), np.take_along_axis(places, order, axis=1)
                        scores = np.where(scores >= limit, scores, -np.inf)
                    used, places = np.unique(places, return_inverse=True)
                    best = (scores, known.take(pa.array(used)), places.reshape(scores.shape))
        yield from rest()

    made = StructType([StructField("query_id", ids["query_id"]), StructField("vec_id", ids["vec_id"]), StructField("score", DoubleType())])
    return rows.repartition("cell").sortWithinPartitions("cell", "kind", *(["vec_id"] if whole else [])).mapInArrow(run, made)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, floor: float | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest vectors of every query (query_id, query), exactly; ties by vec_id.

    Products of blocks, see ``_meet``; every lane gives its k best for each query (and those as good as the last).
    """
    scored = _meet(queries.select("query_id", F.col("query").alias("embedding")), vectors.select("vec_id", "embedding"), k=k, held_rows=held_rows)
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", ranked).where(F.col("rank") <= k)


def top_k_in_groups(queries: DataFrame, vectors: DataFrame, k: int, held_rows: int = HELD_ROWS, lane_rows: int = LANE_ROWS) -> DataFrame:
    """query_id, vec_id, score: of every query (query_id, query, group) the ``k`` best vectors (vec_id, embedding, group) in
    each lane of its group, and those as good as the last: a caller ranks at most queries x lanes x k rows, ties aside.

    A query may ask several groups, one row each; a group of any size spreads over tasks.
    """
    asked = queries.select("query_id", "group", F.col("query").alias("embedding"))
    return _meet(asked, vectors.select("vec_id", "group", "embedding"), k=k, held_rows=held_rows, lane_rows=lane_rows)


def pair_scores(queries: DataFrame, vectors: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """query_id, vec_id, score of every vector against every query."""
    return _meet(queries.select("query_id", F.col("query").alias("embedding")), vectors.select("vec_id", "embedding"), held_rows=held_rows)


def lookup(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored vectors of (query_id, query, vec_id) scored against their query."""
    return ids.join(vectors.select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", similarity(F.col("query"), F.col("embedding")).alias("score"))


def best_unit(scores: DataFrame) -> DataFrame:
    """(chunk_id, concept_id, unit_no, score) -> best score and its first unit."""
    return scores.groupBy("chunk_id", "concept_id").agg(F.max("score").alias("score"), F.max_by("unit_no", F.struct("score", -F.col("unit_no"))).alias("unit_no"))


def best_units(concepts: DataFrame, units: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """best_unit of all pairs of concepts (concept_id, query) and units (chunk_id, unit_no, embedding): a chunk's units meet a
    concept in one task, so that vectors are dealt and no score ever is."""
    asked = concepts.select(F.col("concept_id").alias("query_id"), F.col("query").alias("embedding"))
    scored = _meet(asked, units.select(F.struct("chunk_id", "unit_no").alias("vec_id"), "embedding"), held_rows=held_rows, whole=True)
    return scored.select("vec_id.chunk_id", F.col("query_id").alias("concept_id"), "score", "vec_id.unit_no")


SAMPLE, ROUNDS, MOST_CELLS = 20_000, 12, 16_384


def quantiser(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """``cells`` unit centroids (fewer where there are fewer vectors), by spherical k-means on at most ``sample`` vectors, those of
    the smallest hashes.  Only this sample and the centroids are ever on the driver."""
    rows = vectors.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    picked, closest = [0], x @ x[0]
    while len(picked) < min(cells, len(x)):  # farthest first
        picked.append(int(np.argmin(closest)))
        closest = np.maximum(closest, x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[at : at + SLICE] @ centres.T, axis=1) for at in range(0, len(x), SLICE)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def nearest_cells(centres: np.ndarray, probes: int = 1) -> Callable[[Column], Column]:
    """A column function: the ``probes`` cells whose centroids are nearest to a vector, nearest first."""
    rows = max(1, (2 << 20) // max(1, len(centres)))

    @F.pandas_udf(ArrayType(IntegerType()))
    def near(batch: pd.Series) -> pd.Series:
        best = []
        for at in range(0, len(batch), rows):  # so many that their scores and order stay within some 16 MB each
            scores = np.array(batch.iloc[at : at + rows].tolist(), np.float64) @ centres.T
            best += list(np.argmax(scores, axis=1, keepdims=True).astype(np.int32) if probes == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(best, dtype=object)

    return near


def cell_limits(centres: np.ndarray, probes: int) -> Callable[[Column], Column]:
    """A column function: the likeness that parts the ``probes`` cells nearest to a vector from the others."""
    rows = max(1, (2 << 20) // len(centres))

    @F.arrow_udf(DoubleType())
    def limits(batch: pa.Array) -> pa.Array:
        if probes >= len(centres):
            return pa.array(np.full(len(batch), -np.inf))
        found = []
        for at in range(0, len(batch), rows):
            nearest = -np.partition(-(_dense(batch.slice(at, rows)) @ centres.T), (probes - 1, probes), axis=1)[:, probes - 1 : probes + 1]
            found.append(nearest.mean(axis=1) - 1e-12)
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return limits


def _dense(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


ASKED_ROWS, SCORES, PENDING = 20_000, 4 << 20, 1 << 20  # queries and scores that a task holds, and hits before only the best are kept


def _meet_in_cells(queries: DataFrame, vectors: DataFrame, centres: np.ndarray, k: int, held_rows: int) -> DataFrame:
    """query_id, vec_id, score: of every query (query_id, embedding, limit) the ``k`` best vectors (vec_id, embedding, cell) in each
    lane, of the cells that are at least ``limit`` near; ties of ids that are no numbers stay.

    Blocks of queries go to all lanes, a cell's vectors to one lane (a cell of over LANE_ROWS to several), once for each block.
    A lane's vectors stream past its queries cell by cell, so no row is made for a query and a cell, nor for a pair.
    """
    lanes, blocks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-queries.count() // held_rows))
    parts = vectors.groupBy("cell").agg(F.ceil(F.count("*") / LANE_ROWS).alias("_parts"))  # at most MOST_CELLS rows
    dealt = vectors.join(F.broadcast(parts), "cell").withColumn("_lane", F.pmod(F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), "_parts")), F.lit(lanes)).cast("int"))
    ids = {c: t.schema[c].dataType for t, c in ((queries, "query_id"), (vectors, "vec_id"))}
    none = lambda c: F.lit(None).cast(ids[c]).alias(c)
    key, kept = F.xxhash64("_block", "_lane").alias("key"), F.col("embedding").cast("array<double>" if queries.schema["embedding"] != vectors.schema["embedding"] else queries.schema["embedding"].dataType).alias("embedding")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_lane", every(lanes))
    theirs = dealt.withColumn("_block", every(blocks))
    rows = ours.select(key, F.lit(0).alias("kind"), F.lit(-1).alias("cell"), "query_id", none("vec_id"), "limit", kept).unionByName(
        theirs.select(key, F.lit(1).alias("kind"), "cell", none("query_id"), "vec_id", F.lit(None).cast("double").alias("limit"), kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, asked, limits, floor, known, hits, n_known, best, pending = None, [], [], [], None, [], [], 0, 0, 0

        def settle() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            """Only the best of each query stay, and their vectors' ids."""
            nonlocal known, hits, n_known, best, pending
            of, (q, place, score) = pa.concat_arrays(known), (np.concatenate(x) for x in zip(*hits))
            number = pa.types.is_integer(of.type)
            order = np.lexsort((of.to_numpy()[place], -score, q) if number else (-score, q))
            q, place, score = q[order], place[order], score[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = np.flatnonzero(rank == k - 1)
            floor[q[last]] = score[last]
            stay = rank < k if number else score >= floor[q]
            q, score = q[stay], score[stay]
            used, place = np.unique(place[stay], return_inverse=True)
            known, hits, n_known, best, pending = [of.take(pa.array(used))], [(q, place, score)], len(used), len(q), 0
            return known[0], q, place, score

        def rest() -> Iterator[pa.RecordBatch]:
            if hits:
                of, q, place, score = settle()
                for at in range(0, len(q), PENDING):
                    some = slice(at, at + PENDING)
                    yield pa.RecordBatch.from_arrays([asked[0].take(pa.array(q[some])), of.take(pa.array(place[some])), pa.array(score[some])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            keys, kinds, cells = (batch.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0) | (np.diff(cells) != 0)) + 1), len(keys)]
            for start, end in zip(edges, edges[1:]):
                if keys[start] != lane:
                    yield from rest()
                    lane, held, asked, limits, floor, known, hits, n_known, best, pending = keys[start], [], [], [], None, [], [], 0, 0, 0
                part = batch.slice(start, end - start)
                if kinds[start] == 0:
                    held.append(_dense(part.column(6)))
                    asked.append(part.column(3))
                    limits.append(part.column(5).to_numpy())
                    continue
                if not held:
                    continue
                if floor is None:
                    held, asked, limits = [np.concatenate(held)], [pa.concat_arrays(asked)], [np.concatenate(limits)]
                    floor = np.full(len(held[0]), -np.inf)
                asking = np.flatnonzero(held[0] @ centres[cells[start]] >= limits[0])
                if not len(asking):
                    continue
                mine, step = held[0][asking], max(1, SCORES // len(asking))
                for at in range(0, part.num_rows, step):
                    few = part.slice(at, step)
                    scores = mine @ _dense(few.column(6)).T
                    q, v = np.nonzero(scores >= floor[asking, None] - 10.0**-DIGITS)  # rounding may lift a score to the floor
                    if not len(q):
                        continue
                    hits.append((asking[q], v + n_known, half_away(scores[q, v])))
                    known.append(few.column(4))
                    n_known, pending = n_known + few.num_rows, pending + len(q)
                    if pending > max(PENDING, best):
                        settle()
        yield from rest()

    made = StructType([StructField("query_id", ids["query_id"]), StructField("vec_id", ids["vec_id"]), StructField("score", DoubleType())])
    return rows.repartition("key").sortWithinPartitions("key", "kind", "cell").mapInArrow(run, made)


def approximate_top_k(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int | None = None, share: float = 0.30, held_rows: int = ASKED_ROWS) -> DataFrame:
    """Like top_k, looking only at the vectors of the cells nearest to a query (an inverted file), with exact scores.

    The number of cells grows with the square root of the vectors', up to MOST_CELLS; ``share`` of the cells are probed:
    0.30 finds 0.9 of the neighbours even among vectors without any clusters, a third of that is enough for those that have
    some.  Every vector is in the index; vectors and queries meet cell by cell, as products of blocks.
    """
    n = vectors.count()
    centres = quantiser(vectors, cells or min(MOST_CELLS, max(1, round(8 * n**0.5))))
    if not len(centres):
        return top_k(queries, vectors, k)
    own, limit = nearest_cells(centres), cell_limits(centres, probes or max(1, round(share * len(centres))))
    indexed = cut(vectors.where("embedding is not null").select("vec_id", "embedding", F.get(own(F.col("embedding")), F.lit(0)).alias("cell")))
    asked = queries.where("query is not null").select("query_id", F.col("query").alias("embedding"), limit(F.col("query")).alias("limit"))
    scored = _meet_in_cells(asked, indexed, centres, k, held_rows)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
