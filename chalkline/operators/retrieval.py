"""Retrieval: requests, candidate search, scoring, de-duplication, quality gates, quotas, selection and packaging.

Candidates are keyed (request_id, topic_index, question_id); all steps run for many requests at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from chalkline.operators.chunking import dot
from chalkline.operators.held import cut
from chalkline.operators.terminology import ratio
from chalkline.operators.vectors import top_k_in_groups

TOPIC = ["request_id", "topic_index"]


def normal_topics(handoff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, rejects) out of a hand-off with several spellings of its fields."""
    rows = handoff.select(
        "request_id", "topic_index", F.coalesce("official_reference", "reference", "ref").alias("reference"), F.lower(F.coalesce("role", "topic_role", F.lit("supporting"))).alias("role"),
        F.coalesce("confidence", "score").alias("confidence"),
    )
    primary = F.max((F.col("role") == "primary").cast("int")).over(Window.partitionBy("request_id"))
    reason = F.when(F.col("reference").isNull(), "no_reference").when(~F.col("role").isin("primary", "supporting"), "role").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence").when(primary == 0, "no_primary")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def map_official(topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """topics with their official section and role weight; unknown references have a null section."""
    weight = F.when(F.col("role") == "primary", 1.0).otherwise(0.65)
    return topics.join(mapping.select("reference", "section").distinct(), "reference", "left").withColumn("role_weight", weight)


def request_problems(requests: DataFrame) -> DataFrame:
    """requests with their violated rules and the derived coverage mode."""
    n = F.col("n_questions")
    rules = [("n", n < 1), ("marks", F.col("target_marks") < n), ("primary", F.col("min_primary") > n), ("supporting", F.col("min_supporting") > n), ("roles", F.col("min_primary") + F.col("min_supporting") > n), ("references", F.col("min_references") > n)]
    problems = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules]))
    return requests.select("*", problems.alias("problems"), F.when(n >= F.col("n_topics"), "all_topics").otherwise("best_topics").alias("coverage_mode"))


def evidence_text(topics: DataFrame, chunk_texts: DataFrame, longest: int = 4000) -> DataFrame:
    """Evidence of a topic: its own texts, else those of its chunks, else the lesson's summary; with the source."""
    by_chunk = topics.select(*TOPIC, F.posexplode_outer("chunk_ids").alias("k", "chunk_id"), "doc_id").join(chunk_texts, ["doc_id", "chunk_id"], "left")
    joined = by_chunk.groupBy(*TOPIC).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("k", "text")))), lambda x: x["text"]), "\n").alias("_c"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = topics.join(joined, TOPIC, "left").withColumn("_o", filled(F.col("own_text"))).withColumn("_c", filled(F.col("_c")))
    source = F.when(F.col("_o").isNotNull(), "own").when(F.col("_c").isNotNull(), "chunks").otherwise("summary")
    return out.select(*TOPIC, F.left(F.coalesce("_o", "_c", "summary"), F.lit(longest)).alias("evidence"), source.alias("source"))


def query_text(reference: str = "reference", label: str = "label", evidence: str = "evidence") -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Topic: "), F.col(reference)), F.concat(F.lit("Title: "), F.col(label)), F.col(evidence))


def _nearest(topics: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The k nearest questions of a topic (with ``group``, one row for each it asks) among those of its groups."""
    asked = topics.select(F.struct(*TOPIC).alias("query_id"), "query", "group")
    found = top_k_in_groups(asked, questions.select(F.struct("question_id", "reference", "marks").alias("vec_id"), "embedding", "group"), k)
    rows = found.select("query_id.*", "vec_id.*", "score")
    order = Window.partitionBy(*TOPIC).orderBy(F.desc("score"), "question_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(topics: DataFrame, questions: DataFrame, k: int = 20) -> DataFrame:
    """Nearest questions of the same official reference, per topic: products of blocks within a reference, then ranked."""
    return _nearest(topics.withColumn("group", F.col("reference")), questions.withColumn("group", F.col("reference")), k)


def fallback(topics: DataFrame, found: DataFrame, questions: DataFrame, wanted: int, k: int = 10) -> DataFrame:
    """For topics with fewer than ``wanted`` exact hits: nearest questions of the section's other references, each asked."""
    counts = found.groupBy(*TOPIC).agg(F.count("*").alias("_n"))
    short = topics.join(counts, TOPIC, "left").where(F.coalesce("_n", F.lit(0)) < wanted).select(*TOPIC, "query", "section", F.col("reference").alias("_ref"))
    others = short.join(questions.select("section", "reference").distinct(), "section").where("reference <> _ref")
    place = F.struct("section", "reference")
    return _nearest(others.withColumn("group", place), questions.withColumn("group", place), k)


def retrieval_score() -> Column:
    base = 0.55 * F.col("score") + 0.15 * F.col("confidence") + 0.10 * F.col("rank_score") + 0.20 * F.col("role_weight")
    return F.round(base + F.when(F.col("method") == "exact", 0.15).otherwise(-0.12) + F.when(F.col("corrected"), 0.02).otherwise(0.0), 9)


def dedup_exact(rows: DataFrame) -> DataFrame:
    """One row per content: by content hash, else vector hash, else text and marks; the best score stays."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    key = F.coalesce(F.concat(F.lit("c"), filled("content_hash")), F.concat(F.lit("v"), filled("vector_hash")), F.concat_ws("|", F.lit("t"), "text", "marks"))
    order = Window.partitionBy("request_id", "_k").orderBy(F.desc("final_score"), F.desc("score"), "question_id")
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_k", "_r")


KEPT = "abcdefghijklmnopqrstuvwxyz0123456789+*/=<>. "  # one by one: classes of ranges are tested range by range, some 50 times slower


def canonical_text(text: Column, heading: str = r"^\s*(?:topic|section|page)\b.*$") -> Column:
    """Without heading and blank lines, lower case, letters, digits and a few signs."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(heading) & (F.trim(x) != ""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), f"[^{KEPT}]+", " "), " {2,}", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two word sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 6))


SLOTS = 1 << 18  # words are counted by this many slots of their hash, whatever the input: the counts go to all tasks


def _rarest(rows: DataFrame, share: float) -> DataFrame:
    """request_id, question_id, marks, n, h: hashes of a row's ceil(share n) + 1 rarest of its n distinct words.

    Any one order of all words will do, so words are ordered by how many rows share their slot, then by hash; that only
    moves what is met, and no word is shuffled before the rare ones are picked in their own row.
    """
    hashed = rows.where("request_id is not null and marks is not null").select("request_id", "question_id", "marks", F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("h"))
    found = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    schema = StructType([*hashed.drop("h").schema, StructField("n", IntegerType()), StructField("h", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                words = batch.column(3)
                n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
                h = words.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, counts[h & (SLOTS - 1)], row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                kept = order[place <= np.ceil(n * share)[row]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row[kept])) for i in range(3)), pa.array(n[row[kept]], pa.int32()), pa.array(h[kept], pa.int64())], names=schema.names)

    return hashed.mapInArrow(run, schema)


MOST_ASKED = 200_000  # so many rows that a pair asks for are sent to all tasks, so that no other text moves


def near_pairs(
    rows: DataFrame, lexical: float = 0.92, lexical_jaccard: float = 0.80, cosine: float = 0.985, cosine_jaccard: float = 0.75, prefix: float = 0.3, added: Callable[[DataFrame], DataFrame] = lambda met: met,
) -> DataFrame:
    """Near-duplicate pairs (better-ranked a, worse b) of a request with equal marks.  ``added`` makes what ``rows`` lacks
    (a vector, say) for the rows of a pair only.

    Blocked on rare shared words: with Jaccard of at least 0.75, two sets share one of their ceil(0.25 n) + 1 rarest
    words, so only those are joined, as hashes; texts and vectors are read for the rows of a pair only.
    """
    least = min(lexical_jaccard, cosine_jaccard)
    rare = _rarest(rows, 1 - least)
    x, y = (rare.select("request_id", "marks", "h", F.col("question_id").alias(q), F.col("n").alias(f"n_{q}")) for q in "ij")
    as_long = F.least("n_i", "n_j") >= F.greatest("n_i", "n_j") * (least - 1e-6)  # likeness is rounded to 6 digits
    met = cut(x.join(y.hint("merge"), ["request_id", "marks", "h"]).where((F.col("i") < F.col("j")) & as_long).select("request_id", "marks", "i", "j").distinct())
    asked_for = met.select("request_id", F.explode(F.array("i", "j")).alias("question_id")).distinct()
    n = asked_for.limit(MOST_ASKED + 1).count()
    asked_rows = cut(added(rows.join(F.broadcast(asked_for) if n <= MOST_ASKED else asked_for, ["request_id", "question_id"], "left_semi")))
    side = lambda p, q: asked_rows.select("request_id", "marks", F.col("question_id").alias(q), *[F.col(c).alias(f"{p}_{c}") for c in ("text", "words", "embedding", "place")])
    full = met.join(side("x", "i"), ["request_id", "marks", "i"]).join(side("y", "j"), ["request_id", "marks", "j"])
    likeness = full.withColumn("jaccard", jaccard(F.col("x_words"), F.col("y_words"))).where(F.col("jaccard") >= least).withColumn("cosine", F.round(dot(F.col("x_embedding"), F.col("y_embedding")), 6))
    sure = (F.col("x_text") == F.col("y_text")) | ((F.col("cosine") >= cosine) & (F.col("jaccard") >= cosine_jaccard))
    asked = lambda c: F.when(~sure & (F.col("jaccard") >= lexical_jaccard), F.col(c)).otherwise("")
    likeness = likeness.withColumn("lexical", ratio(asked("x_text"), asked("y_text")))  # matching blocks only where nothing else decides
    near = sure | ((F.col("lexical") >= lexical) & (F.col("jaccard") >= lexical_jaccard))
    first = F.col("x_place") < F.col("y_place")
    return likeness.where(near).select("request_id", F.when(first, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("b"), F.least("x_place", "y_place").alias("a_place"), F.greatest("x_place", "y_place").alias("b_place"))


def greedy_dups(pairs: DataFrame) -> DataFrame:
    """(request_id, question_id, kept_by): rows near a better-ranked row that itself stays.

    A row near a dropped one only is kept, so the order matters: one request's pairs are walked best first.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        gone: dict = {}
        for r in rows.sort_values(["b_place", "a_place"]).itertuples():
            if r.a not in gone and r.b not in gone:
                gone[r.b] = r.a
        return pd.DataFrame({"request_id": rows["request_id"].iloc[0], "question_id": list(gone), "kept_by": list(gone.values())}, columns=["request_id", "question_id", "kept_by"])

    return pairs.groupBy("request_id").applyInPandas(walk, "request_id long, question_id long, kept_by long")


def text_issues(text: Column) -> Column:
    """Reasons not to show a question text."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    last = F.element_at(F.split(F.trim(text), r"\s+"), -1)
    cut = F.exists(F.split(text, "\n"), lambda x: x.rlike(r"[A-Za-z]-$"))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("missing")), F.when(words < 8, F.lit("too_short")), F.when(F.lower(last).isin("the", "of", "and", "a", "to"), F.lit("trailing_fragment")),
        F.when(cut, F.lit("truncated_segment")), F.when(text.rlike(r"(?i)\b(?:page|copyright|all rights reserved)\b"), F.lit("footer")), F.when(text.rlike(r"[#%$&*]{3,}"), F.lit("parser_noise")),
    ))


def quotas(topics: DataFrame, requests: DataFrame) -> DataFrame:
    """Least number of questions per topic: one for each required topic, then each role's minimum and then the rest in
    rounds over the role's (or all) topics by weight.

    A round gives everyone ``left div count`` and one more to the first ``left % count``.
    """
    joined = topics.join(requests.select("request_id", "n_questions", "min_primary", "min_supporting"), "request_id").withColumn("base", F.col("required").cast("int"))
    role = Window.partitionBy("request_id", "role")
    left = F.greatest(F.lit(0), F.when(F.col("role") == "primary", F.col("min_primary")).otherwise(F.col("min_supporting")) - F.sum("base").over(role))
    place = F.row_number().over(role.orderBy(F.desc("role_weight"), "topic_index"))
    by_role = joined.withColumn("_l", left).withColumn("_c", F.count("*").over(role)).withColumn("_p", place)
    first = by_role.withColumn("by_role", F.expr("cast(_l div _c as int) + if(_p <= _l % _c, 1, 0)"))
    every = Window.partitionBy("request_id")
    rest = first.withColumn("_rest", F.greatest(F.lit(0), F.col("n_questions") - F.sum(F.col("base") + F.col("by_role")).over(every))).withColumn("_m", F.count("*").over(every)).withColumn("_q", F.row_number().over(every.orderBy(F.desc("role_weight"), "topic_index")))
    return rest.select(*TOPIC, "role", (F.col("base") + F.col("by_role") + F.expr("cast(_rest div _m as int) + if(_q <= _rest % _m, 1, 0)")).alias("quota"))


def adaptive(scores: DataFrame, quota: DataFrame, low: float = 0.45, high: float = 0.70, slack: float = 0.10) -> DataFrame:
    """Per topic: a threshold near its 60th percentile or best score, lowered to the quota-th score if that is allowed."""
    sorted_scores = F.sort_array(F.collect_list("final_score"), asc=False)
    agg = scores.groupBy(*TOPIC).agg(F.min("final_score").alias("least"), F.max("final_score").alias("most"), F.median("final_score").alias("median"), F.percentile("final_score", F.lit(0.6)).alias("p60"), F.count("*").alias("n"), sorted_scores.alias("_s"))
    base = F.greatest(F.lit(low), F.least(F.lit(high), F.greatest(F.col("p60"), F.col("most") - slack)))
    joined = agg.join(quota.select(*TOPIC, "quota"), TOPIC).withColumn("_b", base).withColumn("_q", F.try_element_at("_s", F.greatest("quota", F.lit(1)).cast("int")))
    lower = (F.col("_q") >= low) & (F.col("_q") < F.col("_b"))
    reason = F.when(lower, "lowered_to_quota").when(F.col("_q").isNull(), "too_few").otherwise("percentile")
    return joined.select(*TOPIC, "least", "most", F.round("median", 9).alias("median"), "n", F.round(F.when(lower, F.col("_q")).otherwise(F.col("_b")), 9).alias("threshold"), reason.alias("reason"))


def gate(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows (final_score, issues) with passed and the sorted reasons against."""
    joined = rows.join(thresholds.select(*TOPIC, "threshold"), TOPIC)
    low = F.col("final_score") + 1e-9 < F.col("threshold")
    reasons = F.array_sort(F.array_distinct(F.concat("issues", F.when(low, F.array(F.lit("below_threshold"))).otherwise(F.array().cast("array<string>")))))
    return joined.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def pool_check(passed: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether what passed can still fill a request: number, roles, references, required references."""
    agg = passed.groupBy("request_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "primary").alias("n_primary"), F.count_if(F.col("role") != "primary").alias("n_supporting"), F.array_sort(F.collect_set("reference")).alias("refs"))
    joined = requests.join(agg, "request_id", "left").fillna({"n": 0, "n_primary": 0, "n_supporting": 0}).withColumn("refs", F.coalesce("refs", F.array().cast("array<int>")))
    ok = (F.col("n") >= F.col("n_questions")) & (F.col("n_primary") >= F.col("min_primary")) & (F.col("n_supporting") >= F.col("min_supporting")) & (F.size("refs") >= F.col("min_references")) & (F.size(F.array_except("required_refs", "refs")) == 0)
    return joined.select("request_id", "n", "n_primary", "n_supporting", F.size("refs").alias("n_references"), ok.alias("ok"))


def rescue(manifest: DataFrame, requests: DataFrame, floor: float = 0.40) -> DataFrame:
    """Adds the best safe rows that failed the gate: first one for each required reference that is missing, then for
    missing roles, then for the total; every pass counts what the one before has added.  Adds rescued (pass name)."""
    rows = manifest.join(requests.select("request_id", "n_questions", "min_primary", "min_supporting", "required_refs"), "request_id")
    safe = ~F.col("passed") & (F.size(F.array_except("reasons", F.array(F.lit("below_threshold")))) == 0) & (F.col("final_score") >= floor)
    order = (F.desc("final_score"), F.col("question_id"), F.col("topic_index"))
    rows = rows.withColumn("_safe", safe).withColumn("rescued", F.lit(None).cast("string"))
    free = F.col("_safe") & F.col("rescued").isNull()
    inside = F.col("passed") | F.col("rescued").isNotNull()

    ref = Window.partitionBy("request_id", "reference")
    first = F.row_number().over(ref.orderBy(F.when(free, 0).otherwise(1), *order))
    missing = (F.max(inside.cast("int")).over(ref) == 0) & F.array_contains("required_refs", F.col("reference"))
    rows = rows.withColumn("_t", free & missing & (first == 1)).withColumn("rescued", F.when(F.col("_t"), "reference").otherwise(F.col("rescued")))

    role = Window.partitionBy("request_id", "role")
    need = F.when(F.col("role") == "primary", F.col("min_primary")).otherwise(F.col("min_supporting")) - F.sum(inside.cast("int")).over(role)
    nth = F.row_number().over(role.orderBy(F.when(free, 0).otherwise(1), *order))
    rows = rows.withColumn("_t", free & (nth <= need)).withColumn("rescued", F.when(F.col("_t"), "role").otherwise(F.col("rescued")))

    every = Window.partitionBy("request_id")
    need = F.col("n_questions") - F.sum(inside.cast("int")).over(every)
    nth = F.row_number().over(every.orderBy(F.when(free, 0).otherwise(1), *order))
    rows = rows.withColumn("_t", free & (nth <= need)).withColumn("rescued", F.when(F.col("_t"), "total").otherwise(F.col("rescued")))
    return rows.select(*manifest.columns, "rescued")


def gate_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("request_id").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.min("threshold").alias("min_threshold"), F.max("threshold").alias("max_threshold"), F.round(F.avg("threshold"), 9).alias("mean_threshold"),
        F.count_if(F.array_contains("reasons", "below_threshold")).alias("n_below"), F.count_if(F.size(F.array_except("reasons", F.array(F.lit("below_threshold")))) > 0).alias("n_quality"),
    )


def select(pool: DataFrame, requests: DataFrame, per_question: int | None = 14, least_pool: int = 50) -> DataFrame:
    """Exactly n questions of a request: role minima, distinct references, required references; the smallest marks
    difference, then the highest score, then most references.

    Dynamic programming over (count, marks, primaries, reference set) of a request's best rows: the first max(``per_question``
    * n, ``least_pool``) of them, which is the rule of the selection, or all of them where per_question is None (the exact
    optimum over the whole pool).  A state is replaced only by a strictly higher score, so earlier rows win ties.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows.iloc[0]
        n, least_p, least_s, least_r = int(ask.n_questions), int(ask.min_primary), int(ask.min_supporting), int(ask.min_references)
        rows = rows.sort_values(["final_score", "question_id"], ascending=[False, True])
        rows = rows if per_question is None else rows.head(max(per_question * n, least_pool))
        refs = sorted(set(rows["reference"]) | set(ask.required_refs))
        bit = {r: 1 << k for k, r in enumerate(refs)}
        must = sum(bit[r] for r in set(ask.required_refs))
        best: dict[tuple, tuple[float, tuple]] = {(0, 0, 0, 0): (0.0, ())}
        for r in rows.itertuples():
            for (c, m, p, mask), (score, ids) in list(best.items()):
                if c == n:
                    continue
                state = (c + 1, m + int(r.marks), p + (r.role == "primary"), mask | bit[r.reference])
                if state not in best or score + r.final_score > best[state][0] + 1e-12:
                    best[state] = (score + r.final_score, (*ids, r.question_id))
        good = [(abs(m - ask.target_marks), -round(s, 9), -mask.bit_count(), ids) for (c, m, p, mask), (s, ids) in best.items() if c == n and p >= least_p and c - p >= least_s and mask.bit_count() >= least_r and mask & must == must]
        ids = min(good)[3] if good else ()
        return rows[rows["question_id"].isin(ids)].drop_duplicates("question_id")[["request_id", "question_id", "marks", "role", "reference", "final_score"]]

    keep = requests.select("request_id", "n_questions", "min_primary", "min_supporting", "min_references", "target_marks", "required_refs")
    best = Window.partitionBy("request_id", "question_id").orderBy(F.desc("final_score"), "topic_index")
    once = pool.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
    joined = once.select("request_id", "question_id", "marks", "role", "reference", "final_score").join(keep, "request_id")
    return joined.groupBy("request_id").applyInPandas(run, "request_id long, question_id long, marks int, role string, reference int, final_score double")


def selection_stats(selected: DataFrame, requests: DataFrame) -> DataFrame:
    agg = selected.groupBy("request_id").agg(F.count("*").alias("n"), F.sum("marks").alias("marks"), F.count_if(F.col("role") == "primary").alias("n_primary"), F.countDistinct("reference").alias("n_references"))
    joined = requests.join(agg, "request_id", "left").fillna({"n": 0, "marks": 0, "n_primary": 0, "n_references": 0})
    status = F.when(F.col("n") < F.col("n_questions"), "incomplete").when(F.col("marks") == F.col("target_marks"), "exact").otherwise("near")
    return joined.select("request_id", "n", "marks", "n_primary", "n_references", (F.col("marks") - F.col("target_marks")).alias("difference"), status.alias("status"))


def assemble(selected: DataFrame, questions: DataFrame, topics: DataFrame, entries: DataFrame) -> DataFrame:
    """Selected rows with their question, topic and mark scheme; order by score."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("final_score"), "question_id"))
    return selected.join(questions, "question_id").join(topics, "reference").join(entries, "question_id", "left").withColumn("place", place)


def pages(questions: DataFrame) -> DataFrame:
    """Pages to show: those listed, else the whole range."""
    return questions.withColumn("pages", F.when(F.size(F.coalesce("visual_pages", F.array().cast("array<int>"))) > 0, F.array_sort(F.array_distinct("visual_pages"))).otherwise(F.sequence("first_page", "last_page")))


def scheme_lines(schemes: DataFrame) -> DataFrame:
    """question_id, line_no, line, label: inline markers after a semicolon start lines; a dangling marker at a line's
    end goes to the next."""
    broken = F.split(F.regexp_replace("scheme", r";\s*(?=(?:A|R|I)\.)", ";\n"), "\n")
    rows = schemes.select("question_id", F.posexplode(broken).alias("line_no", "raw"))
    dangling = F.regexp_extract(F.col("raw"), r"(?:^|\s)((?:A|R|I)\.)\s*$", 1)
    before = F.lag(dangling).over(Window.partitionBy("question_id").orderBy("line_no"))
    own = F.trim(F.regexp_replace("raw", r"(?:^|\s)(?:A|R|I)\.\s*$", ""))
    line = F.trim(F.concat_ws(" ", F.nullif(before, F.lit("")), own))
    marked = rows.select("question_id", "line_no", line.alias("line")).where("line <> ''")
    return marked.withColumn("label", F.when(F.col("line").startswith("A."), "accept").when(F.col("line").startswith("R."), "reject").when(F.col("line").startswith("I."), "ignore").when(F.col("line").rlike("(?i)^example"), "example"))


def scheme_blocks(lines: DataFrame) -> DataFrame:
    """Runs of lines from a label to the next; lines before any label are marking points; equal lines of a block count
    once."""
    order = Window.partitionBy("question_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    block = F.sum(F.col("label").isNotNull().cast("int")).over(order)
    return lines.withColumn("block", block).groupBy("question_id", "block").agg(F.coalesce(F.first("label", ignorenulls=True), F.lit("marking")).alias("label"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])).alias("lines"))


def scheme_confidence(rows: DataFrame) -> DataFrame:
    """Rule confidence of a parsed scheme from its signals, with a status."""
    signals = (("has_points", 0.30), ("marks_equal", 0.20), ("exact_link", 0.15), ("has_labels", 0.10), ("long_enough", 0.10), ("no_warning", 0.05), ("same_part", 0.05), ("clean_text", 0.03), ("reviewed", 0.02))
    total = F.lit(0.0)
    for name, weight in signals:
        total = total + F.when(F.col(name), weight).otherwise(0.0)
    return rows.withColumn("confidence", F.round(total, 6)).withColumn("status", F.when(F.col("confidence") >= 0.80, "auto").when(F.col("confidence") >= 0.55, "review").otherwise("reject"))


def release(rows: DataFrame, hard: Sequence[str] = ("incomplete", "missing_scheme")) -> DataFrame:
    """Status of a package by its blockers: none is ready, a hard one needs a decision, others allow evaluation."""
    status = F.when(F.size("blockers") == 0, "ready").when(F.arrays_overlap("blockers", F.array(*map(F.lit, hard))), "needs_decision").otherwise("evaluation")
    return rows.withColumn("release", status)


def package(assembled: DataFrame) -> DataFrame:
    """request_id and its package as JSON, questions in order."""
    return assembled.groupBy("request_id").agg(F.to_json(F.struct(F.sum("marks").alias("marks"), F.sort_array(F.collect_list(F.struct("place", "question_id", "marks", "role"))).alias("questions"))).alias("package"))
