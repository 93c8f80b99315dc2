"""Resolving rough topics: inputs, keys, memory-first routing, validation; and the review table's upkeep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.snapshots import latest


def normal_topic(topic: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(topic), "[^a-z0-9]+", " "))


def inputs(signals: DataFrame, rejected: DataFrame) -> DataFrame:
    """One input per (doc_id, chunk_id, topic): all signals, and the best rejected candidate of chunks that asked for a
    fallback and have no signal."""
    own = signals.select("doc_id", "chunk_id", "topic", F.lit("signal").alias("kind")).distinct()
    spare = rejected.where("fallback").join(own.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti")
    best = spare.groupBy("doc_id", "chunk_id").agg(F.max_by("topic", F.struct("score", "topic")).alias("topic"))
    return own.unionByName(best.withColumn("kind", F.lit("rejected")))


def family_labels(items: DataFrame, hits: DataFrame, least: int = 2) -> DataFrame:
    """Items (id, topic, generic) with a generic label renamed to the family with most support (evidence hits count
    twice); without enough support they are marked to need a label.  hits: id, family, n_evidence, n_context."""
    support = hits.withColumn("support", 2 * F.col("n_evidence") + F.col("n_context")).where(F.col("support") >= least)
    best = latest(support, ["id"], F.desc("support"), F.col("family")).select("id", "family")
    joined = items.join(best, "id", "left")
    return joined.select("id", F.when(F.col("generic"), F.coalesce("family", "topic")).otherwise(F.col("topic")).alias("topic"), (F.col("generic") & F.col("family").isNull()).alias("needs_label"))


def cache_key(*, topic: str, evidence: str, shortlist: str, model: str) -> Column:
    """SHA-256 over the normalised topic, evidence hash, sorted shortlist and model."""
    return F.sha2(F.concat_ws("|", normal_topic(F.col(topic)), F.sha2(F.trim(F.lower(F.col(evidence))), 256), F.array_join(F.array_sort(shortlist), ","), F.lit(model)), 256)


def memory_first(items: DataFrame, memory: DataFrame) -> DataFrame:
    """The newest reusable memory row of the same topic and evidence, else the one with the exact cache key."""
    good = memory.where("status = 'approved'")
    by_text = latest(good, ["topic_key", "evidence_hash"], F.desc("updated_at"), F.col("memory_id")).select("topic_key", "evidence_hash", F.col("concept_id").alias("_t"))
    by_key = latest(good, ["cache_key"], F.desc("updated_at"), F.col("memory_id")).select("cache_key", F.col("concept_id").alias("_k"))
    joined = items.join(by_text, ["topic_key", "evidence_hash"], "left").join(by_key, "cache_key", "left")
    source = F.when(F.col("_t").isNotNull(), "evidence").when(F.col("_k").isNotNull(), "cache")
    return joined.select("id", F.coalesce("_t", "_k").alias("concept_id"), source.alias("source"))


def existing_reviews(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Items with the review row of the same document and topic, where there is one."""
    return items.join(reviews.select("doc_id", "topic_key", "review_id", "status"), ["doc_id", "topic_key"], "left").select("id", "review_id", "status")


def accept_local(ranked: DataFrame, lesson: DataFrame, floor: float = 0.60, margin: float = 0.08) -> DataFrame:
    """The top candidate of an item where it is good, clear of the next and already a topic of the lesson."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "concept_id")
    top = ranked.withColumn("_n", F.lead("score").over(order)).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    clear = top.where((F.col("score") >= floor) & (F.col("score") - F.coalesce("_n", F.lit(0.0)) >= margin))
    return clear.join(lesson.select("doc_id", "concept_id").distinct(), ["doc_id", "concept_id"], "left_semi").select("id", "concept_id", "score")


def batch_responses(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items with their answer (id, pos, decision): unknown ids ignored, the last of repeats wins, none is pending."""
    last = answers.groupBy("id").agg(F.max_by("decision", "pos").alias("decision"))
    return items.join(last, "id", "left").select("id", F.coalesce("decision", F.lit("pending_review")).alias("decision"))


def validate(results: DataFrame, minimum: float = 0.70) -> DataFrame:
    """results (decision, concept_id, shortlist, confidence) with the status a decision may have."""
    known = F.col("decision").isin("mapped", "out_of_syllabus")
    listed = (F.col("decision") != "mapped") | F.coalesce(F.array_contains("shortlist", F.col("concept_id")), F.lit(False))
    status = F.when(~known, "invalid").when(~listed, "not_in_shortlist").when(F.col("confidence") < minimum, "needs_review").otherwise("accepted")
    return results.withColumn("status", status)


ROUTES = ("generic", "memory", "review", "cache", "no_candidates", "local", "request")


def route(items: DataFrame, merged: DataFrame) -> DataFrame:
    """items with one flag per route: the first that holds, and whether the concept is merged already (suppressed)."""
    chosen = F.lit("request")
    for name in reversed(ROUTES[:-1]):
        chosen = F.when(F.col(name), name).otherwise(chosen)
    known = merged.select("doc_id", "concept_id").distinct().withColumn("_m", F.lit(True))
    joined = items.join(known, ["doc_id", "concept_id"], "left")
    return joined.select("id", chosen.alias("route"), F.coalesce("_m", F.lit(False)).alias("suppressed"))


def one_review_each(reviews: DataFrame, order: Sequence[str] = ("approved", "pending", "rejected")) -> DataFrame:
    """One row per (doc_id, topic_key): by status, then the lowest id."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return latest(reviews, ["doc_id", "topic_key"], place, F.col("review_id"))


def review_items(results: DataFrame) -> DataFrame:
    """Reviewable items out of a document's nested lists (struct arrays unresolved, conflicts, suggestions): first by
    list, one row per item; items that a rule made are left out."""
    tag = lambda name, k: F.transform(F.coalesce(name, F.array()), lambda x: F.struct(F.lit(k).alias("priority"), x["item"].alias("item"), x["method"].alias("method")))
    rows = results.select("doc_id", F.explode(F.concat(tag("unresolved", 1), tag("conflicts", 2), tag("suggestions", 3))).alias("x")).select("doc_id", "x.*").where("method <> 'rule'")
    return latest(rows, ["doc_id", "item"], F.col("priority"), F.col("method"))
