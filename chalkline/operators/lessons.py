"""Lesson-level aggregation: merged topics, spans, coverage, rank, roles and hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.operators.chunking import rounded

TOPIC = ["doc_id", "concept_id"]


def merge_topics(candidates: DataFrame) -> DataFrame:
    """Candidates of a document by concept: best confidence, mean scores, chunk ids, at most five evidence positions, and
    the coverage, all in one shuffle by document."""
    n_all = F.size(F.collect_set("chunk_id").over(Window.partitionBy("doc_id")))
    return candidates.withColumn("n_all", n_all).groupBy(*TOPIC).agg(
        F.size(F.collect_set("chunk_id")).alias("n_chunks"), rounded(F.size(F.collect_set("chunk_id")) / F.first("n_all"), 6).alias("coverage"),
        F.max("confidence").alias("confidence"), F.avg("semantic_score").alias("semantic"), F.avg("keyword_score").alias("keyword"), F.avg("salience").alias("salience"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), 1, 5).alias("evidence"),
    )


def spans(candidates: DataFrame, bonus: float = 0.02, cap: float = 0.06, most: float = 0.95) -> DataFrame:
    """Per topic: number of contiguous chunk runs, and the best confidence with a bonus for every further run."""
    ids = candidates.select(*TOPIC, "chunk_id", "confidence")
    gap = F.col("chunk_id") - F.lag("chunk_id").over(Window.partitionBy(*TOPIC).orderBy("chunk_id"))
    runs = ids.withColumn("_gap", gap).groupBy(*TOPIC).agg((F.count_if(F.col("_gap") > 1) + 1).alias("n_spans"), F.max("confidence").alias("_c"))
    return runs.select(*TOPIC, "n_spans", rounded(F.least(F.lit(most), F.col("_c") + F.least(F.lit(cap), bonus * (F.col("n_spans") - 1))), 6).alias("confidence"))


def coverage(candidates: DataFrame) -> DataFrame:
    """Share of the document's topic-bearing chunks in which a topic stands."""
    total = candidates.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n_all"))
    own = candidates.groupBy(*TOPIC).agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return own.join(total, "doc_id").select(*TOPIC, "n_chunks", rounded(F.col("n_chunks") / F.col("n_all"), 6).alias("coverage"))


def rank_scores(topics: DataFrame) -> DataFrame:
    score = 0.2 * F.col("confidence") + 0.2 * F.col("semantic") + 0.2 * F.col("salience") + 0.4 * F.col("coverage")
    return topics.withColumn("rank_score", rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def roles(topics: DataFrame) -> DataFrame:
    """primary or supporting: near the best coverage and rank of the document; the best one if none is."""
    doc = Window.partitionBy("doc_id")
    primary = (F.col("coverage") >= F.greatest(F.lit(0.35), 0.75 * F.max("coverage").over(doc))) & (F.col("rank_score") >= F.greatest(F.lit(0.42), F.max("rank_score").over(doc) - 0.12))
    best = F.row_number().over(doc.orderBy(F.desc("rank_score"), F.desc("coverage"), "concept_id"))
    marked = topics.withColumn("_p", primary).withColumn("_b", best)
    none = F.max(F.col("_p").cast("int")).over(doc) == 0
    return marked.withColumn("role", F.when(F.col("_p") | (none & (F.col("_b") == 1)), "primary").otherwise("supporting")).drop("_p", "_b")


def ordered(topics: DataFrame) -> DataFrame:
    """Adds place: primary first, then rank, coverage, semantic, confidence and id."""
    by = Window.partitionBy("doc_id").orderBy("role", F.desc("rank_score"), F.desc("coverage"), F.desc("semantic"), F.desc("confidence"), "concept_id")
    return topics.withColumn("place", F.row_number().over(by))


DENSE = 8  # a list of chunk ids may have so many places for each of them


def handoff(topics: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """Topics with the texts of their chunks in order and the ids that have none.

    A document's texts are moved once, as a list by chunk id, and its topics read them there: no text is moved for a topic.
    """
    entries = F.sort_array(F.collect_list(F.struct("chunk_id", "text")))
    ids = lambda e: F.transform(e, lambda x: x["chunk_id"])
    told = chunk_texts.groupBy("doc_id").agg(entries.alias("e")).withColumn("first", F.get("e", F.lit(0))["chunk_id"].cast("long"))
    room = F.element_at("e", -1)["chunk_id"] - F.col("first") + 1
    dense = (room <= DENSE * F.size("e")) & (F.size(F.array_distinct(ids(F.col("e")))) == F.size("e"))
    gap = lambda x, i: F.coalesce(F.get("e", i + 1)["chunk_id"] - x["chunk_id"] - 1, F.lit(0)).cast("int")
    placed = F.flatten(F.transform("e", lambda x, i: F.concat(F.array(x["text"]), F.array_repeat(F.lit(None).cast("string"), gap(x, i)))))
    told = told.select("doc_id", "first", F.when(dense, placed).alias("placed"), F.when(~dense, F.col("e")).alias("e"))
    pair = lambda k, t: F.struct(k.alias("chunk_id"), t.alias("text"))
    at = lambda k: F.when((k >= F.col("first")) & (k < F.col("first") + F.size("placed")), F.get("placed", (k - F.col("first")).cast("int")))
    none = F.lit(None).cast("string")

    def searched(k: Column) -> Column:
        of = F.transform(F.filter("e", lambda x: x["chunk_id"] == k), lambda x: pair(k, x["text"]))
        return F.when(F.size(of) > 0, of).otherwise(F.array(pair(k, none)))

    found = (
        F.when(F.col("placed").isNotNull(), F.transform("chunk_ids", lambda k: pair(k, at(k)))).when(F.col("e").isNotNull(), F.flatten(F.transform("chunk_ids", searched)))
        .otherwise(F.transform("chunk_ids", lambda k: pair(k, none)))
    )
    asked = topics.where(F.size("chunk_ids") > 0).select(*TOPIC, "chunk_ids")
    read = asked.join(told, "doc_id", "left").select(*TOPIC, found.alias("found"))
    without = F.filter("found", lambda x: x["text"].isNull())
    return read.select(*TOPIC, F.array_compact(F.transform("found", lambda x: x["text"])).alias("texts"), F.array_sort(ids(without)).alias("missing"))


def approved(payload: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per document: approved topics, how many, and whether each has evidence texts."""
    kept = payload.join(decisions.where("status = 'approved'").select(*TOPIC), TOPIC, "left_semi")
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("concept_id")).alias("topics"), F.count("*").alias("n_topics"), F.bool_and(F.size("texts") > 0).alias("evidence_available"))
