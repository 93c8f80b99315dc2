"""Queries over lesson-level aggregation of the mapped candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import lessons as L
from chalkline.operators.chunking import rounded
from chalkline.plans.bridges import chunk_arrays, read
from chalkline.plans.registry import query
from chalkline.plans.topics_queries import EVID, judged

MERGED = f"""{EVID}, merged AS (SELECT doc_id, concept_id, max(confidence) AS confidence, avg(semantic_score) AS semantic, avg(keyword_score) AS keyword, avg(salience) AS salience, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, list_sort(list_distinct(flatten(list(evidence))))[1:5] AS evidence FROM qual GROUP BY 1, 2),
n_all AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM qual GROUP BY 1),
cov AS (SELECT q.doc_id, concept_id, count(DISTINCT chunk_id) AS n_chunks, round(count(DISTINCT chunk_id) / any_value(n)::DOUBLE, 6) AS coverage FROM qual q JOIN n_all USING (doc_id) GROUP BY 1, 2),
scored AS (SELECT m.*, n_chunks, coverage, round(greatest(0.0, least(1.0, 0.2 * confidence + 0.2 * semantic + 0.2 * salience + 0.4 * coverage)), 6) AS rank_score FROM merged m JOIN cov USING (doc_id, concept_id)),
pr AS (SELECT *, coverage >= greatest(0.35, 0.75 * max(coverage) OVER (PARTITION BY doc_id)) AND rank_score >= greatest(0.42, max(rank_score) OVER (PARTITION BY doc_id) - 0.12) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY rank_score DESC, coverage DESC, concept_id) AS b FROM scored),
rl AS (SELECT *, CASE WHEN p OR (NOT bool_or(p) OVER (PARTITION BY doc_id) AND b = 1) THEN 'primary' ELSE 'supporting' END AS role FROM pr)"""


def scored(spark, d):
    return L.rank_scores(L.merge_topics(judged(spark, d)))


@query("agg.merge", f"WITH {MERGED} SELECT doc_id, concept_id, confidence, round(semantic, 9) AS semantic, round(keyword, 9) AS keyword, round(salience, 4) AS salience, chunk_ids, evidence FROM merged")
def merge(spark, d):
    m = L.merge_topics(judged(spark, d))
    return m.withColumns({c: rounded(c, k) for c, k in (("semantic", 9), ("keyword", 9), ("salience", 4))}).drop("n_chunks", "coverage")


@query("agg.spans", f"WITH {EVID}, g AS (SELECT doc_id, concept_id, confidence, chunk_id - lag(chunk_id) OVER (PARTITION BY doc_id, concept_id ORDER BY chunk_id) AS gap FROM qual), s AS (SELECT doc_id, concept_id, count(*) FILTER (gap > 1) + 1 AS n_spans, max(confidence) AS c FROM g GROUP BY 1, 2) SELECT doc_id, concept_id, n_spans, round(least(0.95, c + least(0.06, 0.02 * (n_spans - 1))), 6) AS confidence FROM s")
def spans(spark, d):
    return L.spans(judged(spark, d))


@query("agg.coverage", f"WITH {MERGED} SELECT * FROM cov")
def coverage(spark, d):
    return L.coverage(judged(spark, d))


@query("agg.rank_score", f"WITH {MERGED} SELECT doc_id, concept_id, rank_score FROM scored")
def rank_score(spark, d):
    return scored(spark, d).select("doc_id", "concept_id", "rank_score")


@query("agg.roles", f"WITH {MERGED} SELECT doc_id, concept_id, coverage, rank_score, role FROM rl")
def roles(spark, d):
    return L.roles(scored(spark, d)).select("doc_id", "concept_id", "coverage", "rank_score", "role")


@query("agg.order", f"WITH {MERGED} SELECT doc_id, concept_id, role, row_number() OVER (PARTITION BY doc_id ORDER BY role, rank_score DESC, coverage DESC, round(semantic, 9) DESC, confidence DESC, concept_id)::INTEGER AS place FROM rl")
def order(spark, d):
    topics = L.roles(scored(spark, d)).withColumn("semantic", rounded("semantic", 9))
    return L.ordered(topics).select("doc_id", "concept_id", "role", "place")


_TEXTS = "texts AS (SELECT doc_id, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM chunked WHERE chunk_id % 6 <> 4 GROUP BY 1, 2)"
_PAYLOAD = f"{MERGED}, {_TEXTS}, w AS (SELECT m.doc_id, m.concept_id, unnest(chunk_ids) AS chunk_id FROM merged m), pay AS (SELECT w.doc_id, w.concept_id, coalesce(list(text ORDER BY w.chunk_id) FILTER (text IS NOT NULL), []) AS texts, coalesce(list_sort(list(w.chunk_id) FILTER (text IS NULL)), []) AS missing FROM w LEFT JOIN texts t USING (doc_id, chunk_id) GROUP BY 1, 2)"


def payload(spark, d):
    told = chunk_arrays(read(spark, d, "documents")).where("chunk_id % 6 <> 4").repartition("doc_id")
    text = F.array_join(F.transform(F.sort_array(F.flatten(F.collect_list("sentences"))), lambda x: x["sentence"]), " ")
    texts = told.groupBy("doc_id", "chunk_id").agg(text.alias("text"))
    return L.handoff(L.merge_topics(judged(spark, d)), texts)


@query("agg.handoff", f"WITH {_PAYLOAD} SELECT doc_id, concept_id, texts, missing FROM pay")
def handoff(spark, d):
    return payload(spark, d)


@query("agg.approved", f"WITH {_PAYLOAD} SELECT doc_id, list_sort(list(concept_id)) AS topics, count(*) AS n_topics, bool_and(len(texts) > 0) AS evidence_available FROM pay WHERE (doc_id + concept_id[2:]::BIGINT) % 3 <> 0 GROUP BY 1")
def approved(spark, d):
    p = payload(spark, d)
    decisions = p.select("doc_id", "concept_id", F.when((F.col("doc_id") + F.substring("concept_id", 2, 9).cast("long")) % 3 != 0, "approved").otherwise("rejected").alias("status"))
    return L.approved(p, decisions)
