"""The flows as queries: documents are the transcripts, benchmark the catalogue, orders the correction memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import flows
from chalkline.plans.bridges import lesson_chunks, read
from chalkline.plans.registry import query
from chalkline.plans.retrieval_queries import questions, requests
from chalkline.plans.retrieval_queries import topics as wanted
from chalkline.plans.terminology_queries import _terms
from chalkline.plans.topics_queries import bench_words, catalogue_terms


def _memory(spark, d):
    """Approved corrections: every third benchmark word without its second letter is written in full again."""
    words = bench_words(spark, d).select(F.explode("w").alias("word")).where("length(word) >= 6").distinct()
    bad = F.concat(F.substring("word", 1, 1), F.expr("substring(word, 3)"))
    return words.select(F.crc32(F.col("word").cast("binary")).alias("memory_id"), bad.alias("key"), F.col("word").alias("correction"), F.array().cast("array<string>").alias("context"), F.lit("approved").alias("status"), F.lit(0.9).alias("confidence"), F.lit(1).alias("times_applied"))


@query("flow.transcripts_to_topics")
def transcripts_to_topics(spark, d):
    lesson = lesson_chunks(read(spark, d, "documents")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "sentences"))).alias("c"))
    text = F.array_join(F.flatten(F.transform("c", lambda x: F.transform(x["sentences"], lambda s: s["sentence"]))), "\n")
    references = bench_words(spark, d).select("concept_id", F.explode("w").alias("word"))
    return flows.transcripts_to_topics(lesson.select("doc_id", text.alias("text")), catalogue_terms(spark, d), references, _terms(spark, d), _memory(spark, d))


@query("flow.topics_to_questions")
def topics_to_questions(spark, d):
    of = questions(spark, d)
    issues = F.when(F.col("question_id") % 17 == 5, F.array(F.lit("footer"))).otherwise(F.array().cast("array<string>"))
    return flows.topics_to_questions(wanted(spark, d), requests(spark, d), of.withColumn("issues", issues).withColumn("corrected", F.col("question_id") % 9 == 4))
