"""The engine's flows as one call each: transcripts to lesson topics, topics and a request to a question set.

Steps that several later ones read (sentences, placed units, chunks, evidence) are checkpointed to the shared folder, which
cuts the lineage and keeps plans small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from chalkline.operators import chunking, cleaning, lessons, retrieval, terminology, topics
from chalkline.operators.evidence import Slots
from chalkline.operators.held import cut
from chalkline.operators.ordered import walk_groups


def corrected(sentences: DataFrame, vocabulary: DataFrame, memory: DataFrame, anchors: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """sentences (doc_id, pos, sentence) with spoken code written out and the approved corrections of suspicious spans made,
    each where its span stands.

    vocabulary: key, n_words; memory and anchors: as for ``terminology``.  Nothing is corrected that nobody approved.
    """
    written = cut(terminology.spoken_dots(sentences).select("doc_id", "pos", F.col("fixed").alias("sentence")))
    spans = terminology.pick_spans(terminology.detect(written, vocabulary, anchors=anchors))
    asked = cut(spans.select(F.struct("doc_id", "pos", "begin", "stop").alias("id"), F.col("original").alias("key"), F.array().cast("array<string>").alias("context")))  # read twice
    known = terminology.memory_lookup(asked, memory).select("id.doc_id", "id.pos", F.col("id.begin").alias("start"), "id.stop", F.col("correction").alias("replacement"))
    place = ("doc_id", "pos")
    return terminology.apply_spans(written.withColumnRenamed("sentence", "text"), known, place).select(*place, F.col("text").alias("sentence"))


def sentences_of(texts: DataFrame) -> DataFrame:
    """(doc_id, text), a row a document -> doc_id, pos, sentence: cut at lines, closing punctuation and, where overlong, discourse
    markers."""
    cut = F.flatten(F.transform(F.split("text", "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+")))
    bare = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " "))), lambda s: s != "")
    return chunking.split_numbered(texts.select("doc_id", F.explode(bare).alias("sentence")))


def _neighbours(told: Sequence[list[str]], slots: Slots) -> list[float]:
    """Likeness of each list of words to the one before: the products of ``hash_encode``'s values, added up in the slots' order."""
    flat = np.array([slots[w] for words in told for w in words], np.int64)
    owner = np.repeat(np.arange(len(told)), [len(words) for words in told])
    counts = np.bincount(owner * slots.width + flat, minlength=len(told) * slots.width).reshape(len(told), -1).astype(float)
    norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    values = counts / np.where(norm > 0, norm, 1.0)
    return np.cumsum(values[:-1] * values[1:], axis=1)[:, -1].tolist()


def semantic_chunks(sentences: DataFrame, width: int = 128) -> DataFrame:
    """sentences (doc_id, pos, sentence) -> doc_id, chunk_id, reason and sentences (array of (pos, sentence)): units, likeness of
    neighbours by hashed words, boundaries and the chunk plan, in one walk that holds a document's sentences."""
    slots, of_units, of_plans = Slots(width), chunking.unit_walk(), chunking.plan_walk()

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        told = list(rows)  # pos, sentence, n_words, transition, low
        units, words, at = list(of_units((r[0], r[2], r[3]) for r in told)), [], 0
        edges = []
        for _, _, last, _, _ in units:
            begin = at
            while at < len(told) and told[at][0] <= last:
                at += 1
            edges.append((begin, at))
            words.append(" ".join(r[4] for r in told[begin:at]).split())
        alike = [None, *_neighbours(words, slots)]
        limit = chunking.threshold(alike[1:])
        bounds = [chunking.boundary(a, limit, u[4]) for a, u in zip(alike, units)]
        for number, first, last, _, why, _ in of_plans((u[3], a, *b) for u, a, b in zip(units, alike, bounds)):
            yield number, why, [r[:2] for r in told[edges[first][0] : edges[last][1]]]

    kind = sentences.schema["pos"].dataType
    made = StructType([StructField("chunk_id", IntegerType()), StructField("reason", StringType()), StructField("sentences", ArrayType(StructType([StructField("pos", kind), StructField("sentence", StringType())])))])
    rows = sentences.select("doc_id", "pos", "sentence", F.size(F.split("sentence", " ")).alias("n_words"), chunking.transition(F.col("sentence")).alias("t"), topics.normalised(F.col("sentence")).alias("low"))
    return walk_groups(rows, ["doc_id"], ["pos"], ["pos", "sentence", "n_words", "t", "low"], made, walk)


def mapped_topics(chunks: DataFrame, terms: DataFrame, references: DataFrame) -> DataFrame:
    """chunks (sentences) against the catalogue -> candidates that are kept: doc_id, chunk_id, concept_id with all scores.

    terms: gram, kind, concept_id, ambiguous; references: concept_id, word (the words of each concept's text).
    """
    judged = topics.judge(topics.extract(topics.chunk_evidence(chunks, terms, references, topics.SEMANTIC_ONLY, top=topics.KEPT), None))
    kept = cut(judged.where("reason is null"))
    won = topics.compete(kept).where("won").select(*topics.CANDIDATE, F.col("adjusted").alias("final"))
    positions: Column = F.transform("evidence", lambda e: e["pos"])
    return kept.join(won, topics.CANDIDATE).withColumn("confidence", F.col("final")).withColumn("evidence", positions).drop("final")


def transcripts_to_topics(transcripts: DataFrame, terms: DataFrame, references: DataFrame, vocabulary: DataFrame, memory: DataFrame) -> DataFrame:
    """(doc_id, text) -> topics of each lesson: doc_id, concept_id, confidence, coverage, rank_score, role, place, chunk_ids.

    Clean, correct, chunk, map, merge and rank; rejected transcripts (no text left) have no topics.
    """
    clean = cleaning.clean_transcripts(transcripts).where(~F.col("rejected")).select("doc_id", "text")
    chunks = cut(semantic_chunks(corrected(sentences_of(clean), vocabulary, memory)))
    merged = lessons.rank_scores(lessons.merge_topics(mapped_topics(chunks, terms, references)))
    return lessons.ordered(lessons.roles(merged)).select("doc_id", "concept_id", "confidence", "coverage", "rank_score", "role", "place", "chunk_ids")


def topics_to_questions(wanted: DataFrame, requests: DataFrame, questions: DataFrame, fewest: int = 17, low: float = 0.30, floor: float = 0.2) -> DataFrame:
    """Topics with queries, requests and indexed questions -> the chosen questions of every request.

    Exact and fallback search, retrieval score, adaptive thresholds under the quotas, gate, rescue and selection.  wanted:
    request_id, topic_index, reference, section, role, role_weight, confidence, rank_score, query, required; questions:
    question_id, embedding, section, reference, marks, issues, corrected.
    """
    flags = questions.select("question_id", "issues", "corrected")
    exact = retrieval.exact(wanted, questions)
    more = retrieval.fallback(wanted, exact, questions, fewest)
    exact, more = cut(exact), cut(more)
    found = exact.withColumn("method", F.lit("exact")).unionByName(more.withColumn("method", F.lit("fallback")))
    joined = found.join(wanted.select(*retrieval.TOPIC, "role", "role_weight", "confidence", "rank_score"), retrieval.TOPIC).join(flags, "question_id")
    scored = cut(joined.withColumn("final_score", retrieval.retrieval_score()))
    profile = retrieval.adaptive(scored, retrieval.quotas(wanted, requests), low=low)
    pool = retrieval.rescue(retrieval.gate(scored, profile), requests, floor=floor).where("passed or rescued is not null")
    return retrieval.select(pool, requests)
