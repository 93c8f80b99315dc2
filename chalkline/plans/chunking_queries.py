"""Queries over the chunking operators; vectors are the embeddings table, grouped by label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.operators import chunking as C
from chalkline.plans.bridges import CHUNKS, LESSON, LINES, NUMBERED, SENTENCES, chunks, lesson_sentences, lines, numbered_sentences, read, sentences
from chalkline.plans.registry import query


def _sent(spark, d):
    return numbered_sentences(read(spark, d, "documents"))


@query("chk.sentences", f"WITH {SENTENCES} SELECT doc_id, line_no, sent_no, sentence FROM sentences")
def chk_sentences(spark, d):
    return sentences(lines(read(spark, d, "documents")))


@query("chk.split_long_hard", f"WITH {NUMBERED}, p AS (SELECT doc_id, pos, words, unnest(range((greatest(len(words), 1) - 1) // 42 + 1)) AS k FROM numbered) SELECT doc_id, pos, k::INTEGER AS piece_no, array_to_string(words[k * 42 + 1:k * 42 + 42], ' ') AS piece FROM p")
def split_hard(spark, d):
    return C.split_hard(_sent(spark, d)).select("doc_id", "pos", F.col("piece_no").cast("int").alias("piece_no"), "piece")


_MARKED = "(" + ", ".join(f"'{m}'" for m in C.MARKERS) + ")"
_PAIRED = "(" + ", ".join(f"'{m}'" for m in C.PAIRS) + ")"


def _long(spark, d):
    """Whole lines as sentences, as captions without punctuation come, with a marker in place of some words."""
    words = F.split(F.trim(F.regexp_replace("line", r"[ \t]+", " ")), " ")
    marked = F.transform(words, lambda w, i: F.when((i + F.col("pos")) % 29 == 7, "because,").when((i + F.col("pos")) % 31 == 3, "For").when((i + F.col("pos")) % 31 == 4, "example").otherwise(w))
    rows = lines(read(spark, d, "documents")).where("trim(line) <> ''").select("doc_id", F.col("line_no").alias("pos"), "line")
    return rows.select("doc_id", "pos", marked.alias("words"))


@query("chk.split_long", f"""WITH RECURSIVE {LINES}, l0 AS (SELECT doc_id, line_no AS pos, string_split(trim(regexp_replace(line, '[ \t]+', ' ', 'g')), ' ') AS w0 FROM lines WHERE trim(line) <> ''),
l1 AS (SELECT doc_id, pos, list_transform(w0, lambda w, i: CASE WHEN (i - 1 + pos) % 29 = 7 THEN 'because,' WHEN (i - 1 + pos) % 31 = 3 THEN 'For' WHEN (i - 1 + pos) % 31 = 4 THEN 'example' ELSE w END) AS w FROM l0),
l2 AS (SELECT doc_id, pos, w, len(w) AS n, list_transform(w, lambda x: regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS b FROM l1),
l3 AS (SELECT doc_id, pos, w, n, list_transform(b, lambda x, i: x IN {_MARKED} OR (i > 1 AND b[i - 1] || ' ' || x IN {_PAIRED})) AS m FROM l2),
cut AS (SELECT doc_id, pos, w, n, m, 0 AS k, 0::BIGINT AS s, CASE WHEN n <= 42 THEN n ELSE coalesce(list_max(list_filter(range(30, least(n - 1, 42) + 1), lambda i: m[i + 1])), 42) END AS e FROM l3
 UNION ALL SELECT doc_id, pos, w, n, m, k + 1, e, CASE WHEN n - e <= 42 THEN n ELSE coalesce(list_max(list_filter(range(e + 30, least(n - 1, e + 42) + 1), lambda i: m[i + 1])), e + 42) END FROM cut WHERE e < n)
SELECT doc_id, pos, k::INTEGER AS piece_no, array_to_string(w[s + 1:e], ' ') AS piece FROM cut""")
def split_long(spark, d):
    return C.split_long(_long(spark, d))


_PATTERNS = lambda family: "'" + "|".join(family).replace("'", "''") + "'"


@query("chk.transition", f"WITH {LESSON} SELECT doc_id, pos, CASE WHEN regexp_matches(lower(sentence[1:220]), {_PATTERNS(C.STRONG)}) THEN 'strong' WHEN regexp_matches(lower(sentence[1:220]), {_PATTERNS(C.SOFT)}) THEN 'soft' END AS transition FROM lesson")
def transition(spark, d):
    return lesson_sentences(read(spark, d, "documents")).select("doc_id", "pos", C.transition(F.col("sentence")).alias("transition"))


@query("chk.units")
def units(spark, d):
    told = lesson_sentences(read(spark, d, "documents"))
    return C.units(told.withColumn("n_words", F.size(F.split("sentence", r"\s+"))))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: p[i]::DOUBLE * embedding[i]::DOUBLE))"
_SIM = f"sims AS (SELECT label, vec_id, CASE WHEN p IS NOT NULL THEN {_DOT} END AS similarity FROM (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings))"


def _sims(spark, d):
    return C.neighbour_similarity(read(spark, d, "embeddings"), "label", "vec_id").select("label", "vec_id", "similarity")


@query("chk.neighbour_sim", f"WITH {_SIM} SELECT label, vec_id, round(similarity, 6) AS similarity FROM sims")
def neighbour_sim(spark, d):
    return _sims(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("chk.threshold", f"WITH {_SIM} SELECT label, round(coalesce(greatest(-0.2, least(0.45, quantile_cont(similarity, 0.15))), 0.45), 4) AS threshold FROM sims GROUP BY label")
def threshold(spark, d):
    return C.thresholds(_sims(spark, d), "label", low=-0.2)


_B = f"""{_SIM}, th AS (SELECT label, round(coalesce(greatest(-0.2, least(0.45, quantile_cont(similarity, 0.15))), 0.45), 4) AS threshold FROM sims GROUP BY label),
u AS (SELECT s.*, threshold, CASE WHEN vec_id % 11 = 0 THEN 'strong' WHEN vec_id % 5 = 0 THEN 'soft' END AS transition FROM sims s JOIN th USING (label))"""


@query("chk.boundary", f"""WITH {_B}, v AS (SELECT *, similarity IS NOT NULL AND (coalesce(transition = 'strong', false) OR coalesce(transition = 'soft' AND similarity <= least(0.35, threshold + 0.10), false)) AS announced, coalesce(similarity <= threshold, false) AS shift FROM u)
SELECT label, vec_id, CASE WHEN shift AND announced THEN 'semantic_shift+transition_phrase' WHEN announced THEN 'transition_phrase' WHEN shift THEN 'semantic_shift' END AS reason, CASE WHEN announced THEN transition END AS strength FROM v""")
def boundary(spark, d):
    return _bounded(spark, d).select("label", "vec_id", "reason", "strength")


def _bounded(spark, d):
    s = _sims(spark, d)
    kind = F.when(F.col("vec_id") % 11 == 0, "strong").when(F.col("vec_id") % 5 == 0, "soft")
    return C.boundaries(s.join(C.thresholds(s, "label", low=-0.2), "label").withColumn("transition", kind))


@query("chk.plan")
def plan(spark, d):
    u = _bounded(spark, d).select(F.col("label").cast("long").alias("doc_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("unit_no"), (F.col("vec_id") % 60 + 30).cast("int").alias("n_words"), "similarity", "reason", "strength")
    return C.plan(u)


_P = f"""{CHUNKS}, plans AS (SELECT doc_id, chunk_id, min(pos) AS first_pos, max(pos) AS last_pos, sum(len(words)) AS n_words, CASE WHEN chunk_id % 3 = 1 THEN 'max_size' ELSE 'semantic' END AS reason FROM chunked GROUP BY doc_id, chunk_id)"""


def _plans(spark, d):
    of = chunks(read(spark, d, "documents")).groupBy("doc_id", "chunk_id").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("n_words").alias("n_words"))
    return of.withColumn("reason", F.when(F.col("chunk_id") % 3 == 1, "max_size").otherwise("semantic"))


@query("chk.materialise", f"""WITH {_P}, f AS (SELECT *, coalesce(lag(reason) OVER (PARTITION BY doc_id ORDER BY chunk_id) = 'max_size', false) AS forced FROM plans),
j AS (SELECT f.doc_id, f.chunk_id, n.pos, n.sentence, len(n.words) AS w, n.pos < f.first_pos AS over FROM f JOIN numbered n ON n.doc_id = f.doc_id AND n.pos BETWEEN CASE WHEN forced THEN greatest(0, first_pos - 2) ELSE first_pos END AND last_pos)
SELECT doc_id, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text, sum(w)::BIGINT AS n_words, sum(CASE WHEN over THEN w ELSE 0 END)::BIGINT AS overlap_words FROM j GROUP BY 1, 2""")
def materialise(spark, d):
    return C.materialise(_plans(spark, d), _sent(spark, d))


@query("chk.segments", f"""WITH {_P}, c AS (SELECT doc_id, chunk_id, coalesce(lag(reason) OVER (PARTITION BY doc_id ORDER BY chunk_id) = 'max_size', false) AS is_continuation FROM plans),
s AS (SELECT *, (sum(CASE WHEN is_continuation THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chunk_id))::BIGINT AS segment FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY chunk_id)::INTEGER AS segment_index, count(*) OVER (PARTITION BY doc_id, segment) AS segment_size, min(chunk_id) OVER (PARTITION BY doc_id, segment) AS root_chunk FROM s)
SELECT *, CASE WHEN segment_size = 1 THEN 'single' WHEN segment_index = 1 THEN 'start' WHEN segment_index = segment_size THEN 'end' ELSE 'middle' END AS position FROM p""")
def segments(spark, d):
    return C.segments(_plans(spark, d).select("doc_id", "chunk_id", "reason")).drop("reason")


@query("chk.metrics", f"WITH {_P} SELECT doc_id, count(*) AS n_chunks, min(n_words)::BIGINT AS min_words, avg(n_words) AS mean_words, max(n_words)::BIGINT AS max_words, sum(n_words)::BIGINT AS words FROM plans GROUP BY doc_id")
def metrics(spark, d):
    return C.metrics(_plans(spark, d))


@query("chk.validate", f"""WITH {_P}, g AS (SELECT *, coalesce(lag(last_pos) OVER (PARTITION BY doc_id ORDER BY chunk_id), -1) + 1 <> first_pos AS gap FROM plans WHERE chunk_id % 7 <> 3)
SELECT doc_id, chunk_id, 'gap' AS rule FROM g WHERE gap UNION ALL SELECT doc_id, chunk_id, 'too_long' FROM g WHERE n_words > 100 UNION ALL SELECT doc_id, chunk_id, 'empty' FROM g WHERE n_words = 0""")
def validate(spark, d):
    return C.violations(_plans(spark, d).where("chunk_id % 7 <> 3"), 100)
