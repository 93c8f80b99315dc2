"""Queries over topic mapping: lessons made of documents, in fixed chunks, against the catalogue made of benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import topics as T
from chalkline.plans.bridges import ALIASES, LESSON, aliases, chunks, concepts, lesson_chunks, lesson_sentences, read
from chalkline.plans.registry import query


def _sql(family):
    return "'" + "|".join(family).replace("'", "''") + "'"


TOK = f"""{LESSON}, tok AS (SELECT *, list_filter(string_split(low, ' '), lambda x: x <> '') AS t FROM (SELECT *, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS low FROM lesson)),
p1 AS (SELECT doc_id, chunk_id, pos, t, unnest(range(len(t)))::INTEGER AS start FROM tok),
grams AS (SELECT doc_id, chunk_id, pos, start, 1 AS n, t[start + 1] AS gram FROM p1 UNION ALL SELECT doc_id, chunk_id, pos, start, 2, t[start + 1] || ' ' || t[start + 2] FROM p1 WHERE start + 2 <= len(t))"""
HITS = f"{TOK}, {ALIASES}, hits AS (SELECT g.doc_id, g.chunk_id, g.pos, g.start, g.n, a.alias, a.concept_id, a.ambiguous FROM grams g JOIN aliases a ON a.alias = g.gram AND a.n_words = g.n)"
VALID = f"""{HITS}, x AS (SELECT 'c' || item_id AS concept_id, w[2] || ' ' || w[3] AS phrase FROM bw WHERE len(w) >= 3), bad AS (SELECT g.doc_id, g.chunk_id, g.pos, g.start, g.n, x.concept_id FROM grams g JOIN x ON x.phrase = g.gram AND g.n = 2),
valid AS (SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = h.doc_id AND b.chunk_id = h.chunk_id AND b.pos = h.pos AND b.concept_id = h.concept_id AND h.start < b.start + b.n AND h.start + h.n > b.start))"""
KW = f"""{VALID}, kw AS (SELECT doc_id, chunk_id, concept_id, count(DISTINCT alias) AS n_aliases, count(DISTINCT pos) AS n_sentences, count(*) AS n_hits, bool_and(n = 1) AS single_only, bool_and(ambiguous) AS ambiguous_only,
 round(least(1.0::DOUBLE, max(CASE n WHEN 1 THEN 0.50::DOUBLE WHEN 2 THEN 0.72 ELSE 0.82 END) + 0.08::DOUBLE * (count(DISTINCT alias) - 1) + 0.05::DOUBLE * least(3, count(DISTINCT pos) - 1) + 0.02::DOUBLE * least(4, count(*) - 1)), 6) AS keyword_score FROM valid GROUP BY 1, 2, 3)"""
_SLOT = "(('0x' || md5({0})[1:8])::BIGINT % 384)::INTEGER"
SEM = f"""{KW}, cf AS (SELECT doc_id, chunk_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_id)) AS v FROM (SELECT doc_id, chunk_id, {_SLOT.format("gram")} AS slot, count(*) AS n FROM grams WHERE n = 1 GROUP BY 1, 2, 3)),
ff AS (SELECT concept_id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY concept_id)) AS v FROM (SELECT concept_id, {_SLOT.format("word")} AS slot, count(*) AS n FROM (SELECT 'c' || item_id AS concept_id, unnest(w) AS word FROM bw) GROUP BY 1, 2)),
alike AS (SELECT doc_id, chunk_id, concept_id, round(sum(cf.v * ff.v), 6) AS semantic_score FROM cf JOIN ff USING (slot) GROUP BY 1, 2, 3), sem AS (SELECT alike.* FROM alike JOIN kw USING (doc_id, chunk_id, concept_id)),
blocked AS (SELECT doc_id, chunk_id, concept_id FROM hits EXCEPT SELECT doc_id, chunk_id, concept_id FROM valid), lone AS (SELECT * FROM alike WHERE semantic_score >= 0.50 AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.doc_id = alike.doc_id AND kw.chunk_id = alike.chunk_id AND kw.concept_id = alike.concept_id)
  AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.doc_id = alike.doc_id AND b.chunk_id = alike.chunk_id AND b.concept_id = alike.concept_id)),
terms AS (SELECT 'c' || item_id AS concept_id, unnest([w[3], w[4]]) AS term, unnest(['supporting', 'conflicting']) AS kind FROM bw WHERE len(w) >= 4),
ctx AS (SELECT g.doc_id, g.chunk_id, t.concept_id, coalesce(list_sort(list(DISTINCT gram) FILTER (kind = 'supporting')), []) AS supporting, coalesce(list_sort(list(DISTINCT gram) FILTER (kind = 'conflicting')), []) AS conflicting FROM grams g JOIN terms t ON t.term = g.gram AND g.n = 1 GROUP BY 1, 2, 3)"""
CAND = f"""{SEM}, c1 AS (SELECT kw.*, coalesce(semantic_score, 0.0) AS semantic_score, len(coalesce(supporting, []))::INTEGER AS n_context, len(coalesce(conflicting, []))::INTEGER AS n_conflicting FROM kw LEFT JOIN sem USING (doc_id, chunk_id, concept_id) LEFT JOIN ctx USING (doc_id, chunk_id, concept_id)
  UNION ALL BY NAME SELECT doc_id, chunk_id, concept_id, semantic_score, 0.0 AS keyword_score, 0 AS n_aliases, 0 AS n_sentences, 0 AS n_hits, false AS single_only, false AS ambiguous_only, 0 AS n_context, 0 AS n_conflicting FROM lone),
c2 AS (SELECT *, CASE WHEN ambiguous_only THEN semantic_score >= 0.50 AND n_context >= 1 WHEN single_only THEN semantic_score >= 0.45 OR n_sentences >= 2 OR n_aliases >= 2 ELSE true END AS gate,
 round(0.55 * greatest(0.0, least(1.0, semantic_score)) + 0.25 * least(1.0, n_sentences / 3.0::DOUBLE) + 0.20 * least(1.0, n_aliases / 2.0::DOUBLE), 9) AS salience FROM c1),
c3 AS (SELECT *, round(greatest(0.58 * semantic_score + 0.42 * keyword_score, CASE WHEN single_only THEN 0.72 ELSE 0.88 END * keyword_score, 0.82 * semantic_score) * (0.85 + 0.15 * salience), 6) AS confidence FROM c2),
cand AS (SELECT *, CASE WHEN keyword_score = 0 THEN 'semantic' WHEN semantic_score >= 0.20 THEN 'hybrid' ELSE 'keyword' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY confidence DESC, salience DESC, semantic_score DESC, keyword_score DESC, concept_id)::INTEGER AS rank FROM c3 WHERE gate AND confidence >= 0.30) WHERE rank <= 12)"""
_HAS = lambda f: f"regexp_matches(low, {_sql(f)})"
DEP = f"dep AS (SELECT doc_id, chunk_id, pos, CASE WHEN low = '' THEN 0 WHEN {_HAS(T.PRACTICE)} AND ({_HAS(T.WORKED_EXAMPLE)} OR {_HAS(T.EXPLANATION)}) THEN 4 WHEN {_HAS(T.WORKED_EXAMPLE)} THEN 3 WHEN {_HAS(T.EXPLANATION)} THEN 2 WHEN {_HAS(T.DEFINITION)} THEN 1 WHEN {_HAS(T.MENTION)} THEN 0 ELSE 1 END AS depth, {_HAS(T.RECAP)} AS recap_like FROM tok)"
_CMP = f"""fl AS (SELECT doc_id, chunk_id, flatten(list(t ORDER BY pos)) AS flat FROM tok GROUP BY 1, 2), off AS (SELECT doc_id, chunk_id, pos, coalesce(sum(len(t)) OVER (PARTITION BY doc_id, chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM tok),
near AS (SELECT h.*, regexp_matches(array_to_string(flat[greatest(0, o + start - 16) + 1:o + start + n + 16], ' '), {_sql(T.COMPARISON)}) AS c FROM {{0}} h JOIN fl USING (doc_id, chunk_id) JOIN off USING (doc_id, chunk_id, pos) WHERE n > 1),
cmp AS (SELECT doc_id, chunk_id, concept_id, count(*) AS n_long_hits, count(*) FILTER (c) AS n_compared FROM near GROUP BY 1, 2, 3)"""
EVID = f"""{CAND}, {DEP}, {_CMP.format("valid")}, sv AS (SELECT doc_id, chunk_id, pos, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_id, pos)) AS v FROM (SELECT doc_id, chunk_id, pos, {_SLOT.format("gram")} AS slot, count(*) AS n FROM grams WHERE n = 1 GROUP BY 1, 2, 3, 4)),
un AS (SELECT c.doc_id, c.chunk_id, c.concept_id, sv.pos, round(sum(sv.v * ff.v), 6) AS score FROM cand c JOIN sv ON sv.doc_id = c.doc_id AND sv.chunk_id = c.chunk_id JOIN ff ON ff.concept_id = c.concept_id AND ff.slot = sv.slot WHERE c.method = 'semantic' GROUP BY 1, 2, 3, 4),
us AS (SELECT doc_id, chunk_id, concept_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id, concept_id ORDER BY score DESC, pos) AS r FROM un) WHERE r = 1),
es AS (SELECT DISTINCT v.doc_id, v.chunk_id, v.concept_id, v.pos, depth, recap_like FROM (SELECT doc_id, chunk_id, concept_id, pos FROM valid UNION ALL SELECT * FROM us) v JOIN cand USING (doc_id, chunk_id, concept_id) JOIN dep ON dep.doc_id = v.doc_id AND dep.chunk_id = v.chunk_id AND dep.pos = v.pos),
sh AS (SELECT *, recap_like AND count(*) OVER (PARTITION BY doc_id, chunk_id, pos) >= 3 AS shared FROM es),
ev AS (SELECT doc_id, chunk_id, concept_id, list_sort(list(pos)) AS evidence, count(*) FILTER (shared) AS n_recap, count(*) FILTER (NOT shared) AS n_substantive, coalesce(max(depth) FILTER (NOT shared), 0) AS deepest, count(*) FILTER (NOT shared AND depth >= 1) AS om, count(*) FILTER (NOT shared AND depth >= 2) AS ex FROM sh GROUP BY 1, 2, 3),
q1 AS (SELECT c.*, evidence, n_recap, n_substantive, CASE WHEN n_substantive >= 3 AND ex >= 2 OR n_substantive >= 2 AND om >= 2 AND deepest >= 2 THEN 4 ELSE deepest END AS max_depth, n_recap > 0 AND n_substantive = 0 AS recap_only, coalesce(n_long_hits > 0 AND n_compared = n_long_hits AND n_long_hits <= 2, false) AS comparison_only,
 n_conflicting > 0 AND ambiguous_only AND n_context < 1 AS collision FROM cand c JOIN ev USING (doc_id, chunk_id, concept_id) LEFT JOIN cmp USING (doc_id, chunk_id, concept_id)),
q2 AS (SELECT *, 0.45::DOUBLE * ([0.34::DOUBLE, 0.50, 0.68, 0.84, 0.95])[max_depth + 1] + 0.25::DOUBLE * salience + 0.20::DOUBLE * greatest(0.0, least(1.0, semantic_score)) + 0.10::DOUBLE * CASE WHEN n_context >= 1 THEN 1.0::DOUBLE WHEN collision THEN 0.20 WHEN ambiguous_only THEN 0.35 ELSE 0.70 END AS raw FROM q1),
q3 AS (SELECT *, CASE WHEN max_depth = 0 THEN least(raw, 0.34::DOUBLE) ELSE raw END AS capped FROM q2),
q4 AS (SELECT *, CASE WHEN n_recap > 0 THEN greatest(0.0, capped - 0.18::DOUBLE * n_recap / greatest(1, n_recap + n_substantive)) ELSE capped END AS less FROM q3),
q5 AS (SELECT *, CASE WHEN comparison_only THEN greatest(0.0, less - 0.16::DOUBLE) ELSE less END AS q FROM q4),
qual AS (SELECT *, round(q, 4) AS quality, round(0.72::DOUBLE * confidence + 0.28::DOUBLE * q, 4) AS adjusted FROM q5)"""


def term_hits(spark, d, kinds, **more):
    """Hits of the catalogue's terms of some kinds."""
    return T.chunk_hits(lesson_chunks(read(spark, d, "documents")), catalogue_terms(spark, d).where(F.col("kind").isin(*kinds)), **more)


def hits(spark, d):
    return _as_aliases(term_hits(spark, d, ["alias"]))


def _as_aliases(found):
    return found.select(*T.CHUNK, "pos", "start", "n", F.col("gram").alias("alias"), "concept_id", "ambiguous")


def bench_words(spark, d):
    return read(spark, d, "benchmark").select(F.concat(F.lit("c"), "item_id").alias("concept_id"), T.words_of(F.col("text")).alias("w"))


def catalogue_terms(spark, d):
    """gram, kind, concept_id, ambiguous: aliases, excluded phrases, supporting and conflicting words of the catalogue."""
    term = lambda gram, kind: F.struct(gram.alias("gram"), F.lit(kind).alias("kind"))
    w = bench_words(spark, d)
    at = lambda k: F.get("w", F.lit(k - 1))
    more = w.where(F.size("w") >= 3).select("concept_id", F.explode(F.array(
        term(F.array_join(F.slice("w", 2, 2), " "), "excluded"), term(at(3), "supporting"), term(at(4), "conflicting"))).alias("x"), F.size("w").alias("size"))
    rest = more.where("x.kind = 'excluded' or size >= 4").select("x.gram", "x.kind", "concept_id", F.lit(False).alias("ambiguous"))
    return aliases(concepts(spark, d)).select(F.col("alias").alias("gram"), F.lit("alias").alias("kind"), "concept_id", "ambiguous").unionByName(rest.distinct())


def lexical(spark, d):
    """Candidates that an alias names."""
    return T.chunk_evidence(lesson_chunks(read(spark, d, "documents")), catalogue_terms(spark, d), concept_words(spark, d), None)


def concept_words(spark, d):
    return bench_words(spark, d).select("concept_id", F.explode("w").alias("word"))


def candidates(spark, d):
    return T.extract(T.chunk_evidence(lesson_chunks(read(spark, d, "documents")), catalogue_terms(spark, d), concept_words(spark, d), T.SEMANTIC_ONLY, top=T.KEPT), None)


def judged(spark, d):
    told = T.judge(candidates(spark, d))
    return told.withColumn("evidence", F.transform("evidence", lambda e: e["pos"]))


query("map.phrase", f"WITH {HITS} SELECT * FROM hits")(hits)


@query("map.exclude", f"WITH {VALID} SELECT * FROM valid")
def exclude(spark, d):
    return _as_aliases(term_hits(spark, d, ["alias", "excluded"]).where("kind = 'alias' and not blocked"))


PATTERNS = (("c1", "double", "the [a-z]+ing", 0.6), ("c2", "end", "tion[.]$", 0.4))


@query("map.pattern", f"WITH {LESSON}, p AS (SELECT * FROM (VALUES ('c1', 'double', 'the [a-z]+ing', 0.6::DOUBLE), ('c2', 'end', 'tion[.]$', 0.4::DOUBLE)) t(concept_id, label, regex, weight)) SELECT doc_id, chunk_id, pos, concept_id, label, weight, len(CASE concept_id WHEN 'c1' THEN regexp_extract_all(sentence, 'the [a-z]+ing') ELSE regexp_extract_all(sentence, 'tion[.]$') END)::INTEGER AS hits FROM lesson JOIN p ON CASE concept_id WHEN 'c1' THEN regexp_matches(sentence, 'the [a-z]+ing') ELSE regexp_matches(sentence, 'tion[.]$') END")
def pattern(spark, d):
    return T.pattern_hits(lesson_sentences(read(spark, d, "documents")), PATTERNS)


@query("map.context", f"WITH {SEM} SELECT * FROM ctx")
def context(spark, d):
    return T.context_terms(lesson_chunks(read(spark, d, "documents")), catalogue_terms(spark, d))


@query("map.keyword_score", f"WITH {KW} SELECT * FROM kw")
def keyword_score(spark, d):
    terms = catalogue_terms(spark, d).where("kind in ('alias', 'excluded')")
    found = T.chunk_evidence(lesson_chunks(read(spark, d, "documents")), terms, concept_words(spark, d).where("false"), None).where("n_hits > 0")
    return found.select(*T.CANDIDATE, "n_aliases", "n_sentences", "n_hits", "single_only", "ambiguous_only", "keyword_score")


_SCORED = ["doc_id", "chunk_id", "concept_id"]


@query("map.salience_gate", f"WITH {CAND} SELECT doc_id, chunk_id, concept_id, gate FROM c2 WHERE keyword_score > 0")
def gate(spark, d):
    return _c1(spark, d).select(*_SCORED, T.salience_gate(F.col("n_context")).alias("gate"))


def _c1(spark, d):
    found = lexical(spark, d).where("n_hits > 0").fillna({"semantic_score": 0.0})
    return found.withColumn("n_context", F.size("supporting"))


@query("map.salience", f"WITH {CAND} SELECT doc_id, chunk_id, concept_id, salience FROM c2 WHERE keyword_score > 0")
def map_salience(spark, d):
    return _c1(spark, d).select(*_SCORED, T.salience().alias("salience"))


@query("map.confidence", f"WITH {CAND} SELECT doc_id, chunk_id, concept_id, confidence FROM c3 WHERE keyword_score > 0")
def map_confidence(spark, d):
    return _c1(spark, d).withColumn("salience", T.salience()).select(*_SCORED, T.confidence().alias("confidence"))


@query("map.extract", f"WITH {CAND} SELECT doc_id, chunk_id, concept_id, keyword_score, semantic_score, salience, confidence, method, rank FROM cand")
def extract(spark, d):
    return candidates(spark, d).select(*_SCORED, "keyword_score", "semantic_score", "salience", "confidence", "method", "rank")


@query("map.redundancy")
def redundancy(spark, d):
    """The catalogue's first concept of a section is the parent of the others, and the section is their reference."""
    of = concepts(spark, d).select("concept_id", "label", F.col("section").alias("reference"))
    parents = of.groupBy("reference").agg(F.min("concept_id").alias("parent"))
    family = of.join(parents, "reference").withColumn("parent", F.when(F.col("parent") != F.col("concept_id"), F.col("parent")))
    return T.drop_redundant(judged(spark, d).join(T.small(family), "concept_id")).drop("alias_stems", "label_stems")


@query("map.relevance", f"WITH {CAND}, nw AS (SELECT doc_id, chunk_id, sum(len(words)) AS n_words FROM chunked GROUP BY 1, 2), a AS (SELECT doc_id, chunk_id, count(*) FILTER (confidence >= 0.46) AS n_kept, least(3, count(*) FILTER (confidence < 0.46)) AS n_rejected, max(confidence) AS best, max(n_words)::BIGINT AS n_words FROM cand JOIN nw USING (doc_id, chunk_id) GROUP BY 1, 2) SELECT *, round(CASE WHEN n_kept > 0 THEN least(0.95, best + least(0.06, 0.02 * (n_kept - 1))) ELSE 0.0 END, 6) AS score, n_kept = 0 AND n_words >= 80 AND best >= 0.34 AS fallback FROM a")
def relevance(spark, d):
    words = chunks(read(spark, d, "documents")).groupBy("doc_id", "chunk_id").agg(F.sum("n_words").alias("n_words"))
    return T.relevance(candidates(spark, d).join(words, ["doc_id", "chunk_id"]))


@query("map.depth", f"WITH {TOK}, {DEP} SELECT doc_id, chunk_id, pos, depth FROM dep")
def map_depth(spark, d):
    return lesson_sentences(read(spark, d, "documents")).select("doc_id", "chunk_id", "pos", T.depths(F.col("sentence")).alias("depth"))


@query("map.recap", f"WITH {HITS}, {DEP}, m AS (SELECT doc_id, chunk_id, pos, count(DISTINCT concept_id) AS n_concepts FROM hits GROUP BY 1, 2, 3) SELECT m.* FROM m JOIN dep USING (doc_id, chunk_id, pos) WHERE n_concepts >= 3 AND recap_like")
def recap(spark, d):
    return T.recaps(term_hits(spark, d, ["alias"], recap=True))


@query("map.comparison", f"WITH {HITS}, {_CMP.format('hits')} SELECT *, n_compared = n_long_hits AND n_long_hits <= 2 AS comparison_only FROM cmp")
def comparison(spark, d):
    return T.comparisons(term_hits(spark, d, ["alias"], sizes=(2,), compare=True))


@query("map.quality", f"WITH {EVID} SELECT doc_id, chunk_id, concept_id, max_depth, recap_only, comparison_only, collision, quality, adjusted FROM qual")
def map_quality(spark, d):
    return judged(spark, d).select(*_SCORED, "max_depth", "recap_only", "comparison_only", "collision", "quality", "adjusted")


_REASON = "CASE WHEN collision THEN 'context_collision' WHEN ambiguous_only AND n_context = 0 THEN 'ambiguous_without_context' WHEN recap_only THEN 'recap_only' WHEN comparison_only THEN 'comparison_only' WHEN max_depth = 0 THEN 'mention_only' WHEN adjusted < 0.46 THEN 'low_score' END"


@query("map.reject_reason", f"WITH {EVID} SELECT doc_id, chunk_id, concept_id, {_REASON} AS reason FROM qual")
def map_reason(spark, d):
    return judged(spark, d).select(*_SCORED, "reason")


@query("map.competition")
def competition(spark, d):
    kept = judged(spark, d).where("reason is null")
    return T.compete(kept.withColumn("evidence", F.transform("evidence", lambda p: F.struct(p.alias("pos")))))


#: families of topics outside the catalogue, and domains: the rest of benchmark's words and the texts of its last items
_FAMILIES = f"fam AS (SELECT 'f' || item_id % 6 AS rough_topic, w[5] AS alias FROM bw WHERE len(w) >= 5 UNION SELECT 'f' || item_id % 6, w[6] FROM bw WHERE len(w) >= 6), seen AS (SELECT g.doc_id, g.chunk_id, g.pos, g.gram, f.rough_topic FROM grams g JOIN fam f ON f.alias = g.gram WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = g.doc_id AND h.chunk_id = g.chunk_id AND h.pos = g.pos AND h.alias = g.gram)), lex AS (SELECT doc_id, chunk_id, rough_topic, count(DISTINCT gram) AS n_aliases, count(*) AS n_hits, min(pos) AS pos, round(least(0.95::DOUBLE, 0.40::DOUBLE + 0.12::DOUBLE * count(DISTINCT gram) + 0.04::DOUBLE * count(*)), 6) AS score FROM seen GROUP BY 1, 2, 3 HAVING count(DISTINCT gram) >= 2 AND count(*) >= 3)"
_FAM = f"{HITS}, {_FAMILIES}"
_SIG = f"""{EVID}, {_FAMILIES}, done AS (SELECT DISTINCT doc_id, chunk_id, pos FROM es JOIN (SELECT doc_id, chunk_id, concept_id FROM qual WHERE {_REASON} IS NULL) USING (doc_id, chunk_id, concept_id)), sf AS (SELECT doc_id, chunk_id, pos, slot, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, chunk_id, pos)) AS v FROM (SELECT doc_id, chunk_id, pos, {_SLOT.format("gram")} AS slot, count(*) AS n FROM grams WHERE n = 1 GROUP BY 1, 2, 3, 4)),
df AS (SELECT domain, slot, n / sqrt(sum(n * n) OVER (PARTITION BY domain)) AS v FROM (SELECT domain, {_SLOT.format("word")} AS slot, count(*) AS n FROM (SELECT 'd' || item_id % 9 AS domain, unnest(w) AS word FROM bw) GROUP BY 1, 2)),
sc AS (SELECT doc_id, chunk_id, pos, domain, round(sum(sf.v * df.v), 6) AS score FROM (FROM sf ANTI JOIN done USING (doc_id, chunk_id, pos)) sf JOIN df USING (slot) GROUP BY 1, 2, 3, 4),
bs AS (SELECT doc_id, chunk_id, pos, max(domain) FILTER (score = top) AS domain, max(score) AS score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, chunk_id, pos) AS top FROM sc) GROUP BY 1, 2, 3 HAVING max(score) >= 0.48),
sg AS (SELECT doc_id, chunk_id, domain, count(*) AS n_sentences, max(score) AS score, min(pos) AS pos FROM bs GROUP BY 1, 2, 3 QUALIFY sum(count(*)) OVER (PARTITION BY doc_id, chunk_id) >= 2 OR max(max(score)) OVER (PARTITION BY doc_id, chunk_id) >= 0.60),
bo AS (SELECT doc_id, chunk_id, rough_topic AS topic, score, 'lexical' AS method FROM lex UNION ALL SELECT doc_id, chunk_id, domain::VARCHAR, score, 'semantic' FROM sg WHERE NOT EXISTS (SELECT 1 FROM lex l WHERE l.doc_id = sg.doc_id AND l.chunk_id = sg.chunk_id AND l.pos = sg.pos)),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, method, topic)::INTEGER AS rank FROM bo) WHERE rank <= 4)"""


def _lex(spark, d):
    w = bench_words(spark, d).withColumn("rough_topic", F.concat(F.lit("f"), F.substring("concept_id", 2, 9).cast("int") % 6))
    fam = w.where(F.size("w") >= 5).select("rough_topic", F.element_at("w", 5).alias("alias")).union(w.where(F.size("w") >= 6).select("rough_topic", F.element_at("w", 6).alias("alias"))).distinct()
    return T.unmapped_lexical(lesson_chunks(read(spark, d, "documents")), fam, aliases(concepts(spark, d)))


def _sem(spark, d):
    """Sentences that no accepted candidate covers against every domain, by hashed words."""
    domains = bench_words(spark, d).select(F.concat(F.lit("d"), F.substring("concept_id", 2, 9).cast("int") % 9).alias("domain"), F.explode("w").alias("word"))
    covered = judged(spark, d).where("reason is null").select(*T.CHUNK, F.explode("evidence").alias("pos"))
    return T.unmapped_semantic(T.sentence_scores(lesson_chunks(read(spark, d, "documents")), domains, "domain", 0.48), covered)


@query("map.unmapped_lexical", f"WITH {_FAM} SELECT * FROM lex")
def unmapped_lexical(spark, d):
    return _lex(spark, d)


@query("map.unmapped_semantic", f"WITH {_SIG} SELECT * FROM sg")
def unmapped_semantic(spark, d):
    return _sem(spark, d)


@query("map.unmapped_merge", f"WITH {_SIG} SELECT * FROM sig")
def unmapped_merge(spark, d):
    return T.merge_signals(_lex(spark, d), _sem(spark, d))


_CLASSES = f"""{EVID}, ch AS (SELECT DISTINCT doc_id, chunk_id FROM chunked), k AS (SELECT doc_id, chunk_id, coalesce(list_sort(list(concept_id) FILTER ({_REASON} IS NULL)), []) AS concepts, count(*) FILTER ({_REASON} IS NOT NULL) AS n_rejected FROM qual GROUP BY 1, 2),
cl AS (SELECT ch.*, coalesce(concepts, []) AS concepts, coalesce(n_rejected, 0) AS n_rejected, CASE WHEN chunk_id % 4 = 2 THEN 1 ELSE 0 END AS n_signals, CASE WHEN chunk_id % 3 = 1 THEN 9 ELSE 0 END AS overlap_words FROM ch LEFT JOIN k USING (doc_id, chunk_id)),
lg AS (SELECT *, coalesce(lag(concepts) OVER (PARTITION BY doc_id ORDER BY chunk_id), []) AS b FROM cl),
cls AS (SELECT *, CASE WHEN overlap_words > 0 AND len(b) > 0 AND len(list_filter(concepts, lambda x: NOT list_contains(b, x))) = 0 THEN 'continuation' WHEN len(concepts) > 0 THEN 'mapped' WHEN n_signals > 0 THEN 'unmapped' WHEN n_rejected > 0 THEN 'weak' ELSE 'off_topic' END AS class FROM lg)"""


def _classes(spark, d):
    base = chunks(read(spark, d, "documents")).select("doc_id", "chunk_id").distinct()
    j = judged(spark, d)
    k = j.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.when(F.col("reason").isNull(), F.col("concept_id")))).alias("concepts"), F.count_if(F.col("reason").isNotNull()).alias("n_rejected"))
    full = base.join(k, ["doc_id", "chunk_id"], "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>"))).fillna({"n_rejected": 0})
    full = full.withColumn("n_signals", F.when(F.col("chunk_id") % 4 == 2, 1).otherwise(0)).withColumn("overlap_words", F.when(F.col("chunk_id") % 3 == 1, 9).otherwise(0))
    return T.classify(full)


@query("map.classify", f"WITH {_CLASSES} SELECT doc_id, chunk_id, concepts, class FROM cls")
def classify(spark, d):
    return _classes(spark, d).select("doc_id", "chunk_id", "concepts", "class")


@query("map.chain_topics", f"WITH {_CLASSES}, r AS (SELECT *, coalesce(max(CASE WHEN class <> 'continuation' THEN chunk_id END) OVER (PARTITION BY doc_id ORDER BY chunk_id), chunk_id) AS root FROM cls) SELECT r.doc_id, r.chunk_id, r.root, CASE WHEN len(r.concepts) = 0 THEN coalesce(s.concepts, r.concepts) ELSE r.concepts END AS effective FROM r LEFT JOIN r s ON s.doc_id = r.doc_id AND s.chunk_id = r.root AND s.chunk_id = s.root")
def chain_topics(spark, d):
    return T.chain_topics(_classes(spark, d)).select("doc_id", "chunk_id", "root", "effective")


@query("map.fallback", f"WITH {_SIG}, g AS (SELECT *, score - lead(score) OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, topic) AS gap FROM sig) SELECT doc_id, chunk_id, bool_or((method = 'semantic' AND score < 0.82) OR (method = 'lexical' AND score < 0.70)) OR coalesce(min(gap) < 0.04, false) AS fallback FROM g GROUP BY 1, 2")
def fallback(spark, d):
    return T.needs_fallback(T.merge_signals(_lex(spark, d), _sem(spark, d)))


@query("map.lesson_counts", f"WITH {_CLASSES} SELECT doc_id, count(*) FILTER (class = 'mapped') AS n_mapped, count(*) FILTER (class = 'continuation') AS n_continuation, count(*) FILTER (class = 'unmapped') AS n_unmapped, count(*) FILTER (class = 'weak') AS n_weak, count(*) FILTER (class = 'off_topic') AS n_off_topic, count(*) FILTER (class IN ('mapped', 'continuation')) AS n_relevant, coalesce(list_sort(list(chunk_id) FILTER (class = 'weak')), []) AS fallback_ids FROM cls GROUP BY doc_id")
def lesson_counts(spark, d):
    return T.lesson_counts(_classes(spark, d))


@query("cat.validate", f"""WITH {ALIASES}, c AS (SELECT concept_id, [{{'alias': label, 'ambiguous': false}}, {{'alias': w[2], 'ambiguous': true}}] AS al FROM concepts), n AS (SELECT *, concept_id[2:]::BIGINT AS k FROM c),
all_c AS (SELECT concept_id, al FROM n UNION ALL SELECT concept_id, al FROM n WHERE k % 5 = 0 UNION ALL SELECT 'x' || k, al FROM n WHERE k % 7 = 0 UNION ALL SELECT 'e' || k, [] FROM n WHERE k % 9 = 0),
f AS (SELECT DISTINCT concept_id, a.alias AS alias FROM (SELECT concept_id, unnest(al) AS a FROM all_c) WHERE NOT a.ambiguous)
SELECT concept_id, 'duplicate_id' AS rule FROM all_c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT concept_id, 'no_alias' FROM all_c WHERE len(al) = 0 UNION ALL SELECT DISTINCT concept_id, 'shared_alias' FROM f WHERE alias IN (SELECT alias FROM f GROUP BY 1 HAVING count(*) > 1)""")
def cat_validate(spark, d):
    """The catalogue with some entries twice, some aliases in two entries and some entries without any."""
    c = concepts(spark, d).select("concept_id", "aliases").withColumn("k", F.substring("concept_id", 2, 9).cast("long"))
    again, renamed = c.where("k % 5 = 0"), c.where("k % 7 = 0").withColumn("concept_id", F.concat(F.lit("x"), "k"))
    bare = c.where("k % 9 = 0").withColumn("concept_id", F.concat(F.lit("e"), "k")).withColumn("aliases", F.slice("aliases", 1, 0))
    return T.catalogue_errors(c.unionByName(again).unionByName(renamed).unionByName(bare))


@query("cat.index", f"WITH {ALIASES} SELECT section, list_sort(list(concept_id)) AS concept_ids, array_to_string(list_sort(list(label)), '; ') AS text FROM concepts GROUP BY 1")
def cat_index(spark, d):
    return T.catalogue_index(concepts(spark, d))
