"""Queries over retrieval: embeddings are questions; every 50 vectors make a request of five topics, those of its first five.

Thresholds are scaled to these vectors (their cosines are near zero), as configuration allows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.operators import retrieval as R
from chalkline.operators.held import cut
from chalkline.operators.vectors import hash_encode
from chalkline.plans.bridges import VECTORS, read, vectors
from chalkline.plans.registry import query

BASE = f"""{VECTORS}, tp AS (SELECT vec_id // 50 AS request_id, (vec_id % 50)::INTEGER AS topic_index, reference, section, CASE WHEN vec_id % 50 < 2 THEN 'primary' ELSE 'supporting' END AS role, CASE WHEN vec_id % 50 < 2 THEN 1.0 ELSE 0.65 END::DOUBLE AS role_weight, ((vec_id * 7) % 10 / 10.0)::DOUBLE AS confidence, ((vec_id * 3) % 10 / 10.0)::DOUBLE AS rank_score, embedding AS query, vec_id % 50 = 0 AS required FROM vectors WHERE vec_id % 50 < 5),
rq AS (SELECT DISTINCT request_id, 5 AS n_questions, 20 AS target_marks, 3 AS min_primary, 1 AS min_supporting, 2 AS min_references, [min(reference) FILTER (required) OVER (PARTITION BY request_id)] AS required_refs FROM tp),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, topic_index ORDER BY score DESC, question_id)::INTEGER AS rank FROM (SELECT t.request_id, t.topic_index, v.vec_id AS question_id, v.reference, v.marks, round(list_sum(list_transform(range(1, 65), lambda i: t.query[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM tp t JOIN vectors v USING (reference))) WHERE rank <= 20),
sh AS (SELECT t.* FROM tp t LEFT JOIN (SELECT request_id, topic_index, count(*) AS n FROM ex GROUP BY 1, 2) c USING (request_id, topic_index) WHERE coalesce(n, 0) < 17),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, topic_index ORDER BY score DESC, question_id)::INTEGER AS rank FROM (SELECT t.request_id, t.topic_index, v.vec_id AS question_id, v.reference, v.marks, round(list_sum(list_transform(range(1, 65), lambda i: t.query[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6) AS score FROM sh t JOIN vectors v ON v.section = t.section AND v.reference <> t.reference)) WHERE rank <= 10)"""
SCORED = f"""{BASE}, al AS (SELECT *, 'exact' AS method FROM ex UNION ALL SELECT *, 'fallback' FROM fb),
sc AS (SELECT a.*, t.role, t.confidence, round(0.55 * a.score + 0.15 * t.confidence + 0.10 * t.rank_score + 0.20 * t.role_weight + CASE WHEN method = 'exact' THEN 0.15 ELSE -0.12 END + CASE WHEN question_id % 9 = 4 THEN 0.02 ELSE 0.0 END, 9) AS final_score FROM al a JOIN tp t USING (request_id, topic_index))"""
QUOTA = f"""{SCORED}, j AS (SELECT t.request_id, t.topic_index, t.role, t.role_weight, t.required::INTEGER AS base, n_questions, min_primary, min_supporting FROM tp t JOIN rq USING (request_id)),
l AS (SELECT *, greatest(0, CASE WHEN role = 'primary' THEN min_primary ELSE min_supporting END - sum(base) OVER (PARTITION BY request_id, role)) AS lft, count(*) OVER (PARTITION BY request_id, role) AS c, row_number() OVER (PARTITION BY request_id, role ORDER BY role_weight DESC, topic_index) AS p FROM j),
b AS (SELECT *, lft // c + CASE WHEN p <= lft % c THEN 1 ELSE 0 END AS by_role FROM l),
r AS (SELECT *, greatest(0, n_questions - sum(base + by_role) OVER (PARTITION BY request_id)) AS rest, count(*) OVER (PARTITION BY request_id) AS m, row_number() OVER (PARTITION BY request_id ORDER BY role_weight DESC, topic_index) AS q FROM b),
qu AS (SELECT request_id, topic_index, role, (base + by_role + rest // m + CASE WHEN q <= rest % m THEN 1 ELSE 0 END)::INTEGER AS quota FROM r)"""
GATED = f"""{QUOTA}, ag AS (SELECT request_id, topic_index, min(final_score) AS least, max(final_score) AS most, round(median(final_score), 9) AS median, quantile_cont(final_score, 0.6) AS p60, count(*) AS n, list(final_score ORDER BY final_score DESC) AS s FROM sc GROUP BY 1, 2),
ab AS (SELECT ag.*, quota, greatest(0.30, least(0.70, greatest(p60, most - 0.10))) AS b, s[greatest(quota, 1)] AS q FROM ag JOIN qu USING (request_id, topic_index)),
ad AS (SELECT request_id, topic_index, least, most, median, n, round(CASE WHEN q >= 0.30 AND q < b THEN q ELSE b END, 9) AS threshold, CASE WHEN q >= 0.30 AND q < b THEN 'lowered_to_quota' WHEN q IS NULL THEN 'too_few' ELSE 'percentile' END AS reason FROM ab),
is1 AS (SELECT sc.*, threshold, CASE WHEN question_id % 17 = 5 THEN ['footer'] ELSE [] END AS issues FROM sc JOIN ad USING (request_id, topic_index)),
ga AS (SELECT *, list_sort(list_distinct(issues || CASE WHEN final_score + 1e-9 < threshold THEN ['below_threshold'] ELSE [] END)) AS reasons, len(list_distinct(issues || CASE WHEN final_score + 1e-9 < threshold THEN ['below_threshold'] ELSE [] END)) = 0 AS passed FROM is1)"""


def topics(spark, d):
    v = vectors(spark, d).where("vec_id % 50 < 5")
    k = F.col("vec_id") % 50
    return v.select(F.expr("vec_id div 50").alias("request_id"), k.cast("int").alias("topic_index"), "reference", "section", F.when(k < 2, "primary").otherwise("supporting").alias("role"), F.when(k < 2, 1.0).otherwise(0.65).alias("role_weight"), ((F.col("vec_id") * 7) % 10 / 10.0).alias("confidence"), ((F.col("vec_id") * 3) % 10 / 10.0).alias("rank_score"), F.col("embedding").alias("query"), (k == 0).alias("required"))


def requests(spark, d):
    refs = topics(spark, d).groupBy("request_id").agg(F.array(F.min(F.when(F.col("required"), F.col("reference")))).alias("required_refs"))
    return refs.select("request_id", F.lit(5).alias("n_questions"), F.lit(20).alias("target_marks"), F.lit(3).alias("min_primary"), F.lit(1).alias("min_supporting"), F.lit(2).alias("min_references"), "required_refs")


def questions(spark, d):
    return vectors(spark, d).withColumnRenamed("vec_id", "question_id")


def ex(spark, d):
    return R.exact(topics(spark, d), questions(spark, d))


def fb(spark, d):
    return R.fallback(topics(spark, d), ex(spark, d), questions(spark, d), 17)


def scored(spark, d):
    """All found questions with their scores, written once: profile and gate read them, and the fallback the exact ones."""
    found = cut(ex(spark, d))
    more = R.fallback(topics(spark, d), found, questions(spark, d), 17)
    every = found.withColumn("method", F.lit("exact")).unionByName(more.withColumn("method", F.lit("fallback")))
    joined = every.join(topics(spark, d).select(*R.TOPIC, "role", "role_weight", "confidence", "rank_score"), R.TOPIC).withColumn("corrected", F.col("question_id") % 9 == 4)
    return cut(joined.withColumn("final_score", R.retrieval_score()))


def quota(spark, d):
    return R.quotas(topics(spark, d), requests(spark, d))


def profile(spark, d, rows=None):
    return R.adaptive(scored(spark, d) if rows is None else rows, quota(spark, d), low=0.30)


def gated(spark, d):
    issues = F.when(F.col("question_id") % 17 == 5, F.array(F.lit("footer"))).otherwise(F.array().cast("array<string>"))
    rows = scored(spark, d)
    return R.gate(rows.withColumn("issues", issues), profile(spark, d, rows))


@query("ret.topics", "WITH h AS (SELECT o_custkey AS request_id, o_orderkey AS topic_index, CASE WHEN o_orderkey % 7 <> 3 THEN o_orderpriority END AS reference, CASE o_orderstatus WHEN 'F' THEN 'primary' WHEN 'O' THEN 'supporting' ELSE 'other' END AS role, o_totalprice / 480000 AS confidence FROM orders), m AS (SELECT *, max(CASE WHEN role = 'primary' THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS p FROM h) SELECT request_id, topic_index, reference, role, confidence FROM m WHERE reference IS NOT NULL AND role IN ('primary', 'supporting') AND confidence BETWEEN 0 AND 1 AND p = 1")
def ret_topics(spark, d):
    k = F.col("o_orderkey")
    ref = F.when(k % 7 != 3, F.col("o_orderpriority"))
    role = F.when(F.col("o_orderstatus") == "F", "PRIMARY").when(F.col("o_orderstatus") == "O", "Supporting").otherwise("other")
    h = read(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("topic_index"), F.when(k % 3 == 0, ref).alias("official_reference"), F.when(k % 3 == 1, ref).alias("reference"), F.when(k % 3 == 2, ref).alias("ref"), F.when(k % 2 == 0, role).alias("role"), F.when(k % 2 == 1, role).alias("topic_role"), F.when(k % 2 == 0, F.col("o_totalprice") / 480000).alias("confidence"), F.when(k % 2 == 1, F.col("o_totalprice") / 480000).alias("score"))
    return R.normal_topics(h)[0]


@query("ret.map_official", f"WITH {BASE} SELECT request_id, topic_index, reference, role, m.section, role_weight FROM (SELECT * EXCLUDE (section) FROM tp) t LEFT JOIN (SELECT DISTINCT reference, section FROM vectors WHERE reference % 4 <> 2) m USING (reference)")
def map_official(spark, d):
    mapping = vectors(spark, d).where("reference % 4 <> 2")
    return R.map_official(topics(spark, d).drop("section", "role_weight"), mapping).select("request_id", "topic_index", "reference", "role", "section", "role_weight")


@query("ret.request", "SELECT o_orderkey AS request_id, list_filter([CASE WHEN o_custkey % 6 < 1 THEN 'n' END, CASE WHEN o_orderkey % 9 < o_custkey % 6 THEN 'marks' END, CASE WHEN o_orderkey % 4 > o_custkey % 6 THEN 'primary' END, CASE WHEN o_orderkey % 3 > o_custkey % 6 THEN 'supporting' END, CASE WHEN o_orderkey % 4 + o_orderkey % 3 > o_custkey % 6 THEN 'roles' END, CASE WHEN o_orderkey % 5 > o_custkey % 6 THEN 'references' END], lambda x: x IS NOT NULL) AS problems, CASE WHEN o_custkey % 6 >= 3 THEN 'all_topics' ELSE 'best_topics' END AS coverage_mode FROM orders")
def ret_request(spark, d):
    k = F.col("o_orderkey")
    r = read(spark, d, "orders").select(k.alias("request_id"), (F.col("o_custkey") % 6).alias("n_questions"), (k % 9).alias("target_marks"), (k % 4).alias("min_primary"), (k % 3).alias("min_supporting"), (k % 5).alias("min_references"), F.lit(3).alias("n_topics"))
    return R.request_problems(r).select("request_id", "problems", "coverage_mode")


@query("ret.evidence", "WITH t AS (SELECT conv_id AS doc_id, turn AS chunk_id, text FROM conversations), p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own ' || lang WHEN doc_id % 3 = 1 THEN ' ' END AS own, source AS summary FROM documents), c AS (SELECT p.doc_id, string_agg(t.text, chr(10) ORDER BY t.chunk_id) AS c FROM p JOIN t ON t.doc_id = p.doc_id AND t.chunk_id IN (0, 2, 1) GROUP BY 1) SELECT p.doc_id AS request_id, 0 AS topic_index, coalesce(nullif(trim(own), ''), nullif(trim(c), ''), summary)[1:4000] AS evidence, CASE WHEN nullif(trim(own), '') IS NOT NULL THEN 'own' WHEN nullif(trim(c), '') IS NOT NULL THEN 'chunks' ELSE 'summary' END AS source FROM p LEFT JOIN c USING (doc_id)")
def evidence(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.lit(0).alias("topic_index"), "doc_id", F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long")).alias("chunk_ids"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own "), "lang")).when(F.col("doc_id") % 3 == 1, " ").alias("own_text"), F.col("source").alias("summary"))
    return R.evidence_text(t, read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_id"), "text"))


@query("ret.query_text", "SELECT doc_id, 'Topic: ' || source || chr(10) || 'Title: ' || lang || chr(10) || text AS query FROM documents")
def query_text(spark, d):
    return read(spark, d, "documents").select("doc_id", R.query_text("source", "lang", "text").alias("query"))


query("ret.exact", f"WITH {BASE} SELECT * FROM ex")(ex)
query("ret.fallback", f"WITH {BASE} SELECT * FROM fb")(fb)


@query("ret.score", f"WITH {SCORED} SELECT request_id, topic_index, question_id, method, final_score FROM sc")
def ret_score(spark, d):
    return scored(spark, d).select("request_id", "topic_index", "question_id", "method", "final_score")


@query("ret.dedup_exact", "WITH q AS (SELECT doc_id % 8 AS request_id, doc_id AS question_id, CASE doc_id % 3 WHEN 0 THEN 'c' || md5(text) WHEN 1 THEN 'v' || (n_chars % 50) ELSE concat_ws('|', 't', lang || n_chars % 40, doc_id % 4) END AS k, round(n_chars / 20000.0, 6) AS final_score FROM documents) SELECT request_id, question_id, final_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id, k ORDER BY final_score DESC, question_id) AS r FROM q) WHERE r = 1")
def dedup_exact(spark, d):
    k = F.col("doc_id") % 3
    rows = read(spark, d, "documents").select((F.col("doc_id") % 8).alias("request_id"), F.col("doc_id").alias("question_id"), F.when(k == 0, F.md5("text")).otherwise("").alias("content_hash"), F.when(k == 1, (F.col("n_chars") % 50).cast("string")).alias("vector_hash"), F.concat("lang", F.col("n_chars") % 40).alias("text"), (F.col("doc_id") % 4).alias("marks"), F.round(F.col("n_chars") / 20000.0, 6).alias("final_score"), F.lit(0.5).alias("score"))
    return R.dedup_exact(rows).select("request_id", "question_id", "final_score")


@query("ret.canonical_text", "SELECT doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(lower(text), chr(10)), lambda x: NOT regexp_matches(x, '^\\s*(?:topic|section|page)\\b.*$') AND trim(x) <> ''), ' '), '[^a-z0-9+*/=<>. ]', ' ', 'g'), ' +', ' ', 'g')) AS canonical FROM documents")
def canonical(spark, d):
    return read(spark, d, "documents").select("doc_id", R.canonical_text(F.col("text")).alias("canonical"))


@query("ret.jaccard", "WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM documents) SELECT a.doc_id, CASE WHEN len(list_distinct(a.w || b.w)) = 0 THEN 1.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) END AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def ret_jaccard(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.array_distinct(F.filter(F.split("text", " "), lambda x: x != "")).alias("w"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(b, "doc_id").select("doc_id", R.jaccard(F.col("w"), F.col("v")).alias("jaccard"))


def near_rows(spark, d):
    """All documents are the candidates of one request each forty ids long; texts are made once for all steps."""
    docs = read(spark, d, "documents")
    rows = cut(docs.select(F.expr("doc_id div 40").alias("request_id"), F.col("doc_id").alias("question_id"), F.lit(1).alias("marks"), R.canonical_text(F.col("text")).alias("text"), F.col("doc_id").alias("place")))
    return rows.withColumn("words", F.array_distinct(F.split("text", " ")))


@query("ret.neardup")
def neardup(spark, d):
    """A text's hashed words are its vector."""
    return R.greedy_dups(R.near_pairs(near_rows(spark, d), added=lambda met: met.withColumn("embedding", hash_encode(F.col("words"), 64, 1))))


@query("ret.text_quality", """SELECT doc_id, list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing' END, CASE WHEN len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) < 8 THEN 'too_short' END, CASE WHEN lower(string_split_regex(trim(text), '\\s+')[-1]) IN ('the', 'of', 'and', 'a', 'to') THEN 'trailing_fragment' END,
 CASE WHEN regexp_matches(text, '[A-Za-z]-(\\n|$)') THEN 'truncated_segment' END, CASE WHEN regexp_matches(text, '(?i)\\b(?:page|copyright|all rights reserved)\\b') THEN 'footer' END, CASE WHEN regexp_matches(text, '[#%$&*]{3,}') THEN 'parser_noise' END], lambda x: x IS NOT NULL) AS issues FROM documents""")
def text_quality(spark, d):
    return read(spark, d, "documents").select("doc_id", R.text_issues(F.col("text")).alias("issues"))


query("ret.quota", f"WITH {QUOTA} SELECT * FROM qu")(quota)
query("ret.adaptive", f"WITH {GATED} SELECT * FROM ad")(profile)


@query("ret.gate", f"WITH {GATED} SELECT request_id, topic_index, question_id, reasons, passed FROM ga")
def ret_gate(spark, d):
    return gated(spark, d).select("request_id", "topic_index", "question_id", "reasons", "passed")


@query("ret.pool_check", f"WITH {GATED}, a AS (SELECT request_id, count(*) AS n, count(*) FILTER (role = 'primary') AS n_primary, count(*) FILTER (role <> 'primary') AS n_supporting, list(DISTINCT reference) AS refs FROM ga WHERE passed GROUP BY 1) SELECT rq.request_id, coalesce(n, 0) AS n, coalesce(n_primary, 0) AS n_primary, coalesce(n_supporting, 0) AS n_supporting, len(coalesce(refs, []))::INTEGER AS n_references, coalesce(n >= n_questions AND n_primary >= min_primary AND n_supporting >= min_supporting AND len(refs) >= min_references AND list_has_all(refs, required_refs), false) AS ok FROM rq LEFT JOIN a USING (request_id)")
def pool_check(spark, d):
    return R.pool_check(gated(spark, d).where("passed"), requests(spark, d))


@query("ret.rescue")
def rescue(spark, d):
    return R.rescue(gated(spark, d), requests(spark, d), floor=0.2).select("request_id", "topic_index", "question_id", "passed", "rescued")


@query("ret.gate_summary", f"WITH {GATED} SELECT request_id, count(*) AS n, count(*) FILTER (passed) AS n_passed, min(threshold) AS min_threshold, max(threshold) AS max_threshold, round(avg(threshold), 9) AS mean_threshold, count(*) FILTER (list_contains(reasons, 'below_threshold')) AS n_below, count(*) FILTER (len(issues) > 0) AS n_quality FROM ga GROUP BY 1")
def gate_summary(spark, d):
    return R.gate_summary(gated(spark, d))


def selected(spark, d):
    pool = R.rescue(gated(spark, d), requests(spark, d), floor=0.2).where("passed or rescued is not null")
    return R.select(pool, requests(spark, d))


query("ret.select")(selected)


@query("ret.select_stats")
def select_stats(spark, d):
    return R.selection_stats(selected(spark, d), requests(spark, d))




def _sel(spark, d):
    """A request's questions, each by its best topic."""
    best = F.row_number().over(Window.partitionBy("request_id", "question_id").orderBy(F.desc("final_score"), "topic_index"))
    return scored(spark, d).withColumn("best", best).where("best = 1").select("request_id", "question_id", "reference", "marks", "role", "final_score")


@query("ret.assemble", f"WITH {SCORED}, s AS (SELECT request_id, question_id, reference, final_score FROM sc QUALIFY row_number() OVER (PARTITION BY request_id, question_id ORDER BY final_score DESC, topic_index) = 1) SELECT request_id, question_id, reference, final_score, d.lang, r.section, e.quality, row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, question_id)::INTEGER AS place FROM s JOIN documents d ON d.doc_id = question_id JOIN (SELECT DISTINCT reference, section FROM vectors) r USING (reference) LEFT JOIN labels e ON e.doc_id = question_id")
def assemble(spark, d):
    q = read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), "lang")
    t = vectors(spark, d).select("reference", "section").distinct()
    e = read(spark, d, "labels").select(F.col("doc_id").alias("question_id"), "quality")
    return R.assemble(_sel(spark, d).drop("marks", "role"), q, t, e).select("request_id", "question_id", "reference", "final_score", "lang", "section", "quality", "place")


@query("ret.pages", "SELECT p_partkey AS question_id, CASE WHEN p_size % 3 = 0 THEN list_sort(list_distinct([p_size, p_size % 7, p_size])) ELSE range(p_size, p_size + p_partkey % 4 + 1) END AS pages FROM part")
def pages(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("question_id"), F.when(F.col("p_size") % 3 == 0, F.array("p_size", F.col("p_size") % 7, "p_size")).alias("visual_pages"), F.col("p_size").alias("first_page"), (F.col("p_size") + F.col("p_partkey") % 4).cast("int").alias("last_page"))
    return R.pages(p).select("question_id", "pages")


def schemes(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("Names "), "p_name", F.when(k % 3 == 0, F.lit("; A. ")).otherwise(F.lit("\n")), "p_type", F.when(k % 4 == 0, F.lit(" R.\nnone\nnone")).otherwise(F.lit("\nI. spelling\nExample one\nmore")))
    return read(spark, d, "part").select(k.alias("question_id"), text.alias("scheme"))


_MS = """ms AS (SELECT p_partkey AS question_id, 'Names ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '; A. ' ELSE chr(10) END || p_type || CASE WHEN p_partkey % 4 = 0 THEN ' R.' || chr(10) || 'none' || chr(10) || 'none' ELSE chr(10) || 'I. spelling' || chr(10) || 'Example one' || chr(10) || 'more' END AS scheme FROM part),
br AS (SELECT question_id, string_split(regexp_replace(scheme, ';\\s*((?:A|R|I)\\.)', ';' || chr(10) || '\\1', 'g'), chr(10)) AS l FROM ms), ro AS (SELECT question_id, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS raw FROM br),
dg AS (SELECT *, lag(regexp_extract(raw, '(?:^|\\s)((?:A|R|I)\\.)\\s*$', 1)) OVER (PARTITION BY question_id ORDER BY line_no) AS b FROM ro),
ml AS (SELECT question_id, line_no, trim(concat_ws(' ', nullif(b, ''), trim(regexp_replace(raw, '(?:^|\\s)(?:A|R|I)\\.\\s*$', '')))) AS line FROM dg),
mk AS (SELECT *, CASE WHEN line LIKE 'A.%' THEN 'accept' WHEN line LIKE 'R.%' THEN 'reject' WHEN line LIKE 'I.%' THEN 'ignore' WHEN regexp_matches(line, '(?i)^example') THEN 'example' END AS label FROM ml WHERE line <> '')"""


@query("ret.ms_lines", f"WITH {_MS} SELECT * FROM mk")
def ms_lines(spark, d):
    return R.scheme_lines(schemes(spark, d))


@query("ret.ms_blocks", f"WITH {_MS}, bl AS (SELECT *, sum(CASE WHEN label IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY question_id ORDER BY line_no)::BIGINT AS block FROM mk), o AS (SELECT question_id, block, line, min(line_no) AS k, arg_min(label, line_no) AS label FROM bl GROUP BY 1, 2, 3) SELECT question_id, block, coalesce(max(label), 'marking') AS label, list(line ORDER BY k) AS lines FROM o GROUP BY 1, 2")
def ms_blocks(spark, d):
    return R.scheme_blocks(R.scheme_lines(schemes(spark, d)))


_SIGNALS = (("has_points", 2, 0.30), ("marks_equal", 3, 0.20), ("exact_link", 5, 0.15), ("has_labels", 7, 0.10), ("long_enough", 4, 0.10), ("no_warning", 6, 0.05), ("same_part", 9, 0.05), ("clean_text", 8, 0.03), ("reviewed", 10, 0.02))


@query("ret.ms_confidence", f"WITH c AS (SELECT p_partkey AS question_id, round({' + '.join(f'CASE WHEN p_partkey % {m} <> 0 THEN {w}::DOUBLE ELSE 0.0 END' for _, m, w in _SIGNALS)}, 6) AS confidence FROM part) SELECT *, CASE WHEN confidence >= 0.80 THEN 'auto' WHEN confidence >= 0.55 THEN 'review' ELSE 'reject' END AS status FROM c")
def ms_confidence(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("question_id"), *[(F.col("p_partkey") % m != 0).alias(n) for n, m, _ in _SIGNALS])
    return R.scheme_confidence(rows).select("question_id", "confidence", "status")


@query("ret.release", "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 4 = 0 THEN 'ready' WHEN o_orderkey % 4 = 1 OR o_orderkey % 5 = 0 THEN 'needs_decision' ELSE 'evaluation' END AS release FROM orders")
def release(spark, d):
    k = F.col("o_orderkey")
    b = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.when(k % 4 == 1, F.lit("incomplete")), F.when(k % 5 == 0, F.lit("missing_scheme")), F.lit("low_confidence"))))
    return R.release(read(spark, d, "orders").select(k.alias("request_id"), b.alias("blockers"))).select("request_id", "release")


@query("ret.package")
def package(spark, d):
    return R.package(selected(spark, d).withColumn("place", F.col("question_id").cast("int")))
