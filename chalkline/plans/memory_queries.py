"""Queries over memory and review tables: the event log plays decisions, orders and documents play stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import resolver as R
from chalkline.operators import snapshots as S
from chalkline.operators import stored
from chalkline.operators.held import new_folder
from chalkline.plans.bridges import read
from chalkline.plans.registry import query

OLD = "old AS (SELECT user_id AS id, event_type AS kind, count(*) AS times_seen, max(value) AS confidence, CASE WHEN user_id % 3 = 0 THEN 'rejected' WHEN user_id % 3 = 1 THEN 'approved' ELSE 'candidate' END AS status, min(event_id) AS created FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)"
NEW = "new AS (SELECT user_id AS id, event_type AS kind, count(*) AS times_seen, max(value) AS confidence, CASE WHEN user_id % 2 = 0 THEN 'approved' ELSE 'candidate' END AS status, min(event_id) AS created FROM events WHERE event_id % 5 = 1 GROUP BY 1, 2)"


def _old(spark, d):
    status = F.when(F.col("user_id") % 3 == 0, "rejected").when(F.col("user_id") % 3 == 1, "approved").otherwise("candidate")
    return _fold(read(spark, d, "events").where("event_id % 2 = 0").withColumn("status", status))


def _new(spark, d):
    return _fold(read(spark, d, "events").where("event_id % 5 = 1").withColumn("status", F.when(F.col("user_id") % 2 == 0, "approved").otherwise("candidate")))


def _fold(e):
    return e.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), "status").agg(F.count("*").alias("times_seen"), F.max("value").alias("confidence"), F.min("event_id").alias("created")).select("id", "kind", "times_seen", "confidence", "status", "created")


_RANK = "list_position(['rejected', 'approved', 'candidate'], {0})"


_UPSERTED = f"""WITH {OLD}, {NEW} SELECT coalesce(o.id, n.id) AS id, coalesce(o.kind, n.kind) AS kind, (coalesce(o.times_seen, 0) + coalesce(n.times_seen, 0))::BIGINT AS times_seen, greatest(o.confidence, n.confidence) AS confidence,
 CASE WHEN o.status IS NULL THEN n.status WHEN n.status IS NULL THEN o.status WHEN {_RANK.format('n.status')} < {_RANK.format('o.status')} THEN n.status ELSE o.status END AS status, coalesce(o.created, n.created) AS created FROM old o FULL JOIN new n ON o.id = n.id AND o.kind = n.kind"""

MERGE = {"times_seen": S.add, "confidence": S.greatest, "status": S.ranked(["rejected", "approved", "candidate"]), "created": S.keep_old}


@query("mem.upsert", _UPSERTED)
def mem_upsert(spark, d):
    return S.upsert(_old(spark, d), _new(spark, d), ["id", "kind"], MERGE)


@query("mem.upsert_stored", _UPSERTED)
def mem_upsert_stored(spark, d):
    """The same through a stored snapshot: the old rows as version 1, the batch as version 2."""
    folder = new_folder(spark)
    stored.create(_old(spark, d), folder, ["id", "kind"])
    stored.upsert_stored(_new(spark, d), folder, MERGE)
    return stored.load(spark, folder)


@query("mem.counter", "WITH t AS (SELECT c_custkey AS id, c_nationkey AS times_applied, NULL::TIMESTAMP AS last_used FROM customer), u AS (SELECT user_id AS id, count(*) AS n, max(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY 1) SELECT t.id, (times_applied + coalesce(n, 0))::BIGINT AS times_applied, coalesce(ts, last_used) AS last_used FROM t LEFT JOIN u USING (id)")
def mem_counter(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("times_applied"), F.lit(None).cast("timestamp").alias("last_used"))
    return S.bump(table, read(spark, d, "events").where("event_type = 'click'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), "id", "times_applied", "last_used")


@query("mem.status", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS score FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def mem_status(spark, d):
    return S.page(read(spark, d, "orders"), (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), [F.desc("o_orderdate"), F.col("o_orderkey")], 25, 50).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"))


_BATCH = "b AS (SELECT sha256(doc_id::VARCHAR) AS cache_key, CASE doc_id % 4 WHEN 0 THEN 'mapped' WHEN 1 THEN 'out_of_syllabus' WHEN 2 THEN 'mapped' ELSE 'other' END AS decision, CASE WHEN doc_id % 4 = 0 THEN 'c' || doc_id % 40 END AS concept_id, 0 AS hit_count FROM documents WHERE doc_id % 3 <> 1)"


def _batch(spark, d):
    k = F.col("doc_id") % 4
    return read(spark, d, "documents").where("doc_id % 3 <> 1").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.when(k.isin(0, 2), "mapped").when(k == 1, "out_of_syllabus").otherwise("other").alias("decision"), F.when(k == 0, F.concat(F.lit("c"), F.col("doc_id") % 40)).alias("concept_id"), F.lit(0).alias("hit_count"))


@query("mem.mapping_upsert", f"WITH {_BATCH}, v AS (SELECT * FROM b WHERE decision IN ('mapped', 'out_of_syllabus') AND ((decision = 'mapped') = (concept_id IS NOT NULL))), o AS (SELECT sha256(doc_id::VARCHAR) AS cache_key, 'mapped' AS decision, 'c1' AS concept_id, (doc_id % 7)::INTEGER AS hit_count FROM documents WHERE doc_id % 2 = 0) SELECT coalesce(o.cache_key, v.cache_key) AS cache_key, coalesce(v.decision, o.decision) AS decision, coalesce(v.concept_id, o.concept_id) AS concept_id, coalesce(o.hit_count, v.hit_count) AS hit_count FROM o FULL JOIN v ON o.cache_key = v.cache_key")
def mapping_upsert(spark, d):
    ok, _ = S.split_valid(_batch(spark, d), {"decision": F.col("decision").isin("mapped", "out_of_syllabus"), "concept": (F.col("decision") == "mapped") == F.col("concept_id").isNotNull(), "key": F.col("cache_key").rlike("^[0-9a-f]{64}$")})
    old = read(spark, d, "documents").where("doc_id % 2 = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("cache_key"), F.lit("mapped").alias("decision"), F.lit("c1").alias("concept_id"), (F.col("doc_id") % 7).cast("int").alias("hit_count"))
    return S.upsert(old, ok, ["cache_key"], {"hit_count": S.keep_old})


@query("mem.human_correct", "WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT c_custkey AS id, coalesce(status, c_mktsegment) AS status, l.id IS NOT NULL AS human_corrected FROM customer LEFT JOIN l ON l.id = c_custkey")
def human_correct(spark, d):
    table = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.lit(False).alias("human_corrected"))
    fixes = read(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("ts"))
    return S.apply_corrections(table, fixes, "id", ["status"], "human_corrected")


_SIG = "sg AS (SELECT user_id AS doc_id, (event_id % 20)::INTEGER AS chunk_id, event_type AS topic FROM events WHERE event_type IN ('error', 'click')), rj AS (SELECT user_id AS doc_id, (event_id % 20)::INTEGER AS chunk_id, event_type AS topic, value AS score, event_id % 2 = 0 AS fallback FROM events WHERE event_type IN ('view', 'signup'))"


@query("res.collect", f"WITH {_SIG}, own AS (SELECT DISTINCT doc_id, chunk_id, topic, 'signal' AS kind FROM sg), sp AS (SELECT r.* FROM rj r WHERE fallback AND NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = r.doc_id AND o.chunk_id = r.chunk_id)) SELECT * FROM own UNION ALL SELECT doc_id, chunk_id, topic, 'rejected' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY score DESC, topic DESC) AS r FROM sp) WHERE r = 1")
def collect(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 20).cast("int").alias("chunk_id"), F.col("event_type").alias("topic"), F.col("value").alias("score"), (F.col("event_id") % 2 == 0).alias("fallback"))
    return R.inputs(e.where(F.col("topic").isin("error", "click")), e.where(F.col("topic").isin("view", "signup")))


@query("res.family", "WITH h AS (SELECT o_custkey AS id, o_orderpriority AS family, count(*) FILTER (o_orderstatus = 'F') AS n_evidence, count(*) FILTER (o_orderstatus = 'O') AS n_context FROM orders GROUP BY 1, 2), b AS (SELECT id, family FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY 2 * n_evidence + n_context DESC, family) AS r FROM h WHERE 2 * n_evidence + n_context >= 2) WHERE r = 1) SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN coalesce(family, c_mktsegment) ELSE c_mktsegment END AS topic, c_nationkey % 2 = 0 AND family IS NULL AS needs_label FROM customer LEFT JOIN b ON b.id = c_custkey")
def family(spark, d):
    hits = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("family")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n_evidence"), F.count_if(F.col("o_orderstatus") == "O").alias("n_context"))
    items = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("topic"), (F.col("c_nationkey") % 2 == 0).alias("generic"))
    return R.family_labels(items, hits)


@query("res.key", "SELECT doc_id, sha256(concat_ws('|', trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')), sha256(trim(lower(text))), array_to_string(list_sort(['c' || doc_id % 7, 'c' || doc_id % 5]), ','), 'm1')) AS key FROM documents")
def res_key(spark, d):
    docs = read(spark, d, "documents").withColumn("short", F.array(F.concat(F.lit("c"), F.col("doc_id") % 7), F.concat(F.lit("c"), F.col("doc_id") % 5)))
    return docs.select("doc_id", R.cache_key(topic="source", evidence="text", shortlist="short", model="m1").alias("key"))


_MEM = "mm AS (SELECT o_orderkey AS memory_id, 't' || o_orderkey % 50 AS topic_key, 'e' || o_custkey % 20 AS evidence_hash, 'k' || o_orderkey % 300 AS cache_key, 'c' || o_orderkey % 40 AS concept_id, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status, o_orderdate AS updated_at FROM orders), it AS (SELECT c_custkey AS id, 't' || c_custkey % 60 AS topic_key, 'e' || c_nationkey AS evidence_hash, 'k' || c_custkey % 400 AS cache_key FROM customer)"


def _mm(spark, d):
    c = lambda p, x: F.concat(F.lit(p), x)
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), c("t", F.col("o_orderkey") % 50).alias("topic_key"), c("e", F.col("o_custkey") % 20).alias("evidence_hash"), c("k", F.col("o_orderkey") % 300).alias("cache_key"), c("c", F.col("o_orderkey") % 40).alias("concept_id"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), F.col("o_orderdate").alias("updated_at"))
    i = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), c("t", F.col("c_custkey") % 60).alias("topic_key"), c("e", F.col("c_nationkey")).alias("evidence_hash"), c("k", F.col("c_custkey") % 400).alias("cache_key"))
    return m, i


@query("res.memory_first", f"WITH {_MEM}, g AS (SELECT * FROM mm WHERE status = 'approved'), a AS (SELECT topic_key, evidence_hash, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_key, evidence_hash ORDER BY updated_at DESC, memory_id) AS r FROM g) WHERE r = 1), b AS (SELECT cache_key, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY updated_at DESC, memory_id) AS r FROM g) WHERE r = 1) SELECT it.id, coalesce(a.concept_id, b.concept_id) AS concept_id, CASE WHEN a.concept_id IS NOT NULL THEN 'evidence' WHEN b.concept_id IS NOT NULL THEN 'cache' END AS source FROM it LEFT JOIN a USING (topic_key, evidence_hash) LEFT JOIN b USING (cache_key)")
def memory_first(spark, d):
    m, i = _mm(spark, d)
    return R.memory_first(i, m)


_REV = "rv AS (SELECT o_orderkey AS review_id, o_custkey AS doc_id, 't' || o_orderkey % 3 AS topic_key, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS status, o_totalprice AS score FROM orders), one AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, topic_key ORDER BY list_position(['approved', 'pending', 'rejected'], status), review_id) AS r FROM rv) WHERE r = 1)"


def _rev(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("doc_id"), F.concat(F.lit("t"), F.col("o_orderkey") % 3).alias("topic_key"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected").alias("status"), F.col("o_totalprice").alias("score"))


@query("res.existing_review", f"WITH {_REV} SELECT c_custkey AS id, review_id, status FROM customer LEFT JOIN one ON one.doc_id = c_custkey AND topic_key = 't' || c_custkey % 3")
def existing_review(spark, d):
    items = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("doc_id"), F.concat(F.lit("t"), F.col("c_custkey") % 3).alias("topic_key"))
    return R.existing_reviews(items, R.one_review_each(_rev(spark, d)))


@query("res.local", "WITH r AS (SELECT l_orderkey AS id, l_orderkey % 100 AS doc_id, 'c' || l_partkey % 40 AS concept_id, max(l_quantity / 50) AS score FROM lineitem GROUP BY 1, 2, 3), t AS (SELECT *, lead(score) OVER (PARTITION BY id ORDER BY score DESC, concept_id) AS n, row_number() OVER (PARTITION BY id ORDER BY score DESC, concept_id) AS k FROM r), l AS (SELECT DISTINCT o_orderkey % 100 AS doc_id, 'c' || o_custkey % 40 AS concept_id FROM orders WHERE o_orderstatus = 'P') SELECT id, concept_id, score FROM t WHERE k = 1 AND score >= 0.60 AND score - coalesce(n, 0.0) >= 0.08 AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = t.doc_id AND l.concept_id = t.concept_id)")
def local(spark, d):
    ranked = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 100).alias("doc_id"), F.concat(F.lit("c"), F.col("l_partkey") % 40).alias("concept_id")).agg(F.max(F.col("l_quantity") / 50).alias("score"))
    lesson = read(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 100).alias("doc_id"), F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("concept_id"))
    return R.accept_local(ranked, lesson)


@query("res.batch", "WITH a AS (SELECT user_id AS id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1) SELECT c_custkey AS id, coalesce(decision, 'pending_review') AS decision FROM customer LEFT JOIN a ON a.id = c_custkey WHERE c_custkey % 2 = 0")
def batch(spark, d):
    answers = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("decision"))
    return R.batch_responses(read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")), answers)


@query("res.validate", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'invalid' WHEN o_orderpriority <> '2-HIGH' AND o_custkey % 4 NOT IN (o_orderkey % 4, 1) THEN 'not_in_shortlist' WHEN o_totalprice / 500000 < 0.70 THEN 'needs_review' ELSE 'accepted' END AS status FROM orders")
def validate(spark, d):
    o = read(spark, d, "orders")
    p = F.col("o_orderpriority")
    rows = o.select(F.col("o_orderkey").alias("id"), F.when(p == "1-URGENT", "other").when(p == "2-HIGH", "out_of_syllabus").otherwise("mapped").alias("decision"), (F.col("o_custkey") % 4).cast("string").alias("concept_id"), F.array((F.col("o_orderkey") % 4).cast("string"), F.lit("1")).alias("shortlist"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return R.validate(rows).select("id", "status")


@query("res.route", "WITH i AS (SELECT o_orderkey AS id, o_custkey % 100 AS doc_id, 'c' || o_orderkey % 40 AS concept_id, * FROM orders), m AS (SELECT DISTINCT c_custkey % 100 AS doc_id, 'c' || c_nationkey AS concept_id FROM customer WHERE c_acctbal > 5000) SELECT id, CASE WHEN o_orderkey % 11 = 0 THEN 'generic' WHEN o_orderkey % 7 = 0 THEN 'memory' WHEN o_orderkey % 5 = 0 THEN 'review' WHEN o_orderkey % 3 = 0 THEN 'cache' WHEN o_orderstatus = 'P' THEN 'no_candidates' WHEN o_orderpriority = '5-LOW' THEN 'local' ELSE 'request' END AS route, EXISTS (SELECT 1 FROM m WHERE m.doc_id = i.doc_id AND m.concept_id = i.concept_id) AS suppressed FROM i")
def route(spark, d):
    k = F.col("o_orderkey")
    items = read(spark, d, "orders").select(k.alias("id"), (F.col("o_custkey") % 100).alias("doc_id"), F.concat(F.lit("c"), k % 40).alias("concept_id"), (k % 11 == 0).alias("generic"), (k % 7 == 0).alias("memory"), (k % 5 == 0).alias("review"), (k % 3 == 0).alias("cache"), (F.col("o_orderstatus") == "P").alias("no_candidates"), (F.col("o_orderpriority") == "5-LOW").alias("local"))
    merged = read(spark, d, "customer").where("c_acctbal > 5000").select((F.col("c_custkey") % 100).alias("doc_id"), F.concat(F.lit("c"), "c_nationkey").alias("concept_id"))
    return R.route(items, merged)


@query("rev.dedup", f"WITH {_REV} SELECT * FROM one")
def dedup(spark, d):
    return R.one_review_each(_rev(spark, d))


@query("rev.promote", f"WITH {_REV} SELECT sha256(topic_key || '|' || doc_id) AS cache_key, 'mapped' AS decision, 'c' || doc_id % 40 AS concept_id FROM one WHERE status = 'approved' AND doc_id % 4 <> 2")
def promote(spark, d):
    ready = R.one_review_each(_rev(spark, d)).where("status = 'approved'").withColumn("concept_id", F.when(F.col("doc_id") % 4 != 2, F.concat(F.lit("c"), F.col("doc_id") % 40)))
    ok, _ = S.split_valid(ready, {"concept": F.col("concept_id").isNotNull()})
    return ok.select(F.sha2(F.concat_ws("|", "topic_key", "doc_id"), 256).alias("cache_key"), F.lit("mapped").alias("decision"), "concept_id")


@query("rev.items", "WITH x AS (SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS priority, 'i' || o_orderkey % 5 AS item, CASE WHEN o_orderkey % 4 = 0 THEN 'rule' ELSE 'model' END AS method FROM orders) SELECT doc_id, item, priority, method FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY priority, method) AS r FROM x WHERE method <> 'rule') WHERE r = 1")
def items(spark, d):
    of = lambda s: F.collect_list(F.when(F.col("o_orderstatus") == s, F.struct(F.concat(F.lit("i"), F.col("o_orderkey") % 5).alias("item"), F.when(F.col("o_orderkey") % 4 == 0, "rule").otherwise("model").alias("method"))))
    nested = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(of("F").alias("unresolved"), of("P").alias("conflicts"), of("O").alias("suggestions"))
    return R.review_items(nested).select("doc_id", "item", "priority", "method")
