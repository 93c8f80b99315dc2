"""Queries over embeddings: every 50th vector is asked against all."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from chalkline.operators import vectors as V
from chalkline.operators.snapshots import upsert
from chalkline.plans.bridges import VECTORS, read, vectors
from chalkline.plans.registry import query

DOT = "round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)), 6)"
SCORED = f"scored AS (SELECT q.vec_id AS query_id, v.vec_id, v.section, v.reference, v.marks, q.section AS q_section, q.reference AS q_reference, {DOT} AS score FROM vectors q, vectors v WHERE q.vec_id % 50 = 0)"


def asked(spark, d):
    return vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("section").alias("q_section"), F.col("reference").alias("q_reference"))


def hashed_words(rows):
    """Unit vectors of 16 hashed word counts."""
    out = []
    for text in rows:
        counts = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in text.split()], minlength=16)
        out.append((counts / np.sqrt(counts @ counts)).tolist())
    return out


@query("emb.encode", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM documents), c AS (SELECT doc_id, (('0x' || md5(w)[1:8])::BIGINT % 16)::INTEGER AS slot, count(*) AS n FROM w GROUP BY 1, 2),
t AS (SELECT doc_id, min(slot) FILTER (n = top)::INTEGER AS slot FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM c) GROUP BY 1) SELECT doc_id, CASE WHEN slot IS NOT NULL THEN 16 END AS width, CASE WHEN slot IS NOT NULL THEN true END AS unit, slot FROM documents LEFT JOIN t USING (doc_id)""")
def encode(spark, d):
    e = V.encode(read(spark, d, "documents").select("doc_id", "text"), hashed_words)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("doc_id", F.size("embedding").alias("width"), (F.abs(norm - 1) < 1e-5).alias("unit"), (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("slot"))


_HW = "w AS (SELECT item_id, unnest(range(len(w)))::INTEGER AS pos, unnest(w) AS word FROM (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark))"


@query("emb.hash_encode", f"""WITH {_HW}, g AS (SELECT item_id, word AS gram FROM w UNION ALL SELECT * FROM (SELECT item_id, word || ' ' || lead(word) OVER (PARTITION BY item_id ORDER BY pos) AS gram FROM w) WHERE gram IS NOT NULL),
c AS (SELECT item_id, (('0x' || md5(gram)[1:8])::BIGINT % 384)::INTEGER AS slot, count(*) AS n FROM g GROUP BY 1, 2)
SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS value FROM c""")
def hash_encode(spark, d):
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    rows = read(spark, d, "benchmark").select("item_id", F.posexplode(words).alias("pos", "word"))
    return V.hashed_features(rows, "item_id").withColumn("value", F.round("value", 9))


@query("emb.norm_check", "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN list_transform(embedding, lambda x: x * 2) WHEN vec_id % 11 = 3 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings) SELECT vec_id, 'norm' AS rule FROM e WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-4 UNION ALL SELECT vec_id, 'width' FROM e WHERE len(embedding) <> 64")
def norm_check(spark, d):
    """Every ninth vector is doubled, every eleventh cut in half."""
    broken = F.when(F.col("vec_id") % 9 == 4, F.transform("embedding", lambda x: x * F.lit(2).cast("float"))).when(F.col("vec_id") % 11 == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return V.norm_violations(read(spark, d, "embeddings").withColumn("embedding", broken), 64)


_CW = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


@query("emb.text", f"""WITH b AS (SELECT doc_id, 'Topic ' || source || chr(10) || 'Question ' || lang || '?' AS base, {_CW} AS c FROM documents)
SELECT doc_id, base || CASE WHEN len(c) > 0 THEN chr(10) || array_to_string(c[1:116], ' ') ELSE '' END AS embed_text, (4 + least(116, len(c)))::INTEGER AS n_tokens, len(c) > 116 AS truncated FROM b""")
def emb_text(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("Topic "), "source").alias("header"), F.concat(F.lit("Question "), "lang", F.lit("?")).alias("question"), F.col("text").alias("context"))
    return V.embedding_text(rows, 120).select("doc_id", "embed_text", "n_tokens", "truncated")


@query("emb.hash_key", """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS key FROM documents""")
def hash_key(spark, d):
    return read(spark, d, "documents").select("doc_id", V.hash_key("source", "doc_id", "lang").alias("key"))


def _index(spark, d):
    docs = read(spark, d, "documents")
    return docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 3, "old").otherwise(F.md5("text")).alias("text_hash"), F.when(F.col("doc_id") % 7 == 2, "m0").otherwise("m1").alias("model"), F.when(F.col("doc_id") % 9 == 5, "failed").otherwise("ok").alias("status"))


_INDEX = "idx AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 3 THEN 'old' ELSE md5(text) END AS text_hash, CASE WHEN doc_id % 7 = 2 THEN 'm0' ELSE 'm1' END AS model, CASE WHEN doc_id % 9 = 5 THEN 'failed' ELSE 'ok' END AS status FROM documents WHERE doc_id % 4 <> 1)"


@query("emb.incremental", f"""WITH {_INDEX}, r AS (SELECT d.doc_id AS id, list_filter([CASE WHEN i.id IS NULL THEN 'new' END, CASE WHEN i.text_hash <> md5(d.text) THEN 'text_changed' END, CASE WHEN i.model <> 'm1' THEN 'model_changed' END, CASE WHEN i.status = 'failed' THEN 'previous_failure' END], lambda x: x IS NOT NULL) AS reasons FROM documents d LEFT JOIN idx i ON i.id = d.doc_id)
SELECT id, reasons, len(reasons) > 0 AS needs_index FROM r""")
def incremental(spark, d):
    return V.index_decisions(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("text_hash")), _index(spark, d), "m1")


@query("emb.stale", f"WITH {_INDEX} SELECT id FROM idx WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def emb_stale(spark, d):
    return V.stale(_index(spark, d), read(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("id"))).select("id")


@query("emb.upsert", f"WITH {_INDEX} SELECT d.doc_id AS id, md5(d.text) AS text_hash, 'm1' AS model FROM documents d WHERE doc_id % 3 = 0 UNION ALL SELECT id, text_hash, model FROM idx WHERE id % 3 <> 0")
def emb_upsert(spark, d):
    batch = read(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.md5("text").alias("text_hash"), F.lit("m1").alias("model"))
    return upsert(_index(spark, d).drop("status"), batch, ["id"], {})


@query("emb.payload_patch", f"WITH {VECTORS} SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 100 + section ELSE section END AS section, reference, marks FROM vectors")
def payload_patch(spark, d):
    v = vectors(spark, d)
    patch = v.where("vec_id % 5 = 0").select("vec_id", (F.col("section") + 100).alias("section"))
    return V.patch_payload(v, patch, "vec_id", ["section"]).drop("embedding")


_TOP = "SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM {0}) WHERE rank <= {1}"


@query("vec.topk", f"WITH {VECTORS}, {SCORED} " + _TOP.format("scored", 8))
def topk(spark, d):
    return V.top_k(asked(spark, d), vectors(spark, d), 8)


@query("vec.filtered", f"WITH {VECTORS}, {SCORED}, f AS (SELECT * FROM scored WHERE section IN (1, 2, 3) AND marks BETWEEN 2 AND 9) " + _TOP.format("f", 5))
def filtered(spark, d):
    return V.top_k(asked(spark, d), vectors(spark, d).where("section in (1, 2, 3) and marks between 2 and 9"), 5)


@query("vec.lookup", f"WITH {VECTORS}, {SCORED} SELECT query_id, vec_id, score FROM scored WHERE vec_id // 50 * 50 = query_id")
def lookup(spark, d):
    q = asked(spark, d)
    ids = vectors(spark, d).select("vec_id", F.expr("vec_id div 50 * 50").alias("query_id")).join(q, "query_id")
    return V.lookup(ids, vectors(spark, d))


@query("vec.best_unit", f"WITH {VECTORS}, {SCORED}, u AS (SELECT vec_id // 7 AS chunk_id, query_id AS concept_id, vec_id % 7 AS unit_no, score FROM scored) SELECT chunk_id, concept_id, max(score) AS score, arg_max(unit_no, score - unit_no * 1e-9) AS unit_no FROM u GROUP BY 1, 2")
def best_unit(spark, d):
    units = vectors(spark, d).select(F.expr("vec_id div 7").alias("chunk_id"), (F.col("vec_id") % 7).alias("unit_no"), "embedding")
    return V.best_units(asked(spark, d).withColumnRenamed("query_id", "concept_id"), units)


@query("vec.ann")
def ann(spark, d):
    queries = read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.approximate_top_k(queries, vectors(spark, d), 8)


@query("vec.self_check", f"WITH {VECTORS}, q AS (SELECT * FROM vectors ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 12), s AS (SELECT q.vec_id AS query_id, v.vec_id, {DOT} AS score FROM q, vectors v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT count(*) FILTER (query_id = vec_id AND rank <= 3) / 12.0 AS rate, 12 AS n FROM r")
def self_check(spark, d):
    v = vectors(spark, d)
    sample = v.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(12).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = V.top_k(sample, v, 3)
    return found.agg((F.count_if(F.col("query_id") == F.col("vec_id")) / 12.0).alias("rate"), F.lit(12).alias("n"))


@query("vec.bundle", f"WITH {VECTORS}, ask AS (SELECT o_orderkey AS place, o_custkey AS vec_id FROM orders) SELECT a.place, v.vec_id, v.section, v.reference, v.marks, d.source FROM ask a JOIN vectors v USING (vec_id) JOIN documents d ON d.doc_id = v.vec_id")
def bundle(spark, d):
    ask = read(spark, d, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("vec_id"))
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return ask.join(vectors(spark, d), "vec_id").join(docs, "vec_id").select("place", "vec_id", "section", "reference", "marks", "source")
