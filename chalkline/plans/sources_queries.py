"""Queries over sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from chalkline.plans.bridges import LINES, lines, read
from chalkline.plans.registry import query
from chalkline.sources import pages as P
from chalkline.sources import sinks as K
from chalkline.sources import tables as T


def scratch(spark, name):
    """A new folder in the folder that driver and executors share; only a local master may do without one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src.lines", f"WITH {LINES} SELECT doc_id, line_no, line FROM lines")
def src_lines(spark, d):
    return lines(read(spark, d, "documents"))


@query("src.chunks_json", "SELECT doc_id AS chunk_id, text FROM documents")
def chunks_json(spark, d):
    path = scratch(spark, "chunks")
    docs = read(spark, d, "documents")
    K.write_json(K.nested(docs.select("source", F.col("doc_id").alias("chunk_id"), "text"), ["source"], "chunks", 200), path)
    return T.read_chunks(spark, path).select("chunk_id", "text")


@query("src.chunk_discovery", "SELECT source, count(*)::BIGINT AS n_chunks FROM documents GROUP BY 1")
def chunk_discovery(spark, d):
    path = scratch(spark, "found")
    docs = read(spark, d, "documents")
    K.write_json(K.nested(docs.select("source", F.col("doc_id").alias("chunk_id"), F.col("lang").alias("text")), ["source"], "chunks"), path + "/a", ["source"])
    K.write_json(docs.select("lang").distinct(), path + "/b")
    found = T.discover_chunk_files(spark, path)
    return found.groupBy(F.regexp_extract("file", "/source=([^/]*)/", 1).alias("source")).agg(F.sum("n_chunks").alias("n_chunks"))


@query("src.registered_pairs", """WITH p AS (SELECT source || '/' || lang || '/' || (doc_id % 50) AS pair_key, CASE WHEN doc_id % 2 = 0 THEN 'question_paper' ELSE 'mark_scheme' END AS kind, doc_id FROM documents),
f AS (SELECT pair_key, min(doc_id) FILTER (kind = 'question_paper') AS question_paper, min(doc_id) FILTER (kind = 'mark_scheme') AS mark_scheme, count(*) FILTER (kind = 'question_paper') AS nq, count(*) FILTER (kind = 'mark_scheme') AS nm FROM p GROUP BY 1)
SELECT pair_key, question_paper, mark_scheme, CASE WHEN nq > 1 OR nm > 1 THEN 'duplicate' WHEN nq = 0 OR nm = 0 THEN 'incomplete' ELSE 'complete' END AS status FROM f""")
def registered_pairs(spark, d):
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string")).alias("pair_key"), F.when(F.col("doc_id") % 2 == 0, "question_paper").otherwise("mark_scheme").alias("document_type"), "doc_id")
    return T.registered_pairs(docs)


@query("src.eligible", """SELECT d.doc_id, d.source, l.quality, c.turns FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id
WHERE d.text IS NOT NULL AND trim(d.text) <> '' AND d.lang IN ('en', 'fr', 'de') AND l.quality = 1 AND l.toxic = 0 AND d.n_chars >= 200 AND c.turns >= 2""")
def eligible(spark, d):
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    return T.eligible(read(spark, d, "documents"), read(spark, d, "labels"), turns).select("doc_id", "source", "quality", "turns")


_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages)"""


@query("src.link_filter", f"WITH {_LINKS} SELECT page_id, href, title FROM links WHERE regexp_matches(lower(title || ' ' || href), 'the|and|sch')")
def link_filter(spark, d):
    return P.with_hint(P.links(read(spark, d, "pages")), ("the", "and", "sch"))


@query("src.url_features", """WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, nullif(regexp_extract(path, '^/(en|fr|de|es)(?:/|$)', 1), '') AS language, regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) AS slug, trim(regexp_replace(regexp_extract(rtrim(path, '/'), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS file_name FROM u""")
def url_features(spark, d):
    return P.url_features(read(spark, d, "pages")).select("page_id", "host", "language", "slug", "file_name")


@query("src.page_extract", f"WITH {_LINKS} SELECT href, min(page_id) AS page_id, count(*) AS n FROM links WHERE href <> '' GROUP BY 1")
def page_extract(spark, d):
    return P.unique_links(read(spark, d, "pages"))


@query("src.header_fields", """WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, url FROM pages)
SELECT page_id, coalesce(nullif(trim(h1), ''), nullif(trim(title), ''), 'untitled') AS topic, nullif(regexp_extract(url, '/([0-9]+)(?:[/?#]|$)', 1), '') AS number, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), '1') AS page FROM t""")
def header_fields(spark, d):
    return P.header_fields(read(spark, d, "pages"))


@query("sink.json", "SELECT source, doc_id, lang, n_chars FROM documents")
def sink_json(spark, d):
    path = scratch(spark, "json")
    docs = read(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    K.write_json(K.nested(docs, ["source"], "documents"), path)
    stored = spark.read.schema("source string, part int, documents array<struct<doc_id:bigint,lang:string,n_chars:bigint>>").json(path)
    return stored.select("source", F.explode("documents").alias("x")).select("source", "x.*")


@query("sink.csv", "SELECT source, lang, count(*) AS n, '[' || array_to_string(list_sort(list(DISTINCT doc_id % 3)), ',') || ']' AS rest FROM documents GROUP BY 1, 2")
def sink_csv(spark, d):
    path = scratch(spark, "csv")
    K.write_csv(read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col("doc_id") % 3)).alias("rest")), path)
    return spark.read.schema("source string, lang string, n bigint, rest string").option("header", True).csv(path)


@query("sink.audit", "SELECT o_orderstatus, count(*) AS n, year(o_orderdate) || '-01-01' AS run_date FROM orders GROUP BY 1, 3")
def sink_audit(spark, d):
    path = scratch(spark, "audit")
    runs = read(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "year").alias("day")).agg(F.count("*").alias("n"))
    K.append_audit(runs, path, F.col("day"))
    return spark.read.schema("o_orderstatus string, n bigint, run_date date").parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query("sink.run_manifest", "SELECT 'documents' AS stage, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status, count(*) AS n_rows FROM documents UNION ALL SELECT 'labels', CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END, count(*) FROM labels")
def run_manifest(spark, d):
    return K.run_manifest({"documents": read(spark, d, "documents"), "labels": read(spark, d, "labels")})
