"""Queries over the question bank: line items play words on pages, document lines play paper and scheme lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chalkline.operators import bank as B
from chalkline.operators import checks as K
from chalkline.operators import snapshots as S
from chalkline.plans.bridges import LINES, lines, read
from chalkline.plans.registry import query

_W = "wd AS (SELECT (l_orderkey % 50)::VARCHAR AS pair_key, l_suppkey % 9 AS page, (l_partkey % 400)::DOUBLE AS x0, ((l_orderkey * 13) % 800)::DOUBLE AS y0, (l_partkey % 400 + l_quantity)::DOUBLE AS x1, ((l_orderkey * 13) % 800 + 4)::DOUBLE AS y1, l_returnflag || l_linenumber || '-' || l_orderkey || '-' || l_partkey AS text FROM lineitem)"
_R = f"{_W}, jm AS (SELECT *, coalesce((y0 - lag(y0) OVER (PARTITION BY pair_key, page ORDER BY y0, x0) > 2.5)::INTEGER, 0) AS j FROM wd), nb AS (SELECT *, sum(j) OVER (PARTITION BY pair_key, page ORDER BY y0, x0)::BIGINT AS row_no FROM jm), rw AS (SELECT pair_key, page, row_no, string_agg(text, ' ' ORDER BY x0, text) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM nb GROUP BY 1, 2, 3)"


def words(spark, d):
    k = F.col("l_orderkey")
    return read(spark, d, "lineitem").select((k % 50).cast("string").alias("pair_key"), (F.col("l_suppkey") % 9).alias("page"), (F.col("l_partkey") % 400).cast("double").alias("x0"), ((k * 13) % 800).cast("double").alias("y0"), (F.col("l_partkey") % 400 + F.col("l_quantity")).alias("x1"), ((k * 13) % 800 + 4).cast("double").alias("y1"), F.concat("l_returnflag", "l_linenumber", F.lit("-"), "l_orderkey", F.lit("-"), "l_partkey").alias("text"))


@query("bank.rows", f"WITH {_R} SELECT * FROM rw")
def bank_rows(spark, d):
    return B.rows(words(spark, d))


@query("bank.noise", f"WITH {_R} SELECT * FROM rw WHERE NOT (y0 < 30 OR y0 > 770 OR x1 < 20 OR regexp_matches(text, '(?i)^(?:page \\d+|turn over|\\d+|end of questions)$'))")
def noise(spark, d):
    return B.without_noise(B.rows(words(spark, d)))


@query("bank.normalise", "SELECT event_id, 'user' || user_id || '-' || event_type || '-''x' || chr(34) || ' ' || value AS text, CASE WHEN user_id = 0 THEN '0' ELSE user_id::VARCHAR END || '.' || event_id % 9 AS number FROM events")
def normalise(spark, d):
    e = read(spark, d, "events")
    raw = F.concat(F.lit("user"), "user_id", F.lit("–"), "event_type", F.lit("—’×”\t "), F.col("value"))
    number = F.concat(F.lit("0 "), "user_id", F.lit(" . "), F.col("event_id") % 9)
    return e.select("event_id", B.normal_text(raw).alias("text"), B.question_number(number).alias("number"))


def paper(spark, d):
    """Numbered paper lines out of documents: a marker on every third line, marks on every second."""
    of = lines(read(spark, d, "documents"))
    n = F.col("line_no")
    mark = F.when(n % 3 == 0, F.concat((F.expr("line_no div 6") + 1).cast("string"), F.when(n % 6 == 3, F.concat(F.lit(" . "), F.lit("1"))).otherwise(""), F.lit(" "))).otherwise("")
    label = F.when(n % 3 == 2, F.concat(F.lit(" ["), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(" marks]"))).otherwise("")
    return of.select(F.col("doc_id").cast("string").alias("pair_key"), "line_no", F.concat(mark, "line", label).alias("text"))


_PAPER = f"""{LINES}, pp AS (SELECT doc_id::VARCHAR AS pair_key, line_no, CASE WHEN line_no % 3 = 0 THEN (line_no // 6 + 1) || CASE WHEN line_no % 6 = 3 THEN ' . 1' ELSE '' END || ' ' ELSE '' END || line || CASE WHEN line_no % 3 = 2 THEN ' [' || (doc_id % 7 + 1) || ' marks]' ELSE '' END AS text FROM lines),
mx AS (SELECT *, regexp_matches(text, '^\\s*(\\d{{1,2}}(?:\\s*\\.\\s*\\d{{1,2}})?)[.)]?\\s+(.*)$') AS m, regexp_replace(regexp_extract(text, '^\\s*(\\d{{1,2}}(?:\\s*\\.\\s*\\d{{1,2}})?)[.)]?\\s+(.*)$', 1), '\\s+', '', 'g') AS raw FROM pp),
mk AS (SELECT pair_key, line_no, text, CASE WHEN m AND TRY_CAST(split_part(raw, '.', 1) AS INTEGER) BETWEEN 1 AND 30 THEN array_to_string(list_transform(string_split(raw, '.'), lambda p: (p::INTEGER)::VARCHAR), '.') END AS marker, CASE WHEN m AND TRY_CAST(split_part(raw, '.', 1) AS INTEGER) BETWEEN 1 AND 30 THEN regexp_extract(text, '^\\s*(\\d{{1,2}}(?:\\s*\\.\\s*\\d{{1,2}})?)[.)]?\\s+(.*)$', 2) ELSE text END AS rest FROM mx),
sq AS (SELECT *, sum(CASE WHEN marker IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY pair_key ORDER BY line_no)::BIGINT AS seq FROM mk),
s0 AS (SELECT pair_key, seq, max(marker) AS number, string_agg(rest, chr(10) ORDER BY line_no) AS text, min(line_no) AS first_line, max(line_no) AS last_line FROM sq WHERE seq > 0 GROUP BY 1, 2),
qs AS (SELECT *, list_last(regexp_extract_all(text, '[\\[(](\\d+)\\s*marks?[\\])]', 1))::INTEGER AS marks FROM s0)"""


def questions(spark, d):
    return B.segment(B.markers(paper(spark, d)))


@query("bank.marker", f"WITH {_PAPER} SELECT pair_key, line_no, marker, rest FROM mk")
def marker(spark, d):
    return B.markers(paper(spark, d)).select("pair_key", "line_no", "marker", "rest")


@query("bank.segment", f"WITH {_PAPER} SELECT * FROM qs")
def segment(spark, d):
    return questions(spark, d)


def split_questions(spark, d):
    return questions(spark, d).withColumn("number", F.split_part("number", F.lit("."), F.lit(1))).withColumn("marks", F.when(F.col("seq") % 2 == 0, F.coalesce("marks", F.lit(2))))


@query("bank.continuation", f"WITH {_PAPER}, sp AS (SELECT pair_key, seq, split_part(number, '.', 1) AS number, text, first_line, last_line, CASE WHEN seq % 2 = 0 THEN coalesce(marks, 2) END AS marks FROM qs), g AS (SELECT *, coalesce(lag(number) OVER w = number AND lag(marks) OVER w IS NULL AND marks IS NOT NULL AND first_line = lag(last_line) OVER w + 1, false) AS g FROM sp WINDOW w AS (PARTITION BY pair_key ORDER BY seq)), k AS (SELECT *, sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY pair_key ORDER BY seq)::BIGINT AS k FROM g) SELECT pair_key, k AS seq, max(number) AS number, string_agg(text, chr(10) ORDER BY seq) AS text, max(marks) AS marks, min(first_line) AS first_line, max(last_line) AS last_line, count(*) AS n_parts FROM k GROUP BY 1, 2")
def continuation(spark, d):
    return B.merge_continued(split_questions(spark, d))


@query("bank.data_rows", "WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN user_id || ' ' || value WHEN 'view' THEN '12/03/2024 ' || user_id WHEN 'error' THEN '1 ' || event_type ELSE event_type END AS text FROM events) SELECT * FROM e WHERE NOT regexp_matches(text, '^[\\s\\d.,:/|-]+$') AND NOT regexp_matches(text, '^\\d{1,2}[ /.-]\\d{1,2}[ /.-]\\d{2,4}')")
def data_rows(spark, d):
    kind = F.col("event_type")
    e = read(spark, d, "events").select("event_id", F.when(kind == "click", F.concat_ws(" ", "user_id", "value")).when(kind == "view", F.concat(F.lit("12/03/2024 "), "user_id")).when(kind == "error", F.concat(F.lit("1 "), kind)).otherwise(kind).alias("text"))
    return B.without_data_rows(e)


_ROLES = f"""{_PAPER}, q0 AS (SELECT pair_key, seq, number, text, CASE WHEN contains(number, '.') OR seq % 5 = 0 THEN marks END AS marks, split_part(number, '.', 1) AS main, contains(number, '.') AS is_child FROM qs),
r1 AS (SELECT *, CASE WHEN NOT is_child AND marks IS NULL AND coalesce(max(is_child::INTEGER) OVER (PARTITION BY pair_key, main ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 THEN 'context' ELSE 'scored' END AS role FROM q0),
rr AS (SELECT pair_key, seq, number, role, CASE WHEN is_child THEN main END AS parent, row_number() OVER (PARTITION BY pair_key, number ORDER BY seq)::INTEGER AS occurrence, last_value(CASE WHEN role = 'context' THEN text END IGNORE NULLS) OVER (PARTITION BY pair_key, main ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context, CASE WHEN role = 'context' THEN 'context' WHEN marks IS NULL THEN 'needs_review' ELSE 'auto_approved' END AS review_status FROM r1)"""


@query("bank.roles", f"WITH {_ROLES} SELECT * FROM rr")
def roles(spark, d):
    q = questions(spark, d).withColumn("marks", F.when(F.col("number").contains(".") | (F.col("seq") % 5 == 0), F.col("marks")))
    return B.roles(q).select("pair_key", "seq", "number", "role", "parent", "occurrence", "context", "review_status")


@query("bank.scope", "SELECT o_custkey AS question_id, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderpriority = '2-HIGH') THEN 'both' WHEN bool_or(o_orderstatus = 'F') THEN 'old' WHEN bool_or(o_orderpriority = '2-HIGH') THEN 'new' ELSE 'none' END AS scope FROM orders GROUP BY 1")
def scope(spark, d):
    return B.scope(read(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), (F.col("o_orderstatus") == "F").alias("says_old"), (F.col("o_orderpriority") == "2-HIGH").alias("says_new")))


@query("bank.ms_starts", "WITH r AS (SELECT p_partkey AS row_id, (p_size * 4)::DOUBLE AS x0, '0' || p_size % 9 || ' (' || chr((97 + p_partkey % 3)::INTEGER) || ') ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' 3 marks' ELSE '' END AS text FROM part) SELECT row_id, (p.n::INTEGER)::VARCHAR AS number, regexp_extract(text, '^\\d{1,2}\\s+\\(?([a-z])\\)?\\s', 1) AS part FROM (SELECT *, regexp_extract(text, '^(\\d{1,2})(?:\\s|$)', 1) AS n FROM r) p WHERE x0 < 80 AND n <> '' AND regexp_matches(text, '(?i)\\bmarks?\\b')")
def ms_starts(spark, d):
    text = F.concat(F.lit("0"), F.col("p_size") % 9, F.lit(" ("), F.char((F.col("p_partkey") % 3 + 97).cast("int")), F.lit(") "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " 3 marks").otherwise(""))
    return B.scheme_starts(read(spark, d, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") * 4).cast("double").alias("x0"), text.alias("text"))).select("row_id", "number", "part")


@query("bank.match_score", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_partkey % 3 = l_suppkey % 3 AND l_linenumber % 2 = l_suppkey % 2 THEN 12 WHEN l_partkey % 3 = l_suppkey % 3 THEN 6 ELSE 1 END + CASE WHEN l_quantity = 1 OR l_tax = 0 THEN 0 WHEN l_quantity % 4 = l_partkey % 4 THEN 5 ELSE -3 END)::INTEGER AS score, CASE WHEN l_partkey % 3 = l_suppkey % 3 AND l_linenumber % 2 = l_suppkey % 2 THEN 'exact' WHEN l_partkey % 3 = l_suppkey % 3 THEN 'main' ELSE 'sequence' END AS method FROM lineitem")
def match_score(spark, d):
    num = lambda a, b: F.concat((F.col(a) % 3).cast("int"), F.lit("."), (F.col(b) % 2).cast("int"))
    p = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", num("l_partkey", "l_linenumber").alias("q_number"), num("l_suppkey", "l_suppkey").alias("e_number"), F.when(F.col("l_quantity") != 1, F.col("l_quantity") % 4).alias("q_marks"), F.when(F.col("l_tax") != 0, F.col("l_partkey") % 4).alias("e_marks"))
    return B.match_scores(p).select("l_orderkey", "l_linenumber", "score", "method")


def scheme(spark, d):
    return questions(spark, d).where("seq % 7 <> 3").withColumn("marks", F.when(F.col("seq") % 4 == 1, F.lit(9)).otherwise(F.col("marks")))


@query("bank.align")
def align(spark, d):
    return B.align(questions(spark, d), scheme(spark, d))


@query("bank.marks", "WITH e AS (SELECT p_partkey AS entry_id, CASE WHEN p_partkey % 5 = 0 THEN p_size END AS total, CASE WHEN p_partkey % 3 = 0 THEN 'AO1 = ' || p_size % 4 || ' AO2=' || p_size % 3 WHEN p_partkey % 3 = 1 THEN 'give ' || p_size || ' marks' ELSE 'none' END AS text, CASE WHEN p_partkey % 2 = 0 THEN 4 END AS qm, p_size FROM part) SELECT entry_id, coalesce(total, CASE WHEN entry_id % 3 = 0 THEN p_size % 4 + p_size % 3 WHEN entry_id % 3 = 1 THEN p_size END, qm)::INTEGER AS marks, CASE WHEN total IS NOT NULL THEN 'total' WHEN entry_id % 3 = 0 THEN 'objectives' WHEN entry_id % 3 = 1 THEN 'phrase' WHEN qm IS NOT NULL THEN 'question' END AS marks_source FROM e")
def marks(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 3 == 0, F.concat(F.lit("AO1 = "), s % 4, F.lit(" AO2="), s % 3)).when(k % 3 == 1, F.concat(F.lit("give "), s, F.lit(" marks"))).otherwise("none")
    e = read(spark, d, "part").select(k.alias("entry_id"), F.when(k % 5 == 0, s).alias("total"), text.alias("text"), F.when(k % 2 == 0, F.lit(4)).alias("question_marks"))
    return B.entry_marks(e).select("entry_id", "marks", "marks_source")


@query("bank.guidance", "SELECT p_partkey AS entry_id, [p_name, 'last'] AS points, CASE WHEN p_partkey % 2 = 0 THEN ['A. ' || p_type] ELSE [] END AS accepted, CASE WHEN p_partkey % 2 = 1 THEN ['R. ' || p_type] ELSE [] END AS rejected, ['NE. none'] AS extra FROM part")
def bank_guidance(spark, d):
    text = F.concat("p_name", F.lit("\n"), F.when(F.col("p_partkey") % 2 == 0, "A. ").otherwise("R. "), "p_type", F.lit("\nAO1 = 2\n\nNE. none\n last "))
    return read(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), B.guidance(text).alias("g")).select("entry_id", "g.*")


@query("bank.entries", f"WITH {_PAPER} SELECT pair_key, seq, number, marks, sha256(text) AS text_hash, len(text)::INTEGER AS n_chars, list_filter([CASE WHEN marks IS NULL THEN 'no_marks' END, CASE WHEN len(text) < 10 THEN 'short' END], lambda x: x IS NOT NULL) AS warnings FROM qs")
def bank_entries(spark, d):
    return B.entries(paper(spark, d))


_LINK = f"""{_PAPER}, q1 AS (SELECT pair_key, number, min(marks) AS qm, min(seq) AS q_seq FROM qs GROUP BY 1, 2 HAVING count(*) = 1), e1 AS (SELECT pair_key, number, min(CASE WHEN seq % 4 = 1 THEN 9 ELSE marks END) AS em, min(seq) AS e_seq FROM qs WHERE seq % 7 <> 3 GROUP BY 1, 2 HAVING count(*) = 1),
bo AS (SELECT pair_key, number, q_seq, e_seq, qm, em, CASE WHEN qm = em THEN 1.0 WHEN qm IS NULL OR em IS NULL THEN 0.85 ELSE 0.60 END::DOUBLE AS confidence FROM q1 JOIN e1 USING (pair_key, number)), li AS (SELECT pair_key, number, q_seq, e_seq, confidence, CASE WHEN confidence >= 0.85 THEN 'auto' ELSE 'needs_review' END AS status FROM bo),
iss AS (SELECT pair_key, number, 'question_without_entry' AS issue FROM q1 ANTI JOIN e1 USING (pair_key, number) UNION ALL SELECT pair_key, number, 'entry_without_question' FROM e1 ANTI JOIN q1 USING (pair_key, number) UNION ALL SELECT pair_key, number, 'marks_differ' FROM bo WHERE qm <> em)"""


def _once(df):
    n = df.groupBy("pair_key", "number").count().where("count = 1").select("pair_key", "number")
    return df.join(n, ["pair_key", "number"], "left_semi")


def _links(spark, d):
    return B.links(_once(questions(spark, d)), _once(scheme(spark, d)))


@query("bank.link", f"WITH {_LINK} SELECT * FROM li")
def link(spark, d):
    return _links(spark, d)[0]


@query("bank.link_issues", f"WITH {_LINK} SELECT * FROM iss")
def link_issues(spark, d):
    return _links(spark, d)[1]


_SUM = f"{_LINK}, sm AS (SELECT q.*, coalesce(n_links, 0) AS n_links, coalesce(n_auto, 0) AS n_auto, coalesce(n_issues, 0) AS n_issues FROM (SELECT pair_key, count(*) AS n_questions, count(*) FILTER (marks IS NULL) AS n_unmarked FROM qs GROUP BY 1) q LEFT JOIN (SELECT pair_key, count(*) AS n_links, count(*) FILTER (status = 'auto') AS n_auto FROM li GROUP BY 1) k USING (pair_key) LEFT JOIN (SELECT pair_key, count(*) AS n_issues FROM iss GROUP BY 1) i USING (pair_key))"


def summary(spark, d):
    linked, issues = _links(spark, d)
    return B.pair_summary(questions(spark, d), linked, issues)


@query("bank.pair_summary", f"WITH {_SUM} SELECT *, n_issues = 0 AND n_links = n_auto AS strict_passed, n_issues > 0 AS needs_review FROM sm")
def pair_summary(spark, d):
    return summary(spark, d)


@query("bank.acceptance", f"WITH {_SUM}, a AS (SELECT count(*) > 0 AS a, bool_and(n_questions > 0) AS b, sum(n_issues) * 2 <= sum(n_questions) AS c FROM sm) SELECT unnest(['has_pairs', 'all_have_questions', 'few_issues']) AS check_name, unnest([a, b, c]) AS passed FROM a")
def acceptance(spark, d):
    return K.manifest(summary(spark, d), {"has_pairs": F.count("*") > 0, "all_have_questions": F.bool_and(F.col("n_questions") > 0), "few_issues": F.sum("n_issues") * 2 <= F.sum("n_questions")})


@query("bank.replace", "WITH o AS (SELECT o_custkey::VARCHAR AS pair_key, o_orderkey AS id, 'old' AS v FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_custkey::VARCHAR AS pair_key, o_orderkey AS id, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 5 <> 0) SELECT * FROM o WHERE pair_key NOT IN (SELECT pair_key FROM n) UNION ALL SELECT * FROM n")
def replace(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("pair_key"), F.col("o_orderkey").alias("id"))
    return B.replace_pairs(o.where("id % 2 = 0").withColumn("v", F.lit("old")), o.where("id % 3 = 0").withColumn("v", F.lit("new")), o.where("pair_key % 5 = 0"))


@query("bank.snapshot", "SELECT d.doc_id, d.source, l.quality, c.n FROM documents d JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'en') t USING (source) LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id")
def snapshot(spark, d):
    docs = read(spark, d, "documents")
    turns = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return docs.join(docs.where("lang = 'en'").select("source").distinct(), "source").join(read(spark, d, "labels"), "doc_id", "left").join(turns, "doc_id", "left").select("doc_id", "source", "quality", "n")


_QC = """qn AS (SELECT doc_id AS question_id, text, CASE WHEN doc_id % 6 = 1 THEN 'x' ELSE (doc_id % 30)::VARCHAR END AS number, (doc_id % 28)::INTEGER AS marks, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'main' ELSE 'exact' END AS link, (doc_id % 7)::INTEGER AS e_marks, CASE WHEN doc_id % 11 = 0 THEN 'old' ELSE 'new' END AS scope, (doc_id % 4)::INTEGER AS n_points, count(*) OVER (PARTITION BY lower(trim(text))) AS same FROM documents),
cx AS (SELECT question_id, unnest([CASE WHEN NOT regexp_matches(number, '^\\d+(?:\\.\\d+)?$') THEN 'number' END, CASE WHEN NOT marks BETWEEN 1 AND 25 THEN 'marks' END, CASE WHEN NOT regexp_matches(text, '[.?!)\\]]\\s*$') THEN 'complete' END, CASE WHEN regexp_matches(text, '[#%$&*]{3,}') THEN 'noise' END, CASE WHEN link IS NULL THEN 'link' END, CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN len(string_split_regex(trim(text), '\\s+')) < 8 THEN 'short' END, CASE WHEN contains(text, '```') THEN 'code' END, CASE WHEN regexp_matches(text, '(?i)\\bfigure\\b') THEN 'visual' END, CASE WHEN marks <> e_marks THEN 'marks_equal' END, CASE WHEN link <> 'exact' THEN 'exact_link' END, CASE WHEN scope = 'old' THEN 'scope' END, CASE WHEN n_points = 0 THEN 'guidance' END]) AS check_name FROM qn),
ck AS (SELECT question_id, check_name, CASE WHEN check_name IN ('number', 'marks', 'complete', 'link') THEN 'critical' ELSE 'warning' END AS severity FROM cx WHERE check_name IS NOT NULL)"""


def checks(spark, d):
    k = F.col("doc_id")
    q = read(spark, d, "documents").select(k.alias("question_id"), "text", F.when(k % 6 == 1, "x").otherwise((k % 30).cast("string")).alias("number"), (k % 28).cast("int").alias("marks"), F.when(k % 5 == 0, None).when(k % 5 == 1, "main").otherwise("exact").alias("link"), (k % 7).cast("int").alias("e_marks"), F.when(k % 11 == 0, "old").otherwise("new").alias("scope"), (k % 4).cast("int").alias("n_points"))
    return B.quality_checks(q)


query("bank.quality", f"WITH {_QC} SELECT * FROM ck")(checks)

_QU = f"{_QC}, qe AS (SELECT 'q' || question_id AS uid, (100 * count(*) FILTER (severity = 'critical') + 10 * count(*) FILTER (severity = 'warning') + CASE WHEN question_id % 13 = 0 THEN 25 ELSE 0 END)::BIGINT AS priority, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'blocked' ELSE 'open' END AS status FROM ck GROUP BY question_id UNION ALL SELECT 'i' || o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 150 WHEN '2-HIGH' THEN 60 ELSE 10 END, 'open' FROM orders WHERE o_orderstatus = 'P')"


def the_queue(spark, d):
    legacy = read(spark, d, "documents").select(F.col("doc_id").alias("question_id"), (F.col("doc_id") % 13 == 0).alias("legacy"))
    p = F.col("o_orderpriority")
    issues = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("issue_id"), F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "warning").otherwise("info").alias("severity"))
    return B.queue(checks(spark, d), legacy, issues)


query("bank.queue", f"WITH {_QU} SELECT * FROM qe")(the_queue)


@query("bank.queue_view", f"WITH {_QU} SELECT * FROM qe WHERE status IN ('blocked', 'open') ORDER BY priority DESC, uid LIMIT 40")
def queue_view(spark, d):
    return S.page(the_queue(spark, d), F.col("status").isin("blocked", "open"), [F.desc("priority"), F.col("uid")], 40)


@query("bank.queue_upsert", f"WITH {_QU}, o AS (SELECT 'q' || doc_id AS uid, doc_id % 50 AS priority, CASE WHEN doc_id % 3 = 0 THEN 'approved' WHEN doc_id % 3 = 1 THEN 'rejected' ELSE 'open' END AS status FROM documents) SELECT coalesce(o.uid, n.uid) AS uid, coalesce(n.priority, o.priority) AS priority, CASE WHEN o.status IN ('approved', 'rejected') THEN o.status ELSE coalesce(n.status, o.status) END AS status FROM o FULL JOIN qe n ON o.uid = n.uid")
def queue_upsert(spark, d):
    k = F.col("doc_id")
    old = read(spark, d, "documents").select(F.concat(F.lit("q"), k).alias("uid"), (k % 50).alias("priority"), F.when(k % 3 == 0, "approved").when(k % 3 == 1, "rejected").otherwise("open").alias("status"))
    return S.upsert(old, the_queue(spark, d), ["uid"], {"status": S.protected(["approved", "rejected"])})


_RV = "en AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'auto_approved' ELSE 'needs_review' END AS status, c_mktsegment AS value FROM customer), de AS (SELECT user_id AS id, arg_max(CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'error' THEN 'disable' ELSE 'correct' END, event_id) AS action, arg_max(event_type, event_id) AS new_value FROM events GROUP BY 1), af AS (SELECT e.id, action, e.status AS s0, value AS v0, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'disable' THEN 'disabled' WHEN 'correct' THEN 'approved' ELSE e.status END AS status, CASE WHEN action = 'correct' THEN coalesce(new_value, value) ELSE value END AS value FROM en e LEFT JOIN de USING (id))"


def _reviewed(spark, d):
    kind = F.col("event_type")
    entities = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, "auto_approved").otherwise("needs_review").alias("status"), F.col("c_mktsegment").alias("value"))
    decisions = read(spark, d, "events").select(F.col("user_id").alias("id"), F.when(kind == "click", "approve").when(kind == "view", "reject").when(kind == "error", "disable").otherwise("correct").alias("action"), kind.alias("new_value"), F.col("event_id").alias("ts"))
    return S.review(entities, decisions)


@query("bank.review_apply", f"WITH {_RV} SELECT id, status, value FROM af")
def review_apply(spark, d):
    return _reviewed(spark, d)[0]


@query("bank.review_audit", f"""WITH {_RV} SELECT id, action, '{{"status":"' || s0 || '","value":"' || v0 || '"}}' AS old, '{{"status":"' || status || '","value":"' || value || '"}}' AS new FROM af WHERE action IS NOT NULL""")
def review_audit(spark, d):
    return _reviewed(spark, d)[1]


@query("bank.bulk_promote", "SELECT count(*) FILTER (c_nationkey % 3 = 0 AND c_custkey % 13 <> 0) AS n_promoted, count(*) FILTER (c_nationkey % 3 = 0 AND c_custkey % 13 = 0) AS n_legacy, count(*) AS n FROM customer")
def bulk_promote(spark, d):
    auto, legacy = F.col("c_nationkey") % 3 == 0, F.col("c_custkey") % 13 == 0
    return read(spark, d, "customer").agg(F.count_if(auto & ~legacy).alias("n_promoted"), F.count_if(auto & legacy).alias("n_legacy"), F.count("*").alias("n"))


@query("bank.memory", "WITH o AS (SELECT sha256(p_name) AS key, count(*) AS confirmations FROM part GROUP BY 1), n AS (SELECT sha256(p_name) AS key, 1 AS confirmations FROM part WHERE p_partkey % 10 = 0 GROUP BY 1) SELECT coalesce(o.key, n.key) AS key, (coalesce(o.confirmations, 0) + coalesce(n.confirmations, 0))::BIGINT AS confirmations FROM o FULL JOIN n USING (key)")
def memory(spark, d):
    p = read(spark, d, "part").withColumn("key", F.sha2("p_name", 256))
    return S.upsert(p.groupBy("key").agg(F.count("*").alias("confirmations")), p.where("p_partkey % 10 = 0").select("key").distinct().withColumn("confirmations", F.lit(1).cast("long")), ["key"], {"confirmations": S.add})


@query("bank.report", "SELECT o_orderpriority, o_orderstatus, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS grouping, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority))")
def report(spark, d):
    return B.report(read(spark, d, "orders"), [["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"]])


@query("bank.doc_classify", "SELECT doc_id, CASE WHEN regexp_matches(lower(concat_ws(' ', source, text)), 'licen[cs]e') THEN 'licence' WHEN regexp_matches(lower(concat_ws(' ', source, text)), 'token|akia') THEN 'secret' WHEN regexp_matches(lower(concat_ws(' ', source, text)), 'src1') THEN 'first' END AS kind, nullif(regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1), '') AS year, nullif(regexp_extract(text, '([A-Z]{4}\\d{4})', 1), '') AS code FROM documents")
def doc_classify(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return B.classify_documents(docs, [("licence", "licen[cs]e"), ("secret", "token|akia"), ("first", "src1")])


@query("bank.doc_upsert", "WITH st AS (SELECT page_id AS stored_id, url, CASE WHEN page_id % 4 = 1 THEN 'x' ELSE md5(html) END AS hash FROM pages WHERE page_id % 3 <> 0), b AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 2 THEN 'other' || page_id ELSE url END AS url, md5(html) AS hash FROM pages), m AS (SELECT b.id, s.stored_id AS a, s.hash = b.hash AS same, 1 AS p FROM b JOIN st s ON s.url = b.url UNION ALL SELECT b.id, s.stored_id, true, 2 FROM b JOIN st s ON s.hash = b.hash), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, a) AS r FROM m) SELECT b.id, a AS stored_id, CASE WHEN a IS NULL THEN 'inserted' WHEN same THEN 'skipped_unchanged' ELSE 'updated' END AS action FROM b LEFT JOIN k ON k.id = b.id AND r = 1")
def doc_upsert(spark, d):
    p = read(spark, d, "pages")
    stored = p.where("page_id % 3 <> 0").select(F.col("page_id").alias("stored_id"), "url", F.when(F.col("page_id") % 4 == 1, "x").otherwise(F.md5("html")).alias("hash"))
    batch = p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 5 == 2, F.concat(F.lit("other"), "page_id")).otherwise(F.col("url")).alias("url"), F.md5("html").alias("hash"))
    return B.match_documents(batch, stored)


@query("bank.doc_keys", "SELECT doc_id, upper(concat_ws('-', source, CASE WHEN doc_id % 4 = 0 THEN 'THEORY' ELSE lang END, doc_id % 30)) AS key FROM documents")
def doc_keys(spark, d):
    docs = read(spark, d, "documents").withColumn("language", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))).withColumn("n", F.col("doc_id") % 30)
    return docs.select("doc_id", B.document_key("source", "language", "n").alias("key"))


@query("bank.pair_coverage", "WITH p AS (SELECT source || (doc_id % 9) AS topic, CASE WHEN doc_id % 4 <> 0 THEN lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'qp' ELSE 'ms' END AS kind, doc_id FROM documents) SELECT topic, language, min(doc_id) AS first_id, count(*) FILTER (kind = 'qp') AS n_qp, count(*) FILTER (kind = 'ms') AS n_ms, count(*) FILTER (kind = 'qp') = 1 AND count(*) FILTER (kind = 'ms') = 1 AS complete FROM p GROUP BY 1, 2")
def pair_coverage(spark, d):
    k = F.col("doc_id")
    return B.pair_coverage(read(spark, d, "documents").select(F.concat("source", k % 9).alias("topic"), F.when(k % 4 != 0, F.col("lang")).alias("language"), F.when(k % 2 == 0, "qp").otherwise("ms").alias("kind"), "doc_id"))


@query("bank.coverage_matrix", "WITH h AS (SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT r_regionkey AS region, unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'SPACECRAFT']) AS segment FROM region) SELECT r.region, r.segment, coalesce(n, 0) AS n, n IS NULL AS missing FROM r LEFT JOIN h ON h.region = r.region AND h.segment = r.segment")
def coverage_matrix(spark, d):
    c = read(spark, d, "customer")
    present = c.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment"))
    segments = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SPACECRAFT")))  # what every region must have
    required = read(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.explode(segments).alias("segment"))
    return B.coverage(required, present, ["region", "segment"])


@query("bank.repair", "WITH v AS (SELECT doc_id, lang, CASE WHEN source = 'src1' THEN 'one' WHEN n_chars < 300 THEN 'tiny' ELSE lang END AS v FROM documents) SELECT doc_id, v AS lang, v <> lang AS repaired FROM v")
def repair(spark, d):
    return B.repair(read(spark, d, "documents"), {"one": F.col("source") == "src1", "tiny": F.col("n_chars") < 300}, "lang").select("doc_id", "lang", "repaired")


_AL = "s AS (SELECT lower(p_name) AS key, min(p_partkey) AS source_id, count(*) AS s FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1), c AS (SELECT lower(p_name) AS key, min(p_partkey)::VARCHAR AS code, count(*) AS c FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1), al AS (SELECT coalesce(s.key, c.key) AS key, source_id, code, CASE WHEN s IS NULL THEN 'canonical_only' WHEN c IS NULL THEN 'source_only' WHEN s > 1 OR c > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM s FULL JOIN c ON s.key = c.key)"


def aligned(spark, d):
    p = read(spark, d, "part")
    code = p.where("p_partkey % 3 <> 2").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k")).withColumn("key", F.lower("name"))
    canonical = code.select("name", F.min("k").over(Window.partitionBy("key")).cast("string").alias("code"))
    return B.align_topics(p.where("p_partkey % 3 <> 1").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("source_id")), canonical)


query("bank.topic_align", f"WITH {_AL} SELECT * FROM al")(aligned)


@query("bank.topic_backfill", f"WITH {_AL} SELECT p_partkey AS question_id, p_name, code FROM part LEFT JOIN al ON al.key = lower(p_name) AND code IS NOT NULL")
def topic_backfill(spark, d):
    codes = aligned(spark, d).where("code is not null").select("key", "code")
    return read(spark, d, "part").withColumn("key", F.lower("p_name")).join(codes, "key", "left").select(F.col("p_partkey").alias("question_id"), "p_name", "code")


@query("bank.verify", "WITH v AS (SELECT (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM documents) AS a, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AS b) SELECT unnest(['unique_references', 'labels_known']) AS check_name, unnest([a, b]) AS passed FROM v")
def verify(spark, d):
    docs = read(spark, d, "documents")
    first = K.manifest(docs, {"unique_references": F.count("*") == F.countDistinct("doc_id")})
    second = K.manifest(read(spark, d, "labels").join(docs, "doc_id", "left_anti"), {"labels_known": F.count("*") == 0})
    return first.unionByName(second)


@query("bank.pilot_sample", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) ORDER BY p, source LIMIT 45")
def pilot_sample(spark, d):
    return B.pilot_sample(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 45)


@query("bank.token_stats", "WITH t AS (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM documents) SELECT count(*) FILTER (n > 256) AS n_truncated, max(n)::INTEGER AS most, median(n) AS median FROM t")
def token_stats(spark, d):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return read(spark, d, "documents").select(n.alias("n")).agg(F.count_if(F.col("n") > 256).alias("n_truncated"), F.max("n").alias("most"), F.median("n").alias("median"))
