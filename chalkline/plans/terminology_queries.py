"""Queries over terminology correction: the vocabulary is made of benchmark words, texts are documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import terminology as T
from chalkline.plans.bridges import ALIASES, NUMBERED, aliases, concepts, numbered_sentences, read
from chalkline.plans.registry import query

KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s_\\-/.]+', ' ', 'g'), '[^a-z0-9+# ]', '', 'g'), ' +', ' ', 'g'))"


@query("trm.key", f"WITH {NUMBERED} SELECT doc_id, pos, {KEY.format('sentence')} AS key FROM numbered")
def trm_key(spark, d):
    return numbered_sentences(read(spark, d, "documents")).select("doc_id", "pos", T.term_key(F.col("sentence")).alias("key"))


@query("trm.inflect", """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS a FROM part), p AS (SELECT a, unnest([a || 's', a || 'es', a || 'x', regexp_replace(a, 'y$', 'ies')]) AS b FROM w)
SELECT a, b, (b = a || 's' OR b = a || 'es' OR (a LIKE '%y' AND b = a[1:len(a) - 1] || 'ies') OR a = b || 's' OR a = b || 'es' OR (b LIKE '%y' AND a = b[1:len(b) - 1] || 'ies')) AS same FROM p""")
def inflect(spark, d):
    w = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    p = w.select("a", F.explode(F.array(F.concat("a", F.lit("s")), F.concat("a", F.lit("es")), F.concat("a", F.lit("x")), F.regexp_replace("a", "y$", "ies"))).alias("b"))
    return p.select("a", "b", T.inflected(F.col("a"), F.col("b")).alias("same"))


def _vocab(spark, d):
    bench = read(spark, d, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("term")).where("term <> ''").select("term", F.lit(2).alias("priority"))
    names = read(spark, d, "part").select(F.col("p_name").alias("term"), F.lit(1).alias("priority"))
    return T.vocabulary(bench, names)


@query("trm.vocab", f"""WITH r AS (SELECT * FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS term, 2 AS priority FROM benchmark) WHERE term <> '' UNION ALL SELECT p_name, 1 FROM part), k AS (SELECT *, {KEY.format('term')} AS key FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, len(term), term) AS n FROM k WHERE key <> '') SELECT key, term, priority, len(string_split(key, ' '))::INTEGER AS n_words FROM b WHERE n = 1""")
def vocab(spark, d):
    return _vocab(spark, d)


@query("trm.spoken", """WITH s AS (SELECT event_id, 'call user' || user_id || ' dot ' || event_type || ' then ' || value AS sentence FROM events)
SELECT event_id, regexp_replace(sentence, '(?i)\\b([A-Za-z_][A-Za-z0-9_]*) dot ([A-Za-z_][A-Za-z0-9_]*)\\b', '\\1.\\2', 'g') AS fixed, regexp_extract_all(sentence, '(?i)\\b([A-Za-z_][A-Za-z0-9_]*) dot ([A-Za-z_][A-Za-z0-9_]*)\\b') AS hits FROM s""")
def spoken(spark, d):
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("call user"), "user_id", F.lit(" dot "), "event_type", F.lit(" then "), "value").alias("sentence"))
    return T.spoken_dots(e).select("event_id", "fixed", "hits")


STRONG_ANCHORS, WEAK_ANCHORS, STRONG_WORDS = ("reer", "the,"), ("the", "and", "of"), ("reer", "heer", "over")


@query("trm.context", f"""WITH {NUMBERED}, a AS (SELECT doc_id, pos, words, list_sort(list_distinct(list_filter(words, lambda w: w IN ('reer', 'the,', 'the', 'and', 'of')))) AS anchors FROM numbered)
SELECT doc_id, pos, anchors, len(list_intersect(words, ['reer', 'the,'])) > 0 OR len(anchors) >= 2 AS enough FROM a""")
def context(spark, d):
    found, enough = T.anchors_in(F.col("words"), STRONG_ANCHORS, WEAK_ANCHORS)
    return numbered_sentences(read(spark, d, "documents")).select("doc_id", "pos", found.alias("anchors"), enough.alias("enough"))


def _tokens(spark, d):
    return numbered_sentences(read(spark, d, "documents")).select("doc_id", "pos", F.filter(F.split(T.term_key(F.col("sentence")), " "), lambda w: w != "").alias("tokens"))


def _terms(spark, d):
    """The first one to four words of every benchmark item."""
    words = F.filter(F.split(T.term_key(F.col("text")), " "), lambda w: w != "")
    starts = read(spark, d, "benchmark").select(words.alias("w")).select(F.explode(F.transform(F.array(*map(F.lit, range(1, 5))), lambda n: F.slice("w", 1, n))).alias("t"))
    return starts.select(F.array_join("t", " ").alias("key"), F.size("t").alias("n_words")).where("key <> ''").distinct()


def _spans(spark, d):
    return T.detect(numbered_sentences(read(spark, d, "documents")), _terms(spark, d), anchors=(STRONG_WORDS, WEAK_ANCHORS))


@query("trm.detect")
def detect(spark, d):
    return _spans(spark, d)


@query("trm.span_overlap")
def span_overlap(spark, d):
    return T.pick_spans(_spans(spark, d))


_MEMORY = "memory AS (SELECT o_orderkey AS memory_id, o_orderpriority AS key, 'fix ' || o_orderkey % 97 AS correction, list_distinct(['c' || o_custkey % 3, 'c' || o_custkey % 5]) AS context, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'candidate' END AS status, (o_orderkey % 10) / 10.0 AS confidence, o_orderkey % 4 AS times_applied FROM orders)"


def _memory(spark, d):
    of = lambda n: F.concat(F.lit("c"), F.col("o_custkey") % n)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderpriority").alias("key"), F.concat(F.lit("fix "), F.col("o_orderkey") % 97).alias("correction"), F.array_distinct(F.array(of(3), of(5))).alias("context"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("candidate").alias("status"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), (F.col("o_orderkey") % 4).alias("times_applied"))


_ASKED = "asked AS (SELECT c_custkey AS id, (['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'])[c_custkey % 4 + 1] AS key, ['c' || c_custkey % 5, 'c' || (c_custkey % 2 + 6)] AS context FROM customer)"
_LOOKED = f"""{_MEMORY}, {_ASKED}, f AS (SELECT a.id, a.key, m.memory_id, m.correction, m.confidence, m.times_applied, round(len(list_intersect(a.context, m.context)) / len(list_distinct(a.context || m.context))::DOUBLE, 6) AS likeness FROM asked a JOIN memory m USING (key) WHERE m.status = 'approved'),
looked AS (SELECT id, key, memory_id, correction, likeness FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY likeness DESC, confidence DESC, times_applied DESC, memory_id) AS r FROM f WHERE likeness >= 0.20) WHERE r = 1)"""


def _looked(spark, d):
    keys = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    asked = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), keys.alias("key"), F.array(F.concat(F.lit("c"), F.col("c_custkey") % 5), F.concat(F.lit("c"), F.col("c_custkey") % 2 + 6)).alias("context"))
    return T.memory_lookup(asked, _memory(spark, d))


@query("trm.memory_lookup", f"WITH {_LOOKED} SELECT * FROM looked")
def memory_lookup(spark, d):
    return _looked(spark, d)


#: what is proposed for "wild loop", one case for each check of the validator in its order, then three good ones
CASES = (
    # original, replacement, confidence, answered, detected, shift, after, reason
    ("wild loop", "while loop", 0.9, 1, "wild loop", 0, "", "other_issue"),
    ("wild loop", "while loop", 0.9, 0, "wild loops", 0, "", "not_the_span"),
    ("wild loop", "while loop", 0.9, 0, "wild loop", 1, "", "source_changed"),
    ("wild loop", " ", 0.9, 0, "wild loop", 0, "", "empty_replacement"),
    ("wild loop", "while loop", 0.8, 0, "wild loop", 0, "", "low_confidence"),
    ("wild loop", "while\nloop", 0.9, 0, "wild loop", 0, "", "line_break"),
    ("wild loop", "a b c d e f g", 0.9, 0, "wild loop", 0, "", "too_long"),
    ("wild loop", "while loop!", 0.9, 0, "wild loop", 0, "", "unsupported_characters"),
    ("?!", "while loop", 0.9, 0, "?!", 0, "", "no_content"),
    ("wild loop", "Wild-Loop", 0.9, 0, "wild loop", 0, "", "format_only"),
    ("while loops", "wild loops", 0.9, 0, "while loops", 0, "", "already_valid"),
    ("wild, loop", "while loop", 0.9, 0, "wild, loop", 0, "", "crosses_punctuation"),
    ("wild loop", "while", 0.9, 0, "wild loop", 0, "", "token_count"),
    ("big trees", "big tree", 0.9, 0, "big trees", 0, "", "inflection_only"),
    ("wild lop", "while loop", 0.9, 0, "wild lop", 0, "", "several_tokens"),
    ("for loop", "four loop", 0.9, 0, "for loop", 0, "", "control_word"),
    ("zebra loop", "while loop", 0.9, 0, "zebra loop", 0, "", "not_close"),
    ("lenghht", "length", 0.9, 0, "lenghht", 0, "", "too_many_edits"),
    ("while lop", "while loop", 0.9, 0, "while lop", 0, " less than high", "control_flow"),
    ("wild leap", "wild leaps now", 0.9, 0, "wild leap", 0, "", "token_count"),
    ("wild leap", "wild heap", 0.9, 0, "wild leap", 0, "", "not_supported"),
    ("wild loop", "while loop", 0.9, 0, "wild loop", 0, " checks", None),
    ("algoritm", "algorithm", 0.9, 0, "algoritm", 0, "", None),
    ("arr lem", "arr.len", 0.9, 0, "arr lem", 0, "", None),
)
_TERM_KEYS = ("while loop", "algorithm", "length", "array length")


def _proposals(spark, d):
    """Every part proposes one of the cases."""
    fields = ("original", "replacement", "confidence", "answered", "detected", "shift", "after")
    value = lambda v: F.lit(float(v)) if isinstance(v, float) else F.lit(v)
    case = F.element_at(F.array(*[F.struct(*[value(v).alias(k) for k, v in zip(fields, c)]) for c in CASES]), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", case.alias("c")).select("id", "p_name", "c.*")
    text = F.concat("p_name", F.lit(" "), "detected", "after")
    return rows.select("id", (F.col("id") + F.col("answered")).alias("answered_id"), "original", "replacement", "confidence", "detected", text.alias("text"), (F.length("p_name") + 1 + F.col("shift")).alias("start"), "after", F.array(F.lit("binary search")).alias("candidates"))


def _judged(spark, d):
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, _TERM_KEYS))).alias("key"))
    return T.validate(_proposals(spark, d), terms)


_REASONS = "[" + ", ".join("NULL" if c[-1] is None else f"'{c[-1]}'" for c in CASES) + "]"
_NEW = "[" + ", ".join("'" + c[1].replace("\n", "' || chr(10) || '") + "'" for c in CASES) + "]"
_PROPOSED = f"judged AS (SELECT p_partkey AS id, ({_NEW})[p_partkey % {len(CASES)} + 1] AS replacement, ({_REASONS})[p_partkey % {len(CASES)} + 1] AS reason FROM part)"


@query("trm.validate", f"WITH {_PROPOSED} SELECT id, reason, reason IS NULL AS ok FROM judged")
def validate(spark, d):
    return _judged(spark, d).select("id", "reason", "ok")


@query("trm.resolve", f"""WITH {_LOOKED}, {_PROPOSED}, i AS (SELECT c_custkey % 10 AS doc_id, c_custkey // 10 AS pos, c_custkey AS id FROM customer),
m AS (SELECT i.*, l.correction AS m FROM i LEFT JOIN looked l USING (id)), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM m WHERE m IS NULL),
a AS (SELECT r.doc_id, r.id, CASE WHEN s > 20 THEN 'unrequested' WHEN j.id IS NULL THEN 'requested' WHEN j.reason IS NULL THEN 'proposed' ELSE 'rejected' END AS route, j.replacement FROM r LEFT JOIN judged j ON j.id = r.id)
SELECT doc_id, id, 'memory' AS route, m AS correction FROM m WHERE m IS NOT NULL UNION ALL SELECT doc_id, id, route, CASE WHEN route = 'proposed' THEN replacement END FROM a""")
def resolve(spark, d):
    issues = read(spark, d, "customer").select((F.col("c_custkey") % 10).alias("doc_id"), F.expr("c_custkey div 10").alias("pos"), F.col("c_custkey").alias("id"))
    return T.resolve(issues, _looked(spark, d), _judged(spark, d))


@query("trm.request_batch", """WITH a AS (SELECT p_partkey // 4 AS answer_id, p_partkey % 4 AS place, p_partkey % 500 AS id, p_name AS replacement, p_retailprice AS confidence FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY answer_id, place) AS r FROM a WHERE id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)) SELECT id, replacement, confidence FROM k WHERE r = 1""")
def request_batch(spark, d):
    parts = read(spark, d, "part").withColumn("answer_id", F.expr("p_partkey div 4"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("k"), F.struct((F.col("p_partkey") % 500).alias("id"), F.col("p_name").alias("replacement"), F.col("p_retailprice").alias("confidence")).alias("v")))), lambda x: x["v"])
    answers = parts.groupBy("answer_id").agg(F.to_json(listed).alias("answer"))
    return T.responses(answers, read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id")))


def _corrections(spark, d):
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") * 3).alias("start"), (F.col("l_linenumber") * 3 + F.col("l_quantity") % 5 + 1).cast("int").alias("stop"), F.concat(F.lit("<"), F.col("l_linenumber"), F.lit(">")).alias("replacement"))
    return line.groupBy("id", "start").agg(F.min(F.struct("stop", "replacement")).alias("m")).select("id", "start", "m.stop", "m.replacement")


@query("trm.non_overlap")
def non_overlap(spark, d):
    return T.non_overlapping(_corrections(spark, d))


@query("trm.apply", """WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS text FROM part) SELECT id, text[1:2] || '<b>' || text[5:5] || '<a>' || text[8:] AS text FROM t""")
def trm_apply(spark, d):
    texts = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    spans = texts.select("id", F.explode(F.array(F.struct(F.lit(5).alias("start"), F.lit(7).alias("stop"), F.lit("<a>").alias("replacement")), F.struct(F.lit(2).alias("start"), F.lit(4).alias("stop"), F.lit("<b>").alias("replacement")))).alias("c")).select("id", "c.*")
    return T.apply_spans(texts, spans)


@query("trm.rule_normalise", f"""WITH {NUMBERED}, r AS (SELECT doc_id, pos, sentence, CASE WHEN regexp_matches(sentence, '\\bthe\\b') THEN regexp_replace(sentence, '\\bof and\\b', 'OF-AND', 'g') ELSE sentence END AS a FROM numbered),
s AS (SELECT *, CASE WHEN NOT regexp_matches(sentence, '\\bis\\b') THEN regexp_replace(a, '\\band th', 'and TH', 'g') ELSE a END AS fixed FROM r)
SELECT doc_id, pos, fixed, list_filter([CASE WHEN a <> sentence THEN 'of_and' END, CASE WHEN fixed <> a THEN 'and_th' END], lambda x: x IS NOT NULL) AS applied FROM s""")
def rule_normalise(spark, d):
    rules = [{"name": "of_and", "pattern": r"\bof and\b", "replacement": "OF-AND", "context": r"\bthe\b"}, {"name": "and_th", "pattern": r"\band th", "replacement": "and TH", "forbidden": r"\bis\b"}]
    return T.apply_rules(numbered_sentences(read(spark, d, "documents")), rules).select("doc_id", "pos", "fixed", "applied")


@query("trm.fuzzy_spelling")
def fuzzy_spelling(spark, d):
    words = _tokens(spark, d).select(F.explode("tokens").alias("word")).where(F.length("word") >= 5)
    terms = aliases(concepts(spark, d)).where("n_words = 1").select(F.col("alias").alias("term")).distinct()
    return T.fuzzy_spelling(words, terms, floor=0.85)
