"""Queries over the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chalkline.operators import cleaning as C
from chalkline.plans.bridges import EVENT_LINES, LINES, SENTENCES, event_lines, lines, read, sentences
from chalkline.plans.registry import query

CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
TALK_ROLES = (*C.ROLES, "user", "assistant", "system")
ROLE = C.role_pattern()


def _talk(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))


@query("cln.speaker_ts", f"""WITH {EVENT_LINES}, c AS (SELECT *, regexp_replace(line, '(?i)^\\s*{ROLE}\\s*[-–—]\\s*[\\[\\(]?{CLOCK}[\\]\\)]?\\s*:\\s*', '') AS cleaned FROM ev)
SELECT doc_id, line_no, cleaned, cleaned <> line AS changed FROM c""")
def speaker_ts(spark, d):
    e = event_lines(spark, d).withColumn("cleaned", C.speaker_timestamp(F.col("line")))
    return e.select("doc_id", "line_no", "cleaned", (F.col("cleaned") != F.col("line")).alias("changed"))


@query("cln.timestamp", f"""WITH {EVENT_LINES}, r AS (SELECT *, regexp_replace(line, '^\\s*{CLOCK}\\s*-->\\s*{CLOCK}\\s*', '') AS r FROM ev),
c AS (SELECT *, CASE WHEN r <> line THEN r ELSE regexp_replace(line, '^\\s*[\\[\\(]?{CLOCK}[\\]\\)]?\\s*', '') END AS cleaned FROM r)
SELECT doc_id, line_no, cleaned, cleaned <> line AS changed FROM c""")
def timestamp(spark, d):
    e = event_lines(spark, d).withColumn("cleaned", C.timestamp(F.col("line")))
    return e.select("doc_id", "line_no", "cleaned", (F.col("cleaned") != F.col("line")).alias("changed"))


@query("cln.speaker", f"""WITH t AS (SELECT conv_id, turn, role || ': ' || text AS line FROM conversations),
c AS (SELECT *, regexp_replace(line, '(?i)^\\s*{C.role_pattern(TALK_ROLES)}\\s*:\\s*', '') AS cleaned FROM t)
SELECT conv_id, turn, cleaned, cleaned <> line AS changed FROM c""")
def speaker(spark, d):
    t = _talk(spark, d).withColumn("cleaned", C.speaker(F.col("line"), TALK_ROLES))
    return t.select("conv_id", "turn", "cleaned", (F.col("cleaned") != F.col("line")).alias("changed"))


def _removed(pattern):
    def run(spark, d):
        text, n = C.removed(F.col("line"), pattern)
        return event_lines(spark, d).select("doc_id", "line_no", text.alias("cleaned"), n.alias("n"))

    return run


def _removed_sql(pattern):
    return f"""WITH {EVENT_LINES} SELECT doc_id, line_no, regexp_replace(line, '{pattern}', '', 'g') AS cleaned, len(regexp_extract_all(line, '{pattern}'))::INTEGER AS n FROM ev"""


query("cln.artefact", _removed_sql(C.NOISE))(_removed(C.NOISE))
query("cln.uncertain", _removed_sql(C.UNCERTAIN))(_removed(C.UNCERTAIN))


@query("cln.filler", f"""WITH {EVENT_LINES}, w AS (SELECT doc_id, line_no, regexp_replace(' ' || line || ' ', '(?i)([^A-Za-z0-9_-])(?:um+|uh+|erm+|hmm+)(?:[ \\t]*,[ \\t]*|([^A-Za-z0-9_-]))', '\\1\\2', 'g') AS t,
 len(regexp_extract_all(' ' || line || ' ', '(?i)[^A-Za-z0-9_-](?:um+|uh+|erm+|hmm+)[^A-Za-z0-9_-]'))::INTEGER AS n FROM ev)
SELECT doc_id, line_no, t[2:len(t) - 1] AS cleaned, n FROM w""")
def filler(spark, d):
    return _removed(C.FILLER)(spark, d)


#: words and what stands between them, islands of equal neighbours, and what is left of each
@query("cln.repeat_word", f"""WITH {LINES}, p AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ps FROM lines),
e AS (SELECT doc_id, line_no, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM p), w AS (SELECT *, regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]+') AS word, lag(x) OVER l AS gap, lag(x, 2) OVER l AS last FROM e WINDOW l AS (PARTITION BY doc_id, line_no ORDER BY i)),
s AS (SELECT *, coalesce(word AND regexp_full_match(x, '[A-Za-z]+') AND lower(x) = lower(last) AND regexp_full_match(gap, '\\s+'), false) AS same FROM w),
g AS (SELECT *, sum((word AND NOT same)::INTEGER) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS g FROM s), k AS (SELECT *, word AND same AND count(*) FILTER (word) OVER (PARTITION BY doc_id, line_no, g) >= 3 AS gone FROM g),
r AS (SELECT *, gone OR (NOT word AND coalesce(lead(gone) OVER (PARTITION BY doc_id, line_no ORDER BY i), false)) AS left_out FROM k),
o AS (SELECT doc_id, line_no, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT left_out), '') AS cleaned, count(*) FILTER (gone) AS n FROM r GROUP BY ALL)
SELECT l.doc_id, l.line_no, coalesce(o.cleaned, '') AS cleaned, coalesce(o.n, 0)::INTEGER AS n FROM lines l LEFT JOIN o USING (doc_id, line_no)""")
def repeat_word(spark, d):
    text, n = C.repeated_word(F.col("line"))
    return lines(read(spark, d, "documents")).select("doc_id", "line_no", text.alias("cleaned"), n.alias("n"))


@query("cln.repeat_phrase", f"WITH {EVENT_LINES} SELECT doc_id, line_no, replace(line, 'click click click the key the key', 'click the key') AS cleaned, CASE WHEN contains(line, 'click click') THEN 4 ELSE 0 END AS n FROM ev")
def repeat_phrase(spark, d):
    text, n = C.repeated_phrase(F.col("line"))
    return event_lines(spark, d).select("doc_id", "line_no", text.alias("cleaned"), n.alias("n"))


@query("cln.repeat_sentence", f"""WITH {SENTENCES}, n AS (SELECT *, trim(regexp_replace(lower(sentence), '\\s+', ' ', 'g')) AS n FROM sentences),
p AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) AS p FROM n) SELECT doc_id, line_no, sent_no, sentence FROM p WHERE p IS NULL OR p <> n""")
def repeat_sentence(spark, d):
    return C.drop_repeated_sentences(sentences(lines(read(spark, d, "documents")))).select("doc_id", "line_no", "sent_no", "sentence")


_WS = "replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), chr(160), ' ')"


@query("cln.whitespace", f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_WS}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' +([,.!?;:])', '\\1', 'g')) AS cleaned FROM documents""")
def whitespace(spark, d):
    return read(spark, d, "documents").select("doc_id", C.whitespace(F.col("text")).alias("cleaned"))


@query("cln.warnings", """SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '[A-Za-z]{30,}') THEN 'long_token' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END], lambda x: x IS NOT NULL) AS warnings FROM documents""")
def warnings(spark, d):
    return read(spark, d, "documents").select("doc_id", C.warnings(F.col("text")).alias("warnings"))


_KEY = "trim(regexp_replace(lower(regexp_replace(trim(line), '(?i)\\.(?:docx?|pdf|txt|rtf)$', '')), '[^a-z0-9]+', ' ', 'g'))"
_WHOLE = " OR ".join(f"regexp_full_match(trim(line), '{p}')" for p in (C.FIELD, C.HEADING, C.SYNTHETIC, C.RULE))


#: what some lines of a document are replaced by, so that there is metadata to find
_HEADS = "CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'Page ' || line_no || ' of 9' WHEN line_no = 1 AND doc_id % 3 = 0 THEN 'Title: lesson ' || doc_id WHEN doc_id % 5 = 2 AND line_no = 3 THEN source || '.docx' WHEN doc_id % 4 = 1 AND line_no % 6 = 2 THEN 'Raw transcript - part' WHEN (doc_id + line_no) % 13 = 0 THEN '-----' ELSE line END"


@query("cln.metadata", f"""WITH {LINES}, headed AS (SELECT doc_id, line_no, {_HEADS} AS line FROM lines JOIN (SELECT doc_id, source FROM documents) USING (doc_id)), k AS (SELECT l.*, {_KEY} AS k, regexp_full_match(trim(line), '{C.PAGE}') OR {_KEY} = source AS sure, trim(line) <> '' AND (regexp_full_match(trim(line), '{C.PAGE}') OR {_KEY} = source OR {_WHOLE}) AS strong FROM headed l JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
w AS (SELECT *, count(*) FILTER (trim(line) <> '') OVER (PARTITION BY doc_id ORDER BY line_no) AS seen, count(*) OVER (PARTITION BY doc_id, k) AS same FROM k)
SELECT doc_id, line_no, trim(line) AS removed FROM w WHERE (seen <= 12 AND strong) OR sure OR (k <> '' AND same >= 2 AND strong)""")
def metadata(spark, d):
    docs = read(spark, d, "documents")
    of = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.expr(_HEADS))
    return C.mark_metadata(of, F.col("source")).where("is_metadata").select("doc_id", "line_no", F.trim("line").alias("removed"))


@query("cln.pipeline")
def pipeline(spark, d):
    return C.clean_transcripts(read(spark, d, "documents").select("doc_id", "text", "source"), "source").drop("removed_lines")


@query("cln.llm_guard", """WITH r AS (SELECT event_id, 'a[' || user_id || '] = ' || value || ' + b[' || event_type || ']' AS original, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN 'a[' || user_id || '] = ' || value WHEN 'view' THEN 'b[' || event_type || '] + a[' || user_id || '] = ' || value ELSE 'a[0] = ' || value || ' + b[' || event_type || ']' END AS rewrite FROM events),
p AS (SELECT event_id, original, rewrite, len(rewrite) / len(original) AS ratio, list_sort(regexp_extract_all(original, '[A-Za-z_][A-Za-z0-9_]*\\[[^\\]]*\\]')) AS ro, list_sort(regexp_extract_all(rewrite, '[A-Za-z_][A-Za-z0-9_]*\\[[^\\]]*\\]')) AS rr FROM r),
q AS (SELECT event_id, list_filter([CASE WHEN trim(rewrite) = '' THEN 'empty' END, CASE WHEN ratio < 0.5 OR ratio > 1.5 THEN 'length' END, CASE WHEN ro <> rr THEN 'references' END,
 CASE WHEN len(regexp_extract_all(original, '\\+')) <> len(regexp_extract_all(rewrite, '\\+')) OR len(regexp_extract_all(original, '=')) <> len(regexp_extract_all(rewrite, '=')) THEN 'operators' END], lambda x: x IS NOT NULL) AS problems FROM p)
SELECT event_id, problems, len(problems) = 0 AS ok FROM q""")
def llm_guard(spark, d):
    e, kind = read(spark, d, "events"), F.col("event_type")
    original = F.concat(F.lit("a["), "user_id", F.lit("] = "), "value", F.lit(" + b["), "event_type", F.lit("]"))
    rewrite = F.when(kind == "error", "").when(kind == "click", F.concat(F.lit("a["), "user_id", F.lit("] = "), "value")).when(kind == "view", F.concat(F.lit("b["), "event_type", F.lit("] + a["), "user_id", F.lit("] = "), "value")).otherwise(F.concat(F.lit("a[0] = "), "value", F.lit(" + b["), "event_type", F.lit("]")))
    return C.guard_rewrites(e.select("event_id", original.alias("original"), rewrite.alias("rewrite"))).select("event_id", "problems", "ok")
