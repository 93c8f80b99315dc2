"""Working tables of the engine, derived from the provided tables (Spark side and the same in SQL for the oracles)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalkline.operators.chunking import named
from chalkline.sources.tables import spread


TEXTS = ("documents", "pages")  # every row costs much more than its transport


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines spoken by the event log: doc_id (user), line_no, line."""
    time, kind = F.date_format("ts", "HH:mm:ss"), F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(F.lit("Speaker "), "user_id", F.lit(" - "), time, F.lit(": um, error [audio glitch] then "), "value"))
        .when(kind == "click", F.concat(F.lit("["), time, F.lit("] Teacher: click click click the key the key "), "value"))
        .when(kind == "view", F.concat(time, F.lit(" --> "), time, F.lit(" view ??? [view] (music)")))
        .when(kind == "purchase", F.lit("Python: purchase uh-huh, erm okay. Purchase made. purchase  made."))
        .otherwise(F.lit("Person A: signup <unk> signup   ,done [unclear] hmm"))
    )
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), line.alias("line"))


EVENT_LINES = """ev AS (SELECT user_id AS doc_id, event_id AS line_no, CASE event_type
  WHEN 'error' THEN 'Speaker ' || user_id || ' - ' || strftime(ts, '%H:%M:%S') || ': um, error [audio glitch] then ' || value
  WHEN 'click' THEN '[' || strftime(ts, '%H:%M:%S') || '] Teacher: click click click the key the key ' || value
  WHEN 'view' THEN strftime(ts, '%H:%M:%S') || ' --> ' || strftime(ts, '%H:%M:%S') || ' view ??? [view] (music)'
  WHEN 'purchase' THEN 'Python: purchase uh-huh, erm okay. Purchase made. purchase  made.'
  ELSE 'Person A: signup <unk> signup   ,done [unclear] hmm' END AS line FROM events)"""


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line; blank lines stay."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """lines AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def sentences(of: DataFrame) -> DataFrame:
    """doc_id, line_no, sent_no, sentence: lines cut after closing punctuation; blank ones dropped."""
    cut = of.select("doc_id", "line_no", F.posexplode(F.split("line", r"(?<=[.!?])\s+")).alias("sent_no", "sentence"))
    return cut.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


SENTENCES = (
    LINES
    + """, cut AS (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM lines),
each AS (SELECT doc_id, line_no, unnest(range(len(s)))::INTEGER AS sent_no, trim(unnest(s)) AS sentence FROM cut),
sentences AS (SELECT * FROM each WHERE sentence <> '')"""
)


def sentence_array(text: Column) -> Column:
    """All sentences of a text in order: lines cut after closing punctuation, blank ones dropped."""
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.split(line, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim would take the place as the signs to trim


def numbered_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos (0-based within the document), sentence, words (array), n_words; numbered in the row, without a shuffle."""
    out = docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("pos", "sentence"))
    words = out.withColumn("words", F.split(F.trim(F.regexp_replace("sentence", r"[ \t]+", " ")), " "))
    return words.select("doc_id", "pos", "sentence", "words", F.size("words").alias("n_words"))


NUMBERED = (
    SENTENCES
    + """, numbered AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, sent_no) - 1)::INTEGER AS pos, sentence,
  string_split(trim(regexp_replace(sentence, '[ \\t]+', ' ', 'g')), ' ') AS words FROM sentences)"""
)

CHUNK_SENTENCES = 8


def chunks(docs: DataFrame) -> DataFrame:
    """Fixed-size chunks of sentences: doc_id, chunk_id (0-based), pos, sentence, words."""
    return numbered_sentences(docs).withColumn("chunk_id", F.expr(f"pos div {CHUNK_SENTENCES}").cast("int"))


CHUNKS = NUMBERED + f", chunked AS (SELECT *, (pos // {CHUNK_SENTENCES})::INTEGER AS chunk_id FROM numbered)"


#: the tables hold invented words, so sentences of a lesson begin with one of these, by position
OPENINGS = (
    "", "For example, ", "", "To recap, we covered ", "Because of this, ", "", "It is a ", "By the way, ", "Unlike ", "", "What happens if we say ", "Suppose that ",
    "", "In summary, today we studied ", "This means that ", "", "How many are in ", "We will cover ", "Compared with ", "", "Try this question, since it allows ", "", "Remember we did ", "Let's move on to the next topic: ",
)


def opening(pos: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, OPENINGS)), F.pmod(F.col("doc_id") * 7 + pos, F.lit(len(OPENINGS))).cast("int") + 1)


def chunk_arrays(docs: DataFrame, told: Callable[[Column, Column], Column] = lambda s, i: s) -> DataFrame:
    """doc_id, chunk_id and sentences (array of (pos, sentence)), each sentence as ``told`` (sentence, pos) has it; no shuffle."""
    every = F.transform(sentence_array(F.col("text")), lambda s, i: F.struct(i.alias("pos"), told(s, i).alias("sentence")))
    part = lambda s: lambda k: F.struct(k.alias("chunk_id"), F.slice(s, k * CHUNK_SENTENCES + 1, CHUNK_SENTENCES).alias("sentences"))
    count = lambda s: F.floor((F.size(s) + CHUNK_SENTENCES - 1) / CHUNK_SENTENCES).cast("int")
    cut = named(every, lambda s: F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), count(s) - 1), part(s))))
    return docs.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")  # no row carries the whole text beside its chunk


def lesson_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, chunk_id and sentences (array of (pos, sentence)), sentences with their openings; no shuffle."""
    return chunk_arrays(docs, lambda s, i: F.concat(opening(i), s))


def lesson_sentences(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(sentence_array(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.expr(f"pos div {CHUNK_SENTENCES}").cast("int").alias("chunk_id"), "pos", F.concat(opening(F.col("pos")), "s").alias("sentence"))


_LIST = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in OPENINGS) + "]"
LESSON = CHUNKS + f", lesson AS (SELECT doc_id, chunk_id, pos, ({_LIST})[(doc_id * 7 + pos) % {len(OPENINGS)} + 1] || sentence AS sentence FROM chunked)"


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue from benchmark: concept_id, label, section, aliases (array<struct<alias, n_words, ambiguous>>)."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    base = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), "text")
    two = F.concat_ws(" ", F.slice("w", 1, 2))
    return base.where(F.size("w") >= 2).select(
        F.concat(F.lit("c"), "item_id").alias("concept_id"), two.alias("label"), (F.col("item_id") % 8).cast("int").alias("section"),
        F.array(
            F.struct(two.alias("alias"), F.lit(2).alias("n_words"), F.lit(False).alias("ambiguous")),
            F.struct(F.element_at("w", 2).alias("alias"), F.lit(1).alias("n_words"), F.lit(True).alias("ambiguous")),
        ).alias("aliases"),
    )


def aliases(of: DataFrame) -> DataFrame:
    return of.select("concept_id", F.explode("aliases").alias("a")).select("concept_id", "a.alias", "a.n_words", "a.ambiguous").distinct()


ALIASES = """bw AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
concepts AS (SELECT 'c' || item_id AS concept_id, w[1] || ' ' || w[2] AS label, (item_id % 8)::INTEGER AS section, w FROM bw WHERE len(w) >= 2),
aliases AS (SELECT DISTINCT * FROM (SELECT concept_id, label AS alias, 2 AS n_words, false AS ambiguous FROM concepts UNION ALL SELECT concept_id, w[2], 1, true FROM concepts))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding, section, reference, marks, n (0-based rank inside the section is not needed)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("section"), (F.col("label") * 10 + F.col("vec_id") % 3).cast("int").alias("reference"), (F.col("vec_id") % 12 + 1).cast("int").alias("marks"))


VECTORS = "vectors AS (SELECT vec_id, embedding, label AS section, (label * 10 + vec_id % 3)::INTEGER AS reference, (vec_id % 12 + 1)::INTEGER AS marks FROM embeddings)"
