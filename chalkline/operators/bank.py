"""Question bank: rows and markers out of word and line tables, linking, quality, review queue, coverage.

Input contract: words (pair_key, page, x0, y0, x1, y1, text) or lines (pair_key, line_no, text).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["pair_key", "page"]


def rows(words: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """Words joined to rows: a new row begins where y jumps by more than the tolerance; text in x order, bounding box."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0")
    jump = F.coalesce((F.col("y0") - F.lag("y0").over(order) > tolerance).cast("int"), F.lit(0))
    numbered = words.withColumn("_j", jump).withColumn("row_no", F.sum("_j").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy(*PAGE, "row_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def without_noise(of: DataFrame, top: float = 30, bottom: float = 770, left: float = 20) -> DataFrame:
    """Without header, footer and margin fragments, by position and text."""
    noise = (F.col("y0") < top) | (F.col("y0") > bottom) | (F.col("x1") < left) | F.col("text").rlike(r"(?i)^(?:page \d+|turn over|\d+|end of questions)$")
    return of.where(~noise)


def normal_text(text: Column) -> Column:
    """Typographic signs as plain ones, blanks folded."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”–—×− ", "''\"\"--x- "), r"\s+", " "))


def question_number(raw: Column) -> Column:
    """Printed numbers as plain ones: "0 1 . 2" is 1.2."""
    parts = F.split(F.regexp_replace(raw, r"\s+", ""), r"\.")
    return F.array_join(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.coalesce(F.nullif(F.regexp_replace(p, "^0+", ""), F.lit("")), F.lit("0"))), ".")


MARKER = r"^\s*(\d{1,2}(?:\s*\.\s*\d{1,2})?)[.)]?\s+(.*)$"


def markers(lines: DataFrame, largest: int = 30) -> DataFrame:
    """lines with marker (question number, or null) and rest: the text after it."""
    number = question_number(F.regexp_extract("text", MARKER, 1))
    ok = F.col("text").rlike(MARKER) & F.coalesce(F.split_part(number, F.lit("."), F.lit(1)).try_cast("int").between(1, largest), F.lit(False))
    return lines.withColumn("marker", F.when(ok, number)).withColumn("rest", F.when(ok, F.regexp_extract("text", MARKER, 2)).otherwise(F.col("text")))


MARKS = r"[\[(](\d+)\s*marks?[\])]"


def segment(marked: DataFrame) -> DataFrame:
    """Questions: the lines from a marker to the next; the last mark label counts; first and last line."""
    order = Window.partitionBy("pair_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("seq", F.sum(F.col("marker").isNotNull().cast("int")).over(order)).where("seq > 0")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "rest"))), lambda x: x["rest"]), "\n")
    out = numbered.groupBy("pair_key", "seq").agg(F.max("marker").alias("number"), text.alias("text"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    labels = F.regexp_extract_all("text", F.lit(MARKS), F.lit(1))
    return out.withColumn("marks", F.when(F.size(labels) > 0, F.element_at(labels, -1).cast("int")))


def merge_continued(questions: DataFrame) -> DataFrame:
    """Joins a question without marks to the next of the same number that has them and starts right after."""
    order = Window.partitionBy("pair_key").orderBy("seq")
    goes_on = (F.lag("number").over(order) == F.col("number")) & F.lag("marks").over(order).isNull() & F.col("marks").isNotNull() & (F.col("first_line") == F.lag("last_line").over(order) + 1)
    island = questions.withColumn("_g", F.coalesce(goes_on, F.lit(False))).withColumn("_k", F.sum((~F.col("_g")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    return island.groupBy("pair_key", F.col("_k").alias("seq")).agg(F.first("number").alias("number"), text.alias("text"), F.max("marks").alias("marks"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count("*").alias("n_parts"))


def without_data_rows(lines: DataFrame) -> DataFrame:
    """Without table rows of numbers or dates that look like markers."""
    return lines.where(~F.col("text").rlike(r"^[\s\d.,:/|-]+$") & ~F.col("text").rlike(r"^\d{1,2}[ /.-]\d{1,2}[ /.-]\d{2,4}"))


def roles(questions: DataFrame) -> DataFrame:
    """Adds role (context for a part-less, mark-less question with a later child), parent, occurrence, inherited
    context, flags and review status."""
    main = F.split_part("number", F.lit("."), F.lit(1))
    part = F.col("number").contains(".")
    base = questions.withColumn("main", main).withColumn("is_child", part)
    after = Window.partitionBy("pair_key", "main").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    child = F.coalesce(F.max(F.col("is_child").cast("int")).over(after), F.lit(0)) == 1
    before = Window.partitionBy("pair_key", "main").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("pair_key", "number").orderBy("seq")
    marked = base.withColumn("role", F.when(~F.col("is_child") & F.col("marks").isNull() & child, "context").otherwise("scored"))
    context = F.last(F.when(F.col("role") == "context", F.col("text")), ignorenulls=True).over(before)
    code = F.col("text").rlike(r"(?i)\b(?:if|while|for|return|print)\b.*[(=:]")
    status = F.when(F.col("role") == "context", "context").when(F.col("marks").isNull(), "needs_review").otherwise("auto_approved")
    return marked.select("*", F.when(F.col("is_child"), F.col("main")).alias("parent"), F.row_number().over(same).alias("occurrence"), context.alias("context"), code.alias("has_code"), F.col("text").rlike(r"(?i)\b(?:figure|diagram|table)\b").alias("has_visual"), status.alias("review_status"))


def scope(flags: DataFrame) -> DataFrame:
    """(question_id, says_old, says_new) page flags -> both, old, new or none."""
    agg = flags.groupBy("question_id").agg(F.bool_or("says_old").alias("o"), F.bool_or("says_new").alias("n"))
    return agg.select("question_id", F.when(F.col("o") & F.col("n"), "both").when(F.col("o"), "old").when(F.col("n"), "new").otherwise("none").alias("scope"))


def scheme_starts(of: DataFrame, margin: float = 80) -> DataFrame:
    """Rows that start a mark-scheme entry: a far-left number of one or two digits and "mark" on the row."""
    number = F.regexp_extract("text", r"^(\d{1,2})(?:\s|$)", 1)
    return of.where((F.col("x0") < margin) & (number != "") & F.col("text").rlike(r"(?i)\bmarks?\b")).withColumn("number", question_number(number)).withColumn("part", F.regexp_extract("text", r"^\d{1,2}\s+\(?([a-z])\)?\s", 1))


def match_scores(pairs: DataFrame) -> DataFrame:
    """Score and method of (question, entry) pairs: number, main number or sequence, and whether the marks agree."""
    main = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    method = F.when(F.col("q_number") == F.col("e_number"), "exact").when(main("q_number") == main("e_number"), "main").otherwise("sequence")
    base = F.when(method == "exact", 12).when(method == "main", 6).otherwise(1)
    marks = F.when(F.col("q_marks").isNull() | F.col("e_marks").isNull(), 0).when(F.col("q_marks") == F.col("e_marks"), 5).otherwise(-3)
    return pairs.select("*", (base + marks).alias("score"), method.alias("method"))


def align(questions: DataFrame, entries: DataFrame, gap_question: int = -5, gap_entry: int = -2) -> DataFrame:
    """Global alignment of a pair's questions and entries, both in order: pair_key, q_seq, e_seq, kind.

    A pair is one row with both lists.  A row of the table of best scores is computed at once: the best way along the row is a
    running maximum after the gaps are taken off.  Only every sqrt(n)-th row is held; on the way back the rows between two
    held ones are made again, so memory grows with m * sqrt(n) and the alignment is that of the whole table.
    """

    def codes(numbers: list, known: dict) -> np.ndarray:
        return np.array([known.setdefault(str(x), len(known)) for x in numbers], np.int64)

    def steps(qs: list[dict], es: list[dict]) -> Iterator[tuple]:
        number, main, n, m = {}, {}, len(qs), len(es)
        numbers = [codes([x["number"] for x in side], number) for side in (qs, es)]
        mains = [codes([str(x["number"]).split(".")[0] for x in side], main) for side in (qs, es)]
        marks = [np.array([np.nan if x["marks"] is None else x["marks"] for x in side], float) for side in (qs, es)]
        gaps = gap_entry * np.arange(m + 1)

        def scores(i: int) -> np.ndarray:
            """Question i against every entry."""
            by_number = np.where(numbers[1] == numbers[0][i], 12, np.where(mains[1] == mains[0][i], 6, 1))
            return by_number + np.where(np.isnan(marks[1]) | np.isnan(marks[0][i]), 0, np.where(marks[1] == marks[0][i], 5, -3))

        def following(i: int, best: np.ndarray) -> np.ndarray:
            row = best + gap_question
            row[1:] = np.maximum(row[1:], best[:-1] + scores(i))
            return np.maximum.accumulate(row - gaps) + gaps

        stride = max(1, isqrt(n))
        row, held = gaps, [gaps]
        for i in range(n):
            row = following(i, row)
            if (i + 1) % stride == 0:
                held.append(row)
        i, j, top, rows_ = n, m, n, []
        while i:
            if i == top:  # the block of rows above comes next
                top = (i - 1) // stride * stride
                rows_ = [held[top // stride]]
                for r in range(top, i):
                    rows_.append(following(r, rows_[-1]))
            here, above, score = rows_[i - top], rows_[i - top - 1], scores(i - 1)
            while not (j and here[j] == above[j - 1] + score[j - 1]) and here[j] != above[j] + gap_question:
                j -= 1
                yield None, es[j]["seq"], "skipped"
            i -= 1
            if j and here[j] == above[j - 1] + score[j - 1]:
                j -= 1
                yield qs[i]["seq"], es[j]["seq"], "match"
            else:
                yield qs[i]["seq"], None, "missing"
        for e in reversed(es[:j]):
            yield None, e["seq"], "skipped"

    schema = pa.schema([("pair_key", pa.string()), ("q_seq", pa.int64()), ("e_seq", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (key,), (qs,), (es,) = (c.to_pylist() for c in batch.slice(at, 1).columns)
                out = steps(qs or [], es or [])
                while some := list(islice(out, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((key, *step) for step in some)), schema)], schema=schema)

    listed = lambda rows, name: rows.groupBy(F.col("pair_key").cast("string").alias("pair_key")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), F.col("number").cast("string").alias("number"), "marks"))).alias(name))
    pairs = listed(questions, "q").join(listed(entries, "e"), "pair_key", "full_outer")
    return pairs.select("pair_key", "q", "e").mapInArrow(run, "pair_key string, q_seq long, e_seq long, kind string")


def entry_marks(entries: DataFrame) -> DataFrame:
    """marks and their source: total column, sum of objectives, phrase, or the question's own."""
    objectives = F.regexp_extract_all("text", F.lit(r"AO\d\s*=\s*(\d+)"), F.lit(1))
    total = F.aggregate(objectives, F.lit(0), lambda a, x: a + x.cast("int"))
    phrase = F.regexp_extract("text", r"(\d+) marks?\b", 1)
    ao, said = F.when(F.size(objectives) > 0, total), F.when(phrase != "", phrase.cast("int"))
    source = F.when(F.col("total").isNotNull(), "total").when(ao.isNotNull(), "objectives").when(said.isNotNull(), "phrase").when(F.col("question_marks").isNotNull(), "question")
    return entries.select("*", F.coalesce("total", ao, said, "question_marks").alias("marks"), source.alias("marks_source"))


def guidance(text: Column) -> Column:
    """Lines of a guidance text as points, accepted, rejected and extra; objective lines are dropped."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^AO\d"))
    pick = lambda p: F.filter(lines, lambda x: x.rlike(p))
    return F.struct(F.filter(lines, lambda x: ~x.rlike(r"^(?:A|R|NE)\.")).alias("points"), pick(r"^A\.").alias("accepted"), pick(r"^R\.").alias("rejected"), pick(r"^NE\.").alias("extra"))


def entries(lines: DataFrame) -> DataFrame:
    """Mark-scheme entries: lines from a marker to the next, with text hash."""
    out = segment(markers(lines))
    return out.select("pair_key", F.col("seq"), "number", "marks", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("n_chars"), F.array_compact(F.array(F.when(F.col("marks").isNull(), F.lit("no_marks")), F.when(F.length("text") < 10, F.lit("short")))).alias("warnings"))


CONFIDENCE = {"exact": (1.0, 0.85), "main": (0.85, 0.65), "sequence": (0.65, 0.45)}


def links(questions: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one link per pair and number with confidence, status; issues of what is unlinked on either side or mismatched)."""
    q = questions.select("pair_key", "number", F.col("marks").alias("q_marks"), F.col("seq").alias("q_seq")).dropDuplicates(["pair_key", "number"])
    e = found.select("pair_key", "number", F.col("marks").alias("e_marks"), F.col("seq").alias("e_seq")).dropDuplicates(["pair_key", "number"])
    both = q.join(e, ["pair_key", "number"])
    equal = F.coalesce(F.col("q_marks") == F.col("e_marks"), F.lit(False))
    confidence = F.when(equal, 1.0).otherwise(F.when(F.col("q_marks").isNull() | F.col("e_marks").isNull(), 0.85).otherwise(0.60))
    linked = both.select("pair_key", "number", "q_seq", "e_seq", confidence.alias("confidence"), F.when(confidence >= 0.85, "auto").otherwise("needs_review").alias("status"))
    issues = q.join(e, ["pair_key", "number"], "left_anti").select("pair_key", "number", F.lit("question_without_entry").alias("issue"))
    issues = issues.unionByName(e.join(q, ["pair_key", "number"], "left_anti").select("pair_key", "number", F.lit("entry_without_question").alias("issue")))
    return linked, issues.unionByName(both.where(F.col("q_marks") != F.col("e_marks")).select("pair_key", "number", F.lit("marks_differ").alias("issue")))


def pair_summary(questions: DataFrame, linked: DataFrame, issues: DataFrame) -> DataFrame:
    q = questions.groupBy("pair_key").agg(F.count("*").alias("n_questions"), F.count_if(F.col("marks").isNull()).alias("n_unmarked"))
    k = linked.groupBy("pair_key").agg(F.count("*").alias("n_links"), F.count_if(F.col("status") == "auto").alias("n_auto"))
    i = issues.groupBy("pair_key").agg(F.count("*").alias("n_issues"))
    out = q.join(k, "pair_key", "left").join(i, "pair_key", "left").fillna(0)
    return out.withColumn("strict_passed", (F.col("n_issues") == 0) & (F.col("n_links") == F.col("n_auto"))).withColumn("needs_review", F.col("n_issues") > 0)


def replace_pairs(old: DataFrame, new: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The next table: a pair's rows are replaced by new ones unless a human has reviewed the pair."""
    safe = new.join(reviewed.select("pair_key").distinct(), "pair_key", "left_anti")
    return old.join(safe.select("pair_key").distinct(), "pair_key", "left_anti").unionByName(safe)


def quality_checks(questions: DataFrame) -> DataFrame:
    """One row per question and failed check, with its severity: number, marks, completeness, noise, link, duplicate,
    short, code, visual, equal marks, exact link, scope, guidance."""
    same = F.count("*").over(Window.partitionBy(F.lower(F.trim("text"))))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    rows_ = questions.withColumn("_same", same).withColumn("_w", words)
    checks = [
        ("number", "critical", ~F.coalesce(F.col("number").rlike(r"^\d+(?:\.\d+)?$"), F.lit(False))), ("marks", "critical", ~F.coalesce(F.col("marks").between(1, 25), F.lit(False))), ("complete", "critical", ~F.col("text").rlike(r"[.?!)\]]\s*$")),
        ("noise", "warning", F.col("text").rlike(r"[#%$&*]{3,}")), ("link", "critical", F.col("link").isNull()), ("duplicate", "warning", F.col("_same") > 1), ("short", "warning", F.col("_w") < 8),
        ("code", "warning", F.col("text").contains("```")), ("visual", "warning", F.col("text").rlike(r"(?i)\bfigure\b")), ("marks_equal", "warning", F.coalesce(F.col("marks") != F.col("e_marks"), F.lit(False))),
        ("exact_link", "warning", F.coalesce(F.col("link") != "exact", F.lit(False))), ("scope", "warning", F.coalesce(F.col("scope") == "old", F.lit(False))), ("guidance", "warning", F.coalesce(F.col("n_points") == 0, F.lit(False))),
    ]
    failed = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("check_name"), F.lit(s).alias("severity"))) for n, s, bad in checks]))
    return rows_.withColumn("_f", failed).select("question_id", F.explode("_f").alias("x")).select("question_id", "x.*")


def queue(checks: DataFrame, legacy: DataFrame, issues: DataFrame) -> DataFrame:
    """Review queue: questions by the weight of their failed checks, and issues of their own."""
    agg = checks.groupBy("question_id").agg(F.count_if(F.col("severity") == "critical").alias("c"), F.count_if(F.col("severity") == "warning").alias("w")).join(legacy, "question_id", "left")
    priority = 100 * F.col("c") + 10 * F.col("w") + F.when(F.coalesce("legacy", F.lit(False)), 25).otherwise(0)
    own = agg.select(F.concat(F.lit("q"), "question_id").alias("uid"), priority.cast("long").alias("priority"), F.when(F.col("c") > 0, "blocked").otherwise("open").alias("status"))
    weight = F.when(F.col("severity") == "critical", 150).when(F.col("severity") == "warning", 60).otherwise(10)
    return own.unionByName(issues.select(F.concat(F.lit("i"), "issue_id").alias("uid"), weight.cast("long").alias("priority"), F.lit("open").alias("status")))


def report(table: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts for several groupings of one table in a single pass (grouping sets); null where a column is not in the
    set, with the set's number."""
    columns = sorted({c for s in sets for c in s})
    out = table.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"))
    return out.select(*columns, F.col("grouping").cast("long").alias("grouping"), "n")


def classify_documents(docs: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """kind by the first matching pattern over title and text; year, series and paper code where the text has them."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        kind = F.when(F.lower(F.concat_ws(" ", "title", "text")).rlike(pattern), name).otherwise(kind)
    filled = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return docs.select("doc_id", kind.alias("kind"), filled(r"\b((?:19|20)\d{2})\b").alias("year"), filled(r"([A-Z]{4}\d{4})").alias("code"))


def match_documents(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Action for each incoming document by address or hash: an OR join as two equi joins, the address first."""
    by_url = batch.join(stored.select("url", F.col("stored_id").alias("a"), F.col("hash").alias("ah")), "url").select("id", "a", (F.col("ah") == F.col("hash")).alias("same"), F.lit(1).alias("p"))
    by_hash = batch.join(stored.select("hash", F.col("stored_id").alias("a")), "hash").select("id", "a", F.lit(True).alias("same"), F.lit(2).alias("p"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("p", "a"))
    best = by_url.union(by_hash).withColumn("_r", first).where("_r = 1")
    return batch.join(best.select("id", "a", "same"), "id", "left").select("id", F.col("a").alias("stored_id"), F.when(F.col("a").isNull(), "inserted").when(F.col("same"), "skipped_unchanged").otherwise("updated").alias("action"))


def document_key(*parts: str, default: str = "THEORY") -> Column:
    return F.upper(F.concat_ws("-", *[F.coalesce(F.nullif(F.trim(F.col(p).cast("string")), F.lit("")), F.lit(default)) for p in parts]))


def pair_coverage(documents: DataFrame) -> DataFrame:
    """Per pair key (a null language is a group of its own): counts of both kinds, complete or not."""
    agg = documents.groupBy("topic", "language").agg(F.min("doc_id").alias("first_id"), F.count_if(F.col("kind") == "qp").alias("n_qp"), F.count_if(F.col("kind") == "ms").alias("n_ms"))
    return agg.withColumn("complete", (F.col("n_qp") == 1) & (F.col("n_ms") == 1))


def coverage(required: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required combinations with the number present and a missing flag."""
    have = present.groupBy(*keys).agg(F.count("*").alias("_n"))
    return required.join(have, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("n"), F.col("_n").isNull().alias("missing"))


def repair(rows_: DataFrame, rules: Mapping[str, Column], column: str) -> DataFrame:
    """column set to the name of the first rule that holds; repaired marks changed rows."""
    value = F.col(column)
    for name, when in reversed(list(rules.items())):
        value = F.when(when, name).otherwise(value)
    return rows_.withColumn("_v", value).withColumn("repaired", ~F.col("_v").eqNullSafe(F.col(column))).withColumn(column, F.col("_v")).drop("_v")


def align_topics(source: DataFrame, canonical: DataFrame) -> DataFrame:
    """Source topics against canonical ones by normalised name: matched, source_only, canonical_only or ambiguous."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    s = source.withColumn("key", norm(F.col("name"))).groupBy("key").agg(F.min("source_id").alias("source_id"), F.count("*").alias("_s"))
    c = canonical.withColumn("key", norm(F.col("name"))).groupBy("key").agg(F.min("code").alias("code"), F.count("*").alias("_c"))
    status = F.when(F.col("_s").isNull(), "canonical_only").when(F.col("_c").isNull(), "source_only").when((F.col("_s") > 1) | (F.col("_c") > 1), "ambiguous").otherwise("matched")
    return s.join(c, "key", "full_outer").select("key", "source_id", "code", status.alias("status"))


def pilot_sample(of: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows dealt round-robin over the groups, deterministic."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return of.withColumn("_p", place).orderBy("_p", group).limit(n).drop("_p")
