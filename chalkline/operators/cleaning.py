"""Transcript cleaning: row-local column functions, and line operators over (doc_id, line_no, line)."""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import reduce
from operator import eq, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from chalkline.operators.chunking import named

# Role labels, noise markers and metadata lines that the cleaning rules name.
ROLES = ("teacher", "instructor", "lecturer", "tutor", "student", "learner", "pupil", "interviewer", "interviewee", "facilitator", "presenter", "moderator", "host", "guest", "participant", "person", "speaker", r"unknown\s+speaker", r"male\s+speaker", r"female\s+speaker")
NOISES = ("inaudible", "unintelligible", "noise", r"background\s+noise", r"keyboard\s+noise", "typing", r"chair\s+noise", r"notification\s+(?:sound|noise)", "notification", r"audio\s+glitch", r"microphone\s+noise", r"mic\s+noise", "music", "silence", "laughter", "laughing", "crosstalk", "cough", "coughing", r"screen\s+sharing\s+(?:started|stopped)", r"connection\s+(?:lost|restored)", r"internet\s+(?:lost|disconnected|reconnected)")
PAGE = r"(?i)(?:page\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+)"
FIELD = r"(?i)(?:title|document(?:\s+title)?|file(?:\s*name)?|source(?:\s+file)?|recording(?:\s+title)?|session(?:\s+title)?|lesson\s+title)\s*[:\-]\s*.+"
HEADING = r"(?i)(?:(?:lesson|class|meeting|raw|cleaned)\s+)?transcript(?:\s+(?:test|sample|recording|number|no\.?|#)?\s*\d*)?(?:\s*[-:–—].*)?"
SYNTHETIC = r"(?i).*\b(?:synthetic\s+(?:raw\s+)?(?:lesson\s+)?transcript|test\s+transcript|sample\s+transcript)\b.*\b(?:test(?:ing)?|module\s*\d+|edtech|benchmark|regression)\b.*"
RULE = r"[-=_*]{3,}"

CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"


def role_pattern(roles: Sequence[str] = ROLES) -> str:
    return r"(?:" + "|".join(roles) + r")(?:\s*(?:\d+|[A-Z]))?"


def speaker_timestamp(line: Column, roles: Sequence[str] = ROLES) -> Column:
    """Without a leading "Role - hh:mm[:ss]:"; a change counts as a speaker and a timestamp."""
    return F.regexp_replace(line, rf"(?i)^\s*{role_pattern(roles)}\s*[-–—]\s*[\[\(]?{CLOCK}[\]\)]?\s*:\s*", "")


def timestamp(line: Column) -> Column:
    """Without a leading range of times, else without a leading time."""
    ranged = F.regexp_replace(line, rf"^\s*{CLOCK}\s*-->\s*{CLOCK}\s*", "")
    return F.when(ranged != line, ranged).otherwise(F.regexp_replace(line, rf"^\s*[\[\(]?{CLOCK}[\]\)]?\s*", ""))


def speaker(line: Column, roles: Sequence[str] = ROLES) -> Column:
    """Without a leading label of a known role; other labels stay."""
    return F.regexp_replace(line, rf"(?i)^\s*{role_pattern(roles)}\s*:\s*", "")


NOISE = r"(?i)[\[\(]\s*(?:" + "|".join(NOISES) + r")\s*[\]\)]"
UNCERTAIN = r"(?i)\[unclear\]|\[unknown\]|\?\?\?|<unk>"
FILLER = r"(?i)(?<![\w-])(?:um+|uh+|erm+|hmm+)(?![\w-])(?:[ \t]*,[ \t]*)?"


def removed(text: Column, pattern: str) -> tuple[Column, Column]:
    """Text without the pattern, and how often it stood there."""
    return F.regexp_replace(text, pattern, ""), F.regexp_count(text, F.lit(pattern))


_PLAIN = re.compile(r"\b[A-Za-z]+\b")
_JOINED = re.compile(r"((?<!\w)[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*+(?!\w))")


def _once(text: str) -> tuple[str, int]:
    """Runs of three or more equal words with only blanks between, cut to their first word."""
    kept, read, removed = [], 0, 0
    first = last = word = None
    length = 0

    def close() -> None:
        nonlocal read, removed
        if length >= 3:
            kept.append(text[read:first])
            read, removed = last, removed + length - 1

    for m in _PLAIN.finditer(text):
        if m.group().lower() == word and text[last : m.start()].isspace():
            length += 1
        else:
            close()
            first, word, length = m.end(), m.group().lower(), 1
        last = m.end()
    close()
    return ("".join([*kept, text[read:]]), removed) if removed else (text, 0)


def _said_once(text: str, longest: int, passes: int) -> tuple[str, int]:
    """Phrases of up to ``longest`` words that are said again at once, cut to their first saying, longest phrases first.

    Separators are kinds here: a phrase has blanks inside, between two sayings stand blanks or one comma.  For every phrase
    length only places are looked at where so many words in a row equal those as many places on.
    """
    parts = _JOINED.split(text)
    said, gap = parts[1::2], parts[2:-1:2]
    word = [w.lower() for w in said]
    kind = [1 if g == " " or (bare := g.strip(" \t")) == "" else 2 if bare == "," else 0 for g in gap]
    place, before = list(range(len(word))), len(word)
    for _ in range(passes):
        start = len(word)
        for n in range(longest, 0, -1):
            same, wanted = bytes(map(eq, word, word[n:])), b"\1" * n
            at = same.find(wanted)
            if at < 0:
                continue
            keep, i, m = [], 0, len(word)
            ends: dict[int, int] = {}  # a kept phrase's last word -> the removed word whose separator follows it now
            while at >= 0:
                keep += range(i, at)
                i = again = at
                again += n
                if all(k == 1 for k in kind[i : again - 1]):
                    while again + n <= m and kind[again - 1] and word[i : i + n] == word[again : again + n] and gap[i : i + n - 1] == gap[again : again + n - 1]:
                        again += n
                if again > i + n:
                    keep += range(i, i + n)
                    ends[i + n - 1] = again - 1
                    i = again
                else:
                    keep.append(i)
                    i += 1
                at = same.find(wanted, i)
            if not ends:
                continue
            keep += range(i, m)
            after = [ends.get(k, k) for k in keep[:-1]]
            word, place = [word[k] for k in keep], [place[k] for k in keep]
            gap, kind = [gap[k] for k in after], [kind[k] for k in after]
        if len(word) == start:
            break
    if len(word) == before:
        return text, 0
    # behind the last kept word goes on what followed the last word of all
    body = [x for k, p in enumerate(place) for x in (said[p], gap[k] if k < len(gap) else "")]
    return parts[0] + "".join(body) + parts[-1], before - len(word)


_INNER = re.compile("(?<=[A-Za-z0-9])['’-](?=[A-Za-z0-9])")
_PLAINER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _maybe_repeated(lines: Sequence[str | None], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines may say a word three times, and which a word or a phrase of up to ``longest`` words twice at once: the
    others certainly do not.

    Words are runs of letters and digits here, whatever stands between them, and are compared as hashes for all lines
    together.  Signs inside words make two readings of a line, split there and joined; where it is not plain whether they
    stand inside, the line counts as one that may.
    """
    thrice, maybe, codes, owner = np.zeros(len(lines), bool), np.zeros(len(lines), bool), array("q"), array("q")
    for i, line in enumerate(lines):
        if line is None:
            continue
        readings = [line]
        if "'" in line or "-" in line or "’" in line:
            if "_" in line or not line.replace("’", "").isascii():
                thrice[i] = maybe[i] = True
                continue
            readings.append(_INNER.sub("", line))
        for reading in readings:
            words = reading.encode("utf-8", "replace").translate(_PLAINER).split()
            codes.extend(map(hash, words))
            codes.append(len(owner))  # no word follows another across readings: see ``apart``
            owner.extend([i] * len(words))
            owner.append(-1 - i)
    code, of = np.frombuffer(codes, np.int64), np.frombuffer(owner, np.int64)
    apart = of < 0
    for n in range(1, max(longest, 1) + 1):
        if len(code) < 2 * n:
            break
        same = (code[n:] == code[:-n]) & ~apart[n:] & ~apart[:-n]
        run = np.concatenate([[0], np.cumsum(same)])
        maybe[of[np.flatnonzero(run[n:] - run[:-n] == n)]] = True  # n words in a row equal those n places on
        if n == 1:
            thrice[of[np.flatnonzero(same[1:] & same[:-1])]] = True
    return thrice, maybe


@F.pandas_udf(StructType().add("once", StringType()).add("n_words", IntegerType()).add("text", StringType()).add("n_phrases", IntegerType()))
def _without_repeats(lines: pd.Series, longest: pd.Series, passes: pd.Series) -> pd.DataFrame:
    def both(line: str | None, thrice: bool, maybe: bool, n: int, most: int) -> tuple:
        if line is None:
            return None, None, None, None
        if not maybe:
            return line, 0, line, 0
        once, words_removed = _once(line) if thrice else (line, 0)
        text, phrases_removed = _said_once(once, n, most)
        return once, words_removed, text, phrases_removed

    looked = _maybe_repeated(list(lines), int(longest.max())) if len(lines) else ([], [])
    return pd.DataFrame([both(*x) for x in zip(lines, *looked, longest, passes)], columns=["once", "n_words", "text", "n_phrases"]).astype({"n_words": "Int32", "n_phrases": "Int32"})


def repeated(text: Column, longest: int = 5, passes: int = 5) -> Column:
    """once, n_words: three or more equal neighbours become one; text, n_phrases: then a phrase of up to ``longest`` words said
    again at once becomes one.  The counts are of words removed; time follows the line's length."""
    return _without_repeats(text, F.lit(longest), F.lit(passes))


@F.pandas_udf(StructType().add("text", StringType()).add("n", IntegerType()))
def _phrases_once(lines: pd.Series, longest: pd.Series, passes: pd.Series) -> pd.DataFrame:
    maybe = _maybe_repeated(list(lines), int(longest.max()))[1] if len(lines) else []
    found = [(None, None) if t is None else _said_once(t, n, most) if m else (t, 0) for t, m, n, most in zip(lines, maybe, longest, passes)]
    return pd.DataFrame(found, columns=["text", "n"]).astype({"n": "Int32"})


def repeated_word(text: Column) -> tuple[Column, Column]:
    """Three or more equal neighbours become one; the words removed are counted."""
    found = repeated(text, 0, 0)
    return found["once"], found["n_words"]


def repeated_phrase(text: Column, longest: int = 5, passes: int = 5) -> tuple[Column, Column]:
    """A phrase of up to ``longest`` words said again at once becomes one, longest phrases first; words removed are counted."""
    found = _phrases_once(text, F.lit(longest), F.lit(passes))
    return found["text"], found["n"]


def whitespace(text: Column) -> Column:
    """One kind of line end, no runs of blanks or blank lines, no blank before punctuation."""
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), " ", " ")
    out = F.regexp_replace(F.regexp_replace(out, r" [ \t]+|\t[ \t]*", " "), r" *\n *", "\n")  # most blanks stand alone and stay
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r" +([,.!?;:])", "$1"))


UNTIDY = "[\r\n\t\u00a0]|  | [,.!?;:]|^ | $"  # a text that ``whitespace`` changes has one of these


def tidy(text: Column) -> Column:
    """whitespace, for lines of which most are as it leaves them."""
    return F.when(text.rlike(UNTIDY), whitespace(text)).otherwise(text)


def warnings(text: Column) -> Column:
    """Signs of a bad transcription: very long letter runs, replacement characters."""
    return F.array_compact(F.array(F.when(text.rlike(r"[A-Za-z]{30,}"), F.lit("long_token")), F.when(text.contains("�"), F.lit("replacement_character"))))


PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"  # one by one: a class of ranges is tested range by range, which is slow


def metadata_key(text: Column) -> Column:
    """Heading or file name for comparison: no document suffix, lower case, letters and digits only."""
    bare = F.regexp_replace(F.trim(text), r"(?i)\.(?:docx?|pdf|txt|rtf)$", "")
    return F.trim(F.regexp_replace(F.lower(bare), f"[^{PLAIN}]+", " "))


def names_source(line: Column, source: Column, key: Column | None = None) -> Column:
    """Whether a short line (of that key, if known) says the source's name: equal keys, or enough shared words on both sides."""
    a, b = metadata_key(line) if key is None else key, metadata_key(source)
    of_line, of_source = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared = F.size(F.array_intersect(of_line, of_source))
    close = (shared >= 3) & (shared / F.size(of_line) >= 0.85) & (shared / F.size(of_source) >= 0.75)
    return F.coalesce((a != "") & (b != "") & (F.length(a) <= 180) & ((a == b) | close), F.lit(False))


def mark_metadata(lines: DataFrame, source: Column | None = None, leading: int = 12) -> DataFrame:
    """lines with ``is_metadata``: strong metadata near the start, page markers and the source's name anywhere, and
    strong headers that repeat."""
    source = F.lit(None).cast("string") if source is None else source
    bare = F.trim("line")
    whole = lambda p: bare.rlike("^(?:" + p + ")$")
    lines = lines.withColumn("_key", metadata_key(bare))
    by_source = names_source(bare, source, F.col("_key"))
    page = whole(PAGE)
    transcript = F.lower(bare).contains("transcript") & (whole(HEADING) | whole(SYNTHETIC))  # both patterns have the word
    strong = (bare != "") & (by_source | page | whole(FIELD) | transcript | whole(RULE))
    marked = lines.select("*", strong.alias("_strong"), (page | by_source).alias("_sure"))
    ordered = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen, same = F.count(F.when(bare != "", 1)).over(ordered), F.count("*").over(Window.partitionBy("doc_id", "_key"))
    gone = ((seen <= leading) & F.col("_strong")) | F.col("_sure") | ((F.col("_key") != "") & (same >= 2) & F.col("_strong"))
    return marked.withColumn("is_metadata", gone).drop("_strong", "_sure", "_key")


def normal_sentence(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"\s+", " "))


def drop_repeated_sentences(sentences: DataFrame) -> DataFrame:
    """Without sentences equal (case and blanks aside) to the one before in the document; blank lines do not matter.

    A dropped sentence equals the kept one before it, so the previous row decides.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no", "sent_no")
    return sentences.withColumn("_n", normal_sentence(F.col("sentence"))).withColumn("_p", F.lag("_n").over(order)).where("_p is null or _p <> _n").drop("_n", "_p")


def clean_lines(lines: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """The line rules in fixed order with a counter for each: adds ``cleaned`` and n_* columns."""
    step = lines.withColumn("c0", speaker_timestamp(F.col("line"), roles)).withColumn("c1", timestamp(F.col("c0"))).withColumn("c2", speaker(F.col("c1"), roles))
    step = step.withColumn("both", (F.col("c0") != F.col("line")).cast("int"))
    step = step.withColumn("n_timestamps", F.col("both") + (F.col("c1") != F.col("c0")).cast("int")).withColumn("n_speakers", F.col("both") + (F.col("c2") != F.col("c1")).cast("int"))
    text = F.col("c2")
    for name, pattern, signs in (("n_artefacts", NOISE, "[("), ("n_uncertain", UNCERTAIN, "[?<"), ("n_fillers", FILLER, ("um", "uh", "erm", "hmm"))):
        old, (text, n) = text, removed(text, pattern)
        some = reduce(or_, (F.lower(old).contains(x) for x in signs))  # most lines have none of what the pattern begins with
        text, n = F.when(some, text).otherwise(old), F.when(some, n).when(old.isNotNull(), 0)
        step = step.withColumn(name, n).withColumn("text_" + name, text)
        text = F.col("text_" + name)
    step = step.withColumn("repeats", repeated(text))
    step = step.withColumn("n_repeated_words", F.col("repeats.n_words")).withColumn("n_repeated_phrases", F.col("repeats.n_phrases")).withColumn("cleaned", tidy(F.col("repeats.text")))
    return step.drop("c0", "c1", "c2", "both", "text_n_artefacts", "text_n_uncertain", "text_n_fillers", "repeats")


COUNTERS = ("n_timestamps", "n_speakers", "n_artefacts", "n_uncertain", "n_fillers", "n_repeated_words", "n_repeated_phrases")


def clean_transcripts(docs: DataFrame, source: str | None = None, roles: Sequence[str] = ROLES) -> DataFrame:
    """The whole pipeline over (doc_id, text): one row per document with text, removed lines, counters and warnings.

    One scan and one shuffle of the lines by document; a document's lines are then gathered and its sentences compared.
    Documents without any text are reported with ``rejected``; sentence repeats are dropped across lines.
    """
    lines = docs.select("doc_id", *([source] if source else []), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    cleaned = clean_lines(mark_metadata(lines.repartition("doc_id"), F.col(source) if source else None), roles)
    gone = F.col("is_metadata")
    by_doc = cleaned.groupBy("doc_id").agg(
        *[F.sum(F.when(~gone, F.col(c)).otherwise(0)).alias(c) for c in COUNTERS], F.count_if(gone).alias("n_metadata"),
        F.sort_array(F.collect_list(F.when(gone & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("l"))))).alias("removed"),
        F.sort_array(F.collect_list(F.when(~gone, F.struct("line_no", "cleaned")))).alias("lines"),
    )
    sentence = lambda line: F.transform(F.split(line["cleaned"], r"(?<=[.!?])\s+"), lambda s: F.struct(line["line_no"].alias("line_no"), s.alias("s"), normal_sentence(s).alias("norm")))
    every = F.filter(F.flatten(F.transform("lines", sentence)), lambda x: x["s"] != "")
    fresh = lambda a: F.struct(F.size(a).alias("n"), F.filter(a, lambda x, i: (i == 0) | (x["norm"] != F.get(a, i - 1)["norm"])).alias("kept"))
    told = by_doc.withColumn("sentences", named(every, fresh))
    before = lambda x, i: F.when(i == 0, "").when(F.get("sentences.kept", i - 1)["line_no"] == x["line_no"], " ").otherwise("\n")
    joined = F.array_join(F.transform("sentences.kept", lambda x, i: F.concat(before(x, i), x["s"])), "")
    out = told.withColumn("text", joined)
    dropped = (F.col("sentences.n") - F.size("sentences.kept")).alias("n_repeated_sentences")
    return out.select("doc_id", "text", *COUNTERS, "n_metadata", F.transform("removed", lambda x: x["l"]).alias("removed_lines"), dropped, warnings(F.col("text")).alias("warnings"), (F.size("sentences.kept") == 0).alias("rejected"))


def guard_rewrites(rewrites: DataFrame, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """(doc_id, original, rewrite) with ok and problems: a rewrite must be non-empty, of similar length, and keep every
    array reference and the number of each operator."""
    refs = lambda c: F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*\[[^\]]*\]"), F.lit(0)))
    ratio = F.length(F.coalesce("rewrite", F.lit(""))) / F.greatest(F.length("original"), F.lit(1))
    counts = [F.regexp_count(F.coalesce("rewrite", F.lit("")), F.lit(p)) != F.regexp_count("original", F.lit(p)) for p in (r"\+", r"\*", "=", "<", ">")]
    changed = counts[0] | counts[1] | counts[2] | counts[3] | counts[4]
    problems = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("rewrite", F.lit(""))) == "", F.lit("empty")), F.when((ratio < low) | (ratio > high), F.lit("length")),
        F.when(refs(F.col("rewrite")) != refs(F.col("original")), F.lit("references")), F.when(changed, F.lit("operators")),
    ))
    return rewrites.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)
