"""Operator 8: quality rules, line first.

Each line is judged alone: it fails when it does not end in closing punctuation, looks like navigation, or holds a
boilerplate phrase (``Rules``).  Failing lines are removed; a document that loses more than ``max_lost`` of its words is
rejected.
Whole-text statistics (symbols, repeated lines, repeated three-word windows) decide ``base_failed``.

Defined results: null text counts as empty (0 words, base_failed); lines without a word are dropped and count for
nothing; repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm.common import map_rows, small, texts

SYMBOL = re.compile(r"[#*$%&|<>]")
BREAKS = re.compile(r"[\x20\x09-\x0D]")
BLANK = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """What a line must hold to, and how much of a text may be lost.  The phrases are our own, in lower case, as the four
    languages of the corpus write them; a corpus in other languages brings its own."""

    closing: tuple[str, ...] = tuple(".!?:;\"')]»”…")
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "copyright", "licensed under", "cookie", "privacy policy", "terms of use", "terms of service", "javascript", "click here", "subscribe", "sign up", "lorem ipsum", "powered by",
        "todos los derechos reservados", "política de privacidad", "suscríbete", "tous droits réservés", "politique de confidentialité", "alle rechte vorbehalten", "datenschutzerklärung",
    )
    navigation: tuple[str, ...] = ("home", "menu", "login", "log in", "next", "previous", "back", "search", "contact", "about", "share", "skip to content", "read more", "top", "sitemap", "inicio", "buscar", "contacto", "accueil", "suivant", "startseite", "suche", "kontakt")
    max_bars: int = 2
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50

    def line_fails(self, line: str) -> str | None:
        """The first rule a line breaks: punctuation, navigation, boilerplate; None for a good line."""
        bare = line.strip(BLANK + "\n")
        if not bare.endswith(self.closing):
            return "punctuation"
        low = bare.lower()
        if bare.count("|") > self.max_bars or _navigation(self.navigation).fullmatch(low):
            return "navigation"
        return "boilerplate" if _any_of(self.boilerplate).search(low) else None

    def clean(self, text: str) -> tuple[str, Counter]:
        """Text of the lines that pass; the other lines and their words, by rule and by (rule, "words")."""
        kept, lost = [], Counter()
        for line in text.split("\n"):
            n = len(line.encode().split())
            if n and (rule := self.line_fails(line)):
                lost[rule] += 1
                lost[rule, "words"] += n
            elif n:
                kept.append(line)
        return "\n".join(kept), lost


@cache
def _any_of(phrases: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, phrases)) or r"(?!)")


@cache
def _navigation(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"[ \t\x0b-\r]*(?:(?:%s)[ \t\x0b-\r|>/.:]*)+" % ("|".join(map(re.escape, words)) or "(?!)"))


RULES = Rules()


def repeated_words(words: list[bytes]) -> int:
    """Words covered by three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


LINE_RULES = ("punctuation", "navigation", "boilerplate")


def judge(raw: bytes, rules: Rules = RULES) -> tuple:
    text, words = raw.decode(), raw.split()
    n, lines = len(words), [x for x in text.split("\n") if x.strip(BLANK)]
    repeats = repeated_words(words)
    failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    lost = rules.clean(text)[1]
    n_lost = sum(lost[rule, "words"] for rule in LINE_RULES)
    return n, len(text) - len(BREAKS.findall(text)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeats, failed, not failed and n_lost <= rules.max_lost * n, *(lost[rule] for rule in LINE_RULES), n_lost


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), *((f"n_{r}", pa.int64()) for r in LINE_RULES), ("n_lost_words", pa.int64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_punctuation long, n_navigation long, n_boilerplate long, n_lost_words long"


def judge_quality(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """One row of line and text statistics and a verdict per document; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = list(zip(*(judge(raw, rules) for raw in texts(batch)), strict=True)) or [[]] * (len(RESULT) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(found, list(RESULT)[1:]))], schema=RESULT)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DDL)


def cleaned(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The documents that are kept, all columns, with failing lines taken out of their text."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = batch.filter(pa.array([judge(raw, rules)[6] for raw in texts(batch, at)], pa.bool_()))
            lines = pa.array([rules.clean(raw.decode())[0] for raw in texts(rows, at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([lines if i == at else c for i, c in enumerate(rows.columns)], schema=batch.schema)

    return map_rows(docs, run)


def oracle(rules: Rules = RULES) -> str:
    """DuckDB SQL for judge_quality over a table ``documents``."""
    quote = lambda words: "|".join(re.sub(r"([.\\^$|?*+()\[\]{}])", r"\\\1", w) for w in words).replace("'", "''")
    closing = ", ".join("'" + c.replace("'", "''") + "'" for c in rules.closing)
    return SQL.format(nav=quote(rules.navigation), boiler=quote(rules.boilerplate), closing=closing, bars=rules.max_bars, lost=rules.max_lost, least=rules.min_words, percent=rules.max_repeat_percent)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
pos AS (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM win, range(3) t(k) WHERE n > 1 GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
bare AS (SELECT r, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS bare, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM line),
bad AS (SELECT r, line, n, CASE WHEN right(bare, 1) NOT IN ({closing}) THEN 'punctuation'
  WHEN len(regexp_extract_all(bare, '\\|')) > {bars} OR regexp_full_match(lower(bare), '[ \\t\\x0b-\\r]*(?:(?:{nav})[ \\t\\x0b-\\r|>/.:]*)+') THEN 'navigation'
  WHEN regexp_matches(lower(bare), '{boiler}') THEN 'boilerplate' END AS bad FROM bare WHERE n > 0),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad = 'punctuation') AS n_punctuation, count(*) FILTER (bad = 'navigation') AS n_navigation,
  count(*) FILTER (bad = 'boilerplate') AS n_boilerplate, coalesce(sum(n) FILTER (bad IS NOT NULL), 0) AS n_lost_words FROM bad GROUP BY r),
j AS (SELECT doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_punctuation, 0) AS n_punctuation, coalesce(n_navigation, 0) AS n_navigation,
  coalesce(n_boilerplate, 0) AS n_boilerplate, coalesce(n_lost_words, 0) AS n_lost_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {least} OR 100 * n_repeat_words > {percent} * n_words AS base_failed,
  NOT (n_words < {least} OR 100 * n_repeat_words > {percent} * n_words) AND n_lost_words <= {lost} * n_words AS kept,
  n_punctuation::BIGINT AS n_punctuation, n_navigation::BIGINT AS n_navigation, n_boilerplate::BIGINT AS n_boilerplate, n_lost_words::BIGINT AS n_lost_words FROM j
"""
ORACLE = oracle()
