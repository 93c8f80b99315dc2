"""Terminology correction: vocabulary keys, blocked fuzzy joins, a reviewed memory, validation and application."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence, Set
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from chalkline.operators.held import cut


def term_key(text: Column) -> Column:
    """Lookup key: lower case, separators as one blank, other signs dropped."""
    spaced = F.regexp_replace(F.lower(text), r"[\s_\-/.]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9+# ]", ""), " +", " "))


def inflected(a: Column, b: Column) -> Column:
    """Whether two words differ only by s, es or y/ies."""
    one = lambda x, y: (y == F.concat(x, F.lit("s"))) | (y == F.concat(x, F.lit("es"))) | (x.endswith("y") & (y == F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("ies"))))
    return one(a, b) | one(b, a)


def vocabulary(*sources: DataFrame) -> DataFrame:
    """(term, priority) sources folded to one row per key: the best-ranked, then shortest, then first form."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    keyed = rows.withColumn("key", term_key(F.col("term"))).where("key <> ''")
    best = F.row_number().over(Window.partitionBy("key").orderBy("priority", F.length("term"), "term"))
    return keyed.withColumn("_r", best).where("_r = 1").select("key", "term", "priority", F.size(F.split("key", " ")).alias("n_words"))


SPOKEN = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*) dot ([A-Za-z_][A-Za-z0-9_]*)\b"


def spoken_dots(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """Adds fixed ("x dot y" as "x.y") and hits, the spoken forms that were replaced."""
    fixed = F.when(F.lower(text).contains(" dot "), F.regexp_replace(text, SPOKEN, "$1.$2")).otherwise(F.col(text))
    return rows.select("*", fixed.alias("fixed"), F.regexp_extract_all(text, F.lit(SPOKEN), F.lit(0)).alias("hits"))


def anchors_in(words: Column, strong: Sequence[str], weak: Sequence[str]) -> tuple[Column, Column]:
    """(context anchors among the words, whether they are enough: one strong or two in all)."""
    found = F.array_sort(F.array_intersect(words, F.array(*map(F.lit, (*strong, *weak)))))
    return found, F.arrays_overlap(words, F.array(*map(F.lit, strong))) | (F.size(found) >= 2)


MEMBER = r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b"
SIGNS, CONTROLS = r"[=!<>]=|\[[^\]]*\]", r"(?i)\b(?:if|while)\b"


def technical(sentence: Column, strong: Sequence[str], weak: Sequence[str]) -> Column:
    """Whether a sentence has context enough to look for misspelt terms: anchors, member access or signs of code.  Most have
    none, which patterns without a walk over every word tell first."""
    member = sentence.rlike(r"[A-Za-z0-9_]\.[A-Za-z_]") & sentence.rlike(MEMBER)
    control = sentence.rlike("[iI][fF]|[wW][hH][iI][lL][eE]") & sentence.rlike(CONTROLS)
    return sentence.rlike(SIGNS) | member | control | anchors_in(F.split(term_key(sentence), " "), strong, weak)[1]


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two short strings; used only on blocked pairs."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])


def _without_one(word: Column) -> Column:
    """All forms of a word with one letter missing."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _deletions(word: Column, times: int) -> Column:
    """The word and all its forms with up to ``times`` letters missing; words within that many edits share one."""
    forms = F.array(word)
    for _ in range(times):
        forms = F.array_distinct(F.concat(forms, F.flatten(F.transform(forms, _without_one))))
    return forms


def _letters(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each word, and a bit for each of 32 classes of letters that it has, and has twice: an edit changes two."""
    n = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) & 31
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * 32 + letters, minlength=32 * len(n)).reshape(-1, 32)
    return n, np.packbits(np.hstack([counts > 0, counts > 1]), axis=1).view(np.uint64).ravel()


def _letters_near(terms: Sequence[str], long_word: int, short_edits: int) -> Callable[[Column], Column]:
    """Whether a word's length and letters let it be within its number of edits of a term: most words' do not, and their
    many deletion forms need not be made."""
    n_terms, bits_of = _letters(terms) if terms else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    @F.pandas_udf(BooleanType())
    def near(words: pd.Series) -> pd.Series:
        out = np.zeros(len(words), bool)
        for start in range(0, len(words), 10_000):
            n, bits = _letters(words.iloc[start : start + 10_000].tolist())
            for size in np.unique(n):  # words of one length meet the terms of about that length
                most = 2 if size >= long_word or short_edits > 1 else 1
                mine, theirs = np.flatnonzero(n == size), bits_of[np.abs(n_terms - size) <= most]
                for at in range(0, len(mine), 1000):
                    part = mine[at : at + 1000]
                    out[start + part] = (np.bitwise_count(bits[part, None] ^ theirs) <= 2 * most).any(axis=1)
        return pd.Series(out)

    return near


MOST_COMPARED = 2_000  # vocabularies of at most so many words are compared by letters first


def close_words(left: DataFrame, right: DataFrame, long_word: int = 8, short_edits: int = 1) -> DataFrame:
    """(word) x (term) within 2 edits, or ``short_edits`` for words of under ``long_word`` letters: joined on deletion forms.

    left is distinct words of a corpus, right a vocabulary: its forms are sent to all tasks, so no form is shuffled.
    """
    n_terms, longest = right.agg(F.count("*"), F.max(F.length("term"))).first()
    left = left.where(F.length("word") <= (longest or 0) + 2)  # a longer one is close to no term, and has many forms
    if n_terms <= MOST_COMPARED:
        left = left.where(_letters_near([r.term for r in right.select("term").distinct().collect()], long_word, short_edits)(F.col("word")))
    long_ = (F.length("word") >= long_word) | F.lit(short_edits > 1)
    a = left.select("word", F.explode(F.when(long_, _deletions(F.col("word"), 2)).otherwise(_deletions(F.col("word"), 1))).alias("form"))
    b = right.select("term", F.explode(F.when((F.length("term") >= long_word - 2) | F.lit(short_edits > 1), _deletions(F.col("term"), 2)).otherwise(_deletions(F.col("term"), 1))).alias("form"))
    forms = F.broadcast(b) if n_terms <= MOST_TERMS else b
    pairs = a.join(forms, "form").select("word", "term").distinct()
    most = F.when(long_, 2).otherwise(1)
    return pairs.withColumn("edits", F.levenshtein("word", "term", 2)).where((F.col("edits") >= 1) & (F.col("edits") <= most))


MOST_TERMS = 50_000  # vocabularies of at most so many words are sent to all tasks
MOST_CASES = 200_000  # so many rows of a word and a term that it may be meant for, of a few hundred bytes each
TOKEN = "[A-Za-z][A-Za-z0-9_'’-]*"
WORDS_BETWEEN_BLANKS = rf"{TOKEN}(?:[ \t]++{TOKEN})*+"  # possessive: a run of any length without recursion
COMPARED = r"^(?:less than|greater than|equals?\b|is (?:less|greater|equal))"
CONTROL, CONTROLLED = ("while", "if"), ("loop", "statement", "condition")
# Words of grammar and control flow that are never read as a misspelt term.
PROTECTED = (
    "a", "an", "and", "another", "any", "as", "at", "both", "by", "do", "each", "else", "every", "false", "for", "from", "if", "in", "is", "no",
    "not", "of", "on", "one", "or", "same", "so", "than", "then", "to", "true", "until", "when", "where", "while", "with", "yes",
)


SEGMENT, NEXT_WORDS = 64, 4
_RUN, _PART, _DROPPED = re.compile(WORDS_BETWEEN_BLANKS), re.compile(r"[A-Za-z0-9'’]+"), re.compile("['’]")
_TOKEN, _LETTER = re.compile("[A-Za-z0-9_'’-]+"), re.compile("[A-Za-z]")


def stretches(sentences: DataFrame, longest: int = 4) -> DataFrame:
    """Maximal runs of words with only blanks between, so that nothing made of them crosses punctuation, in segments.

    sentences (doc_id, pos, sentence) -> doc_id, pos, stretch, base, own_from, own_to, tokens, starts, stops, after.  A
    segment owns up to SEGMENT words, tokens[own_from:own_to], and holds the neighbours that phrases of ``longest`` words
    need; base is the place of its first word in the stretch, starts and stops are places in the sentence, after the first
    signs behind the stretch.  So no row grows with its sentence, and a sentence is read once.
    """
    rows = sentences.select("doc_id", "pos", "sentence")
    kinds = rows.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), strings, ints, ints, pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch, picked, made = whole.slice(at, 200), [], []
                for row, sentence in enumerate(batch.column(2).to_pylist()):
                    for number, run, parts in _parts(sentence):
                        after = sentence[run.end() : run.end() + 40].lstrip()[:2]
                        for own in range(0, len(parts), SEGMENT):
                            base, end = max(0, own - longest + 1), own + SEGMENT + longest - 1 + NEXT_WORDS
                            held = list(zip(*parts[base:end]))
                            picked.append(row)
                            made.append((number, base, own - base, min(own + SEGMENT, len(parts)) - base, *held, after))
                columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(types), types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(picked, pa.int32())) for i in (0, 1)), *columns], names=["doc_id", "pos", "stretch", "base", "own_from", "own_to", "tokens", "starts", "stops", "after"])

    schema = "stretch int, base int, own_from int, own_to int, tokens array<string>, starts array<int>, stops array<int>, after string"
    return rows.mapInArrow(cut, f"doc_id {kinds['doc_id'].dataType.simpleString()}, pos {kinds['pos'].dataType.simpleString()}, {schema}")


def _parts(sentence: str | None) -> Iterator[tuple[int, re.Match, list[tuple[str, int, int]]]]:
    """The stretches of a sentence, each with its words and their places."""
    for number, run in enumerate(_RUN.finditer(sentence or "")):
        at = run.start()
        yield number, run, [(w, at + m.start(), at + m.end()) for m in _PART.finditer(run.group()) if (w := _DROPPED.sub("", m.group()).lower())]


MOST_KEPT = 500_000  # words that a task remembers


def _words_of(token: str) -> tuple[str, ...]:
    """The words, in order, that stretches have of a maximal run of their signs: what comes before its first letter is in none."""
    if token.isascii() and token.isalpha():
        return (token.lower(),)
    first = _LETTER.search(token)
    return tuple(w for p in _PART.findall(token, first.start()) if (w := _DROPPED.sub("", p).lower())) if first else ()


class _Numbers(dict):
    """Numbers of the words of a run of signs (``_TOKEN``), -1 for those without one; made once while they are kept."""

    def __init__(self, numbers: Mapping[str, int]) -> None:
        self.numbers = numbers

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= MOST_KEPT:
            self.clear()
        self[token] = found = tuple(self.numbers.get(w, -1) for w in _words_of(token))
        return found


def _fitting(alone: Set[str], pairs: Iterable[tuple[str, str]]) -> Callable[[Sequence[str | None]], np.ndarray]:
    """Which sentences have a word of ``alone``, or two words that are a pair one after the other, whatever stands between them."""
    pairs = list(pairs)
    numbers = {w: i for i, w in enumerate([*alone, *{w for pair in pairs for w in pair if w not in alone}])}
    known, n_alone, most = _Numbers(numbers), len(alone), max(1, len(numbers))
    keys = np.unique(np.array([numbers[a] * most + numbers[b] for a, b in pairs] + [-1], np.int64))

    def fitting(sentences: Sequence[str | None]) -> np.ndarray:
        tokens, counts = [], []
        for sentence in sentences:
            found = _TOKEN.findall(sentence or "")
            tokens += found
            counts.append(len(found))
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        of = [known[t] for t in coded.dictionary.to_pylist()]
        size, flat, code = np.array([len(x) for x in of], np.int64), np.array([i for x in of for i in x], np.int64), coded.indices.to_numpy()
        n, ends = size[code], np.cumsum(size[code])
        word = flat[np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        owner = np.repeat(np.repeat(np.arange(len(counts)), counts), n)
        out = np.zeros(len(counts), bool)
        out[owner[(word >= 0) & (word < n_alone)]] = True
        two = np.flatnonzero((owner[1:] == owner[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
        key = word[two] * most + word[two + 1]
        out[owner[two[keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key]]] = True
        return out

    return fitting


def words_in(sentences: DataFrame, least: int = 3) -> DataFrame:
    """word: the distinct words of at least ``least`` letters in all stretches; a task gives a word once while it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[str] = set()
        for batch in batches:
            tokens: set[str] = set()
            for sentence in batch.column(0).to_pylist():
                tokens.update(_TOKEN.findall(sentence or ""))
            found = set().union(*map(_words_of, tokens)) - given
            given = found if len(given) + len(found) > MOST_KEPT else given | found
            yield pa.RecordBatch.from_arrays([pa.array([w for w in found if len(w) >= least], pa.string())], names=["word"])

    return sentences.select("sentence").mapInArrow(run, "word string").distinct()


def suspects(sentences: DataFrame, cases: Sequence[tuple[str, int, Sequence[str] | None]], longest: int = 4) -> DataFrame:
    """The words of ``stretches`` that a case (word, side, beside) names, with the words around that a phrase and what follows
    it need: doc_id, pos, stretch, base, tokens, starts, stops, after, i, word.

    A word whose cases all want a neighbour that is not there is left out, so that few words of a text become rows.
    """
    rows = sentences.select("doc_id", "pos", "sentence")
    kinds = rows.schema
    alone = {word for word, _, near in cases if near is None}
    after, before = {}, {}  # what may stand behind a word, and what before it
    for word, side, near in cases:
        if near is not None and word not in alone:
            (after if side > 0 else before).setdefault(word, set()).update(near)
    never: frozenset[str] = frozenset()

    def places(words: Sequence[str]) -> list[int]:
        """Words that are cases, of some in a row."""
        n = len(words) - 1
        return [i for i, w in enumerate(words) if w in alone or (i < n and words[i + 1] in after.get(w, never)) or (i and words[i - 1] in before.get(w, never))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())
        types = [pa.int32(), pa.int32(), strings, ints, ints, pa.string(), pa.int32(), pa.string()]
        fitting = _fitting(alone, [*((w, x) for w, of in after.items() for x in of), *((x, w) for w, of in before.items() for x in of)])
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch, picked, made = whole.slice(at, 2000), [], []
                told = batch.column(2).to_pylist()
                # words that stand together in a stretch do so in the sentence: where none fits there, no stretch is cut out
                for row in np.flatnonzero(fitting(told)).tolist():
                    sentence = told[row]
                    for number, found, parts in _parts(sentence):
                        for i in places([p[0] for p in parts]):
                            base = max(0, i - longest + 1)
                            picked.append(row)
                            made.append((number, base, *zip(*parts[base : i + longest + NEXT_WORDS]), sentence[found.end() : found.end() + 40].lstrip()[:2], i - base, parts[i][0]))
                columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(types), types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(picked, pa.int32())) for i in (0, 1)), *columns], names=["doc_id", "pos", "stretch", "base", "tokens", "starts", "stops", "after", "i", "word"])

    schema = "stretch int, base int, tokens array<string>, starts array<int>, stops array<int>, after string, i int, word string"
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id'].dataType.simpleString()}, pos {kinds['pos'].dataType.simpleString()}, {schema}")


def _same(a: Column, b: Column) -> Column:
    return (a == b) | inflected(a, b)


def _likeness(a: Column, b: Column) -> Column:
    """Matching-blocks similarity of equal words or simple inflections of each other, which share all but an ending."""
    shared = F.least(F.length(a), F.length(b)) - F.when(a.endswith("ies") != b.endswith("ies"), 1).otherwise(0)
    return F.when(a == b, 1.0).otherwise(2.0 * shared / (F.length(a) + F.length(b)))


def _inflections(word: Column) -> Column:
    """Forms of which two words share one if they are equal or simple inflections of each other."""
    stem = lambda n, end: F.concat(F.substring(word, F.lit(1), F.length(word) - n), F.lit(end))
    made = F.array(word, F.when(word.endswith("s"), stem(1, "")), F.when(word.endswith("es"), stem(2, "")), F.when(word.endswith("ies"), stem(3, "y")))
    return F.array_distinct(F.array_compact(made))


def _variants(word: Column) -> Column:
    """All words that equal ``word`` or are simple inflections of it, either way."""
    longer = F.array(F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.when(word.endswith("y"), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies"))))
    return F.array_compact(F.concat(_inflections(word), longer))


def detect(
    sentences: DataFrame, terms: DataFrame, longest: int = 4, word_floor: float = 0.86, phrase_floor: float = 0.78, token_floor: float = 0.62, margin: float = 0.04, protected: Sequence[str] = PROTECTED,
    anchors: tuple[Sequence[str], Sequence[str]] | None = None,
) -> DataFrame:
    """Suspicious spans: runs of 1..``longest`` words that differ from one vocabulary term of as many words in one token.

    sentences (doc_id, pos, sentence), terms (key, n_words); anchors (strong, weak words): only sentences that are
    ``technical`` by them are searched, without them all are.  The corpus' distinct words meet the vocabulary's words on
    deletion forms first, and these pairs the terms with that word in place; only occurrences of such words go on whose
    neighbour in the phrase fits too.  Other tokens must be equal or simple inflections; valid wording and conditions of control flow ("while low
    less than ...") are left out.  Returns doc_id, pos, stretch, start, n (places in words), begin, stop (places in the
    sentence), original, term, score.
    """
    known = terms.where(F.col("n_words") <= longest).select(F.col("key").alias("term"), F.split("key", " ").alias("t"), F.col("n_words").alias("n")).distinct()
    few = F.broadcast if known.count() <= MOST_TERMS else (lambda t: t)
    searched = sentences if anchors is None else cut(sentences.where(technical(F.col("sentence"), *anchors)).select("doc_id", "pos", "sentence"))
    words = words_in(searched)
    words = words.where(~F.col("word").isin(*protected)) if protected else words
    parts = known.select(F.explode("t").alias("term")).where(F.length("term") >= 3).distinct()
    close = close_words(words, parts, short_edits=2).where(~inflected(F.col("word"), F.col("term")))
    close = close.withColumn("likeness", ratio(F.col("word"), F.col("term"))).where(F.col("likeness") >= token_floor).withColumnRenamed("term", "token")
    placed = known.select("term", "t", "n", F.posexplode("t").alias("k", "token"))
    # what needs no text is settled here, once per word and term; of a phrase, which words may stand beside the suspicious one
    edits = F.when((F.col("n") == 1) & (F.greatest(F.length("word"), F.length("token")) <= 7), 1).otherwise(2)
    cases = close.join(few(placed), "token").where((F.col("edits") <= edits) & ((F.col("n") > 1) | (F.col("likeness") >= word_floor)))
    side = F.when(F.col("k") == 0, 1).otherwise(-1)
    cases = cut(cases.select("word", "likeness", "term", "t", "n", "k", side.alias("side"), F.when(F.col("n") > 1, _variants(F.get("t", F.col("k") + side))).alias("beside")))
    named_by = cases.select("word", "side", "beside").limit(MOST_CASES + 1).collect()
    if len(named_by) <= MOST_CASES:  # only words with a case, and the neighbour it wants, become rows
        hits = suspects(searched, [tuple(r) for r in named_by], longest).join(F.broadcast(cases), "word")
    else:
        owned = stretches(searched, longest).select("doc_id", "pos", "stretch", "base", "own_from", "own_to", "tokens", "starts", "stops", "after", F.posexplode("tokens").alias("i", "word"))
        hits = owned.where((F.col("i") >= F.col("own_from")) & (F.col("i") < F.col("own_to"))).join(cases, "word")
    start, n, at = F.col("i") - F.col("k"), F.col("n"), F.col("i") + F.col("side")
    hits = hits.where((start >= 0) & (start + n <= F.size("tokens"))).where((n == 1) | F.array_contains("beside", F.get("tokens", at)))
    others = F.zip_with(F.slice("tokens", F.greatest(start, F.lit(0)) + 1, n), "t", lambda w, t: F.when(_same(w, t), _likeness(w, t)))
    fit = hits.withColumn("others", others).where(F.size(F.filter("others", lambda x: x.isNull())) == 1)  # the suspicious token itself
    total = F.aggregate("others", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    floor = F.when(n == 1, word_floor).otherwise(phrase_floor)
    original = F.array_join(F.slice("tokens", F.greatest(start, F.lit(0)) + 1, n), " ")
    scored = fit.withColumn("score", (total + F.col("likeness")) / n)
    scored = scored.select(
        "doc_id", "pos", "stretch", (F.col("base") + start).alias("start"), "n", F.get("starts", start).alias("begin"), F.get("stops", start + n - 1).alias("stop"), original.alias("original"), "term", "t", "score",
        floor.alias("floor"), F.slice("tokens", F.greatest(start + n, F.lit(0)) + 1, F.lit(NEXT_WORDS)).alias("next"), "after", F.get("tokens", start).alias("first"),
    )
    first_forms = known.select(F.col("t").alias("_t"), "n", F.explode(_inflections(F.col("t")[0])).alias("form"))
    wording = scored.withColumn("form", F.explode(_inflections(F.col("first")))).join(few(first_forms), ["form", "n"], "left")
    valid = F.coalesce(F.forall(F.zip_with(F.split("original", " "), "_t", _same), lambda x: x), F.lit(False))
    scored = wording.groupBy(*scored.columns).agg(F.bool_or(valid).alias("valid")).where("not valid")
    span = Window.partitionBy("doc_id", "pos", "stretch", "start", "n").orderBy(F.desc("score"), "term")
    best = scored.withColumn("_r", F.row_number().over(span)).withColumn("_next", F.lead("score").over(span))
    follows = F.array_join("next", " ").rlike(COMPARED) | ((F.size("next") == 0) & F.col("after").rlike(r"^(?:<=|>=|==|!=|<|>)"))
    control = (n == 2) & F.col("first").isin(*CONTROL) & (F.col("t")[0] == F.col("first")) & F.get("t", F.lit(1)).isin(*CONTROLLED) & follows
    kept = best.where((F.col("_r") == 1) & (F.col("score") >= F.col("floor")) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin) & ~control)
    return kept.select("doc_id", "pos", "stretch", "start", "n", "begin", "stop", "original", "term", F.round("score", 4).alias("score"))


def _valid_wording(originals: DataFrame, known: DataFrame) -> DataFrame:
    """Those originals whose tokens all equal or inflect the tokens of some term."""
    ours = originals.withColumn("w", F.split("original", " ")).withColumn("form", F.explode(_inflections(F.col("w")[0])))
    theirs = known.withColumn("form", F.explode(_inflections(F.col("t")[0])))
    same = F.forall(F.zip_with("w", "t", _same), lambda x: x)
    return ours.join(theirs, ["form", "n"]).where(same).select("original").distinct()


def pick_spans(spans: DataFrame) -> DataFrame:
    """Longest, then best-scoring spans of a stretch that do not overlap.

    Spans that touch one another through others make a group; each group is folded in that order, so that a stretch of any
    length costs a sort by start and short folds.
    """
    key = [c for c in ("doc_id", "pos", "stretch") if c in spans.columns]
    rest = [c for c in spans.columns if c not in key]
    by_start = Window.partitionBy(*key).orderBy("start", "n")
    reach = F.max(F.col("start") + F.col("n")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1))).withColumn("_group", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct((-F.col("n")).alias("a"), (-F.col("score")).alias("b"), F.col("start").alias("c"), F.struct(*rest).alias("x"))
    listed = grouped.groupBy(*key, "_group").agg(F.sort_array(F.collect_list(order)).alias("s")).withColumn("s", F.transform("s", lambda o: o["x"]))
    free = lambda a, x: ~F.exists(a, lambda k: (x["start"] < k["start"] + k["n"]) & (x["start"] + x["n"] > k["start"]))
    kept = F.aggregate("s", F.filter("s", lambda x: F.lit(False)), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return listed.select(*key, F.explode(kept).alias("k")).select(*key, "k.*").select(*spans.columns)


def memory_lookup(phrases: DataFrame, memory: DataFrame, floor: float = 0.20) -> DataFrame:
    """Best approved memory row of each (id, key, context): equal key, and context Jaccard of at least ``floor`` or no
    stored context; by likeness, confidence, times applied, then memory id.  Distinct contexts meet, not rows."""
    ours = F.array_sort(F.array_distinct("context"))
    first = F.struct(F.col("confidence").isNull(), -F.col("confidence"), F.col("times_applied").isNull(), -F.col("times_applied"), "memory_id")
    # of one key and set of contexts only the best row can win, whatever is asked: few of a large memory meet anything
    best = memory.where("status = 'approved'").withColumn("m_context", ours).groupBy("key", "m_context").agg(F.min_by(F.struct("memory_id", "correction", "confidence", "times_applied"), first).alias("m"))
    sets = phrases.select("key", ours.alias("_set")).distinct()
    words = lambda c: F.explode(F.col(c)).alias("_word")
    # likeness of at least ``floor`` needs a shared context; without a floor, and for bare memories, the key is enough
    shared = sets.select("key", "_set", words("_set")).join(best.select("key", "m_context", "m", words("m_context")), ["key", "_word"]) if floor > 0 else sets.join(best.where(F.size("m_context") > 0), "key")
    met = shared.groupBy("key", "_set", "m_context").agg(F.first("m").alias("m"))
    both = F.size(F.array_intersect("_set", "m_context")) / F.size(F.array_union("_set", "m_context"))
    liked = met.withColumn("likeness", F.round(both, 6)).where(F.col("likeness") >= floor).select("key", "_set", "m", "likeness")
    bare = sets.join(best.where(F.size("m_context") == 0), "key").select("key", "_set", "m", F.lit(0.0).alias("likeness"))
    order = (F.desc("likeness"), F.desc("m.confidence"), F.desc("m.times_applied"), "m.memory_id")
    won = liked.unionByName(bare).withColumn("_r", F.row_number().over(Window.partitionBy("key", "_set").orderBy(*order))).where("_r = 1").drop("_r")
    found = phrases.withColumn("_set", ours).join(won, ["key", "_set"]).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return found.where("_r = 1").select("id", "key", "m.memory_id", "m.correction", "likeness")


SAFE = r"^[A-Za-z0-9_+\-./<>=\[\]() ]+$"
CODE_PATH = r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)++$"


def validate(proposals: DataFrame, terms: DataFrame, minimum: float = 0.82, token_floor: float = 0.62, most_words: int = 6, protected: Sequence[str] = PROTECTED) -> DataFrame:
    """proposals with the first failing check of 21 as ``reason``, or null, and ``ok``.

    Columns: id and answered_id (issue asked and answered), detected (its span), original, replacement, confidence, text and
    start (where the span stood), after (the rest of its sentence) and candidates (terms of the detector).  terms: key.
    """
    known = terms.select("key").distinct()
    trimmed = proposals.withColumn("replacement", F.trim(F.coalesce("replacement", F.lit("")))).withColumn("_ok", term_key(F.col("original"))).withColumn("_rk", term_key(F.col("replacement")))
    forms = known.select(F.col("key").alias("term"), F.split("key", " ").alias("t"), F.size(F.split("key", " ")).alias("n"))
    wording = _valid_wording(trimmed.select(F.col("_ok").alias("original"), F.size(F.split("_ok", " ")).alias("n")).distinct(), forms)
    few = lambda t: F.broadcast(t) if t.count() <= MOST_TERMS else t
    joined = trimmed.join(few(wording.select(F.col("original").alias("_ok"), F.lit(True).alias("_valid"))), "_ok", "left").join(few(known.select(F.col("key").alias("_rk"), F.lit(True).alias("_term"))), "_rk", "left")
    pairs = F.filter(F.zip_with(F.split("_ok", " "), F.split("_rk", " "), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~F.coalesce(p["a"] == p["b"], F.lit(False)))
    joined = joined.withColumn("_o", F.split("_ok", " ")).withColumn("_n", F.split("_rk", " ")).withColumn("_p", pairs)
    first = F.get("_p", F.lit(0))
    near = joined.withColumn("_like", ratio(F.coalesce(first["a"], F.lit("")), F.coalesce(first["b"], F.lit(""))))
    original, new, a, b = F.col("original"), F.col("replacement"), first["a"], first["b"]
    edits = F.when((F.greatest(F.length(a), F.length(b)) <= 7) & (F.size("_o") == 1), 1).otherwise(2)
    control = (F.size("_o") == 2) & F.col("_o")[0].isin(*CONTROL) & (F.col("_n")[0] == F.col("_o")[0]) & F.get("_n", F.lit(1)).isin(*CONTROLLED)
    compared = F.lower("after").rlike(r"^\s*(?:less\s+than|greater\s+than|equal(?:s|\s+to)?|is\s+(?:less|greater|equal)|<=|>=|==|!=|<|>)")
    checks = [
        ("other_issue", F.col("answered_id") != F.col("id")), ("not_the_span", original != F.col("detected")),
        ("source_changed", F.substring(F.col("text"), F.col("start") + 1, F.length("detected")) != F.col("detected")), ("empty_replacement", new == ""), ("low_confidence", F.col("confidence") < minimum),
        ("line_break", new.rlike(r"[\r\n]")), ("too_long", F.size(F.split(new, r"\s+")) > most_words), ("unsupported_characters", ~new.rlike(SAFE)), ("no_content", (F.col("_ok") == "") | (F.col("_rk") == "")),
        ("format_only", F.col("_ok") == F.col("_rk")), ("already_valid", F.col("_valid")), ("crosses_punctuation", ~original.rlike(rf"^[^A-Za-z]*{WORDS_BETWEEN_BLANKS}[^A-Za-z]*$")),
        ("token_count", F.size("_o") != F.size("_n")), ("no_token_changed", F.size("_p") == 0), ("inflection_only", F.forall("_p", lambda p: inflected(p["a"], p["b"]))), ("several_tokens", F.size("_p") != 1),
        ("control_word", a.isin(*protected)), ("not_close", F.col("_like") < token_floor), ("too_many_edits", F.levenshtein(a, b) > edits), ("control_flow", control & compared),
        ("not_supported", ~(F.coalesce("_term", F.lit(False)) | F.exists(F.coalesce("candidates", F.array()), lambda c: term_key(c) == F.col("_rk")) | new.rlike(CODE_PATH))),
    ]
    reason = reduce(lambda rest, check: F.when(F.coalesce(check[1], F.lit(False)), F.lit(check[0])).otherwise(rest), reversed(checks), F.lit(None).cast("string"))
    return near.select(*proposals.columns, reason.alias("reason")).withColumn("ok", F.col("reason").isNull())


def resolve(issues: DataFrame, remembered: DataFrame, proposals: DataFrame, sentences: int = 20) -> DataFrame:
    """issues (doc_id, pos, id) routed: memory first; of the rest those of the first sentences go to the proposer.

    doc_id, id, route (memory, proposed, rejected, requested, unrequested), correction.
    """
    m = issues.join(remembered.select("id", F.col("correction").alias("m")), "id", "left")
    rest = m.where("m is null").withColumn("_s", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("pos")))
    asked = rest.join(proposals.select("id", "replacement", "ok"), "id", "left")
    route = F.when(F.col("_s") > sentences, "unrequested").when(F.col("ok"), "proposed").when(~F.col("ok"), "rejected").otherwise("requested")
    done = m.where("m is not null").select("doc_id", "id", F.lit("memory").alias("route"), F.col("m").alias("correction"))
    return done.unionByName(asked.select("doc_id", "id", route.alias("route"), F.when(route == "proposed", F.col("replacement")).alias("correction")))


def requests(issues: DataFrame) -> DataFrame:
    """One request per sentence: issues as a JSON payload in issue order."""
    return issues.groupBy("doc_id", "pos").agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "original", "candidates")))).alias("payload"))


def responses(answers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Answers (JSON arrays of {id, replacement, confidence}) as rows: unknown ids dropped, the first of repeats kept."""
    rows = answers.select(F.posexplode(F.from_json("answer", "array<struct<id:bigint,replacement:string,confidence:double>>")).alias("at", "a"), "answer_id").select("answer_id", "at", "a.*")
    first = F.row_number().over(Window.partitionBy("id").orderBy("answer_id", "at"))
    return rows.join(allowed.select("id").distinct(), "id", "left_semi").withColumn("_r", first).where("_r = 1").select("id", "replacement", "confidence")


def _fold(start: str) -> str:
    kind = "array<struct<start:int,stop:int,replacement:string>>"
    return f"aggregate({start}, cast(array() as {kind}), (a, x) -> if(size(a) > 0 and x.start < element_at(a, -1).stop, a, concat(a, array(x))))"


def non_overlapping(corrections: DataFrame) -> DataFrame:
    """(id, start, stop, replacement) per text, in start order, without those that begin before the last kept one ends."""
    listed = corrections.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "replacement"))).alias("s"))
    return listed.select("id", F.explode(F.expr(_fold("s"))).alias("c")).select("id", "c.*")


@F.pandas_udf(StringType())
def _spliced(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with their spans (start, stop, replacement; ascending, apart) replaced, in one pass over each."""

    def splice(t: str | None, found: list | None) -> str | None:
        if t is None or found is None:
            return t
        parts, at = [], 0
        for x in found:
            parts += [t[at : x["start"]], x["replacement"]]
            at = x["stop"]
        return "".join([*parts, t[at:]])

    return pd.Series([splice(t, found) for t, found in zip(text, spans)], dtype=object)


def apply_spans(texts: DataFrame, corrections: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """texts (key, text) with non-overlapping corrections (key, start, stop, replacement) made; one without any stays."""
    spans = corrections.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "replacement"))).alias("s"))
    return texts.join(spans, list(key), "left").select(*key, _spliced("text", "s").alias("text"))


def apply_rules(sentences: DataFrame, rules: Sequence[Mapping[str, str]]) -> DataFrame:
    """sentences with rules applied in order: pattern -> replacement where the context pattern matches and the
    forbidden one does not; adds fixed and applied (names of the rules that changed something)."""
    text, names = F.col("sentence"), F.array().cast("array<string>")
    for rule in rules:
        allowed = F.lit(True) if not rule.get("context") else F.col("sentence").rlike(rule["context"])
        if rule.get("forbidden"):
            allowed = allowed & ~F.col("sentence").rlike(rule["forbidden"])
        changed = F.when(allowed, F.regexp_replace(text, rule["pattern"], rule["replacement"])).otherwise(text)
        names = F.when(changed != text, F.array_append(names, F.lit(rule["name"]))).otherwise(names)
        text = changed
    return sentences.select("*", text.alias("fixed"), names.alias("applied"))


def fuzzy_spelling(words: DataFrame, terms: DataFrame, floor: float = 0.92, margin: float = 0.05) -> DataFrame:
    """word, term, score: one-word terms very like a word, clearly better than the next; compared once per word."""
    pairs = close_words(words.select("word").distinct(), terms).withColumn("score", ratio(F.col("word"), F.col("term"))).where(F.col("score") >= floor)
    order = Window.partitionBy("word").orderBy(F.desc("score"), "term")
    lead = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))
    return pairs.withColumn("_r", F.row_number().over(order)).withColumn("_lead", lead).where((F.col("_r") == 1) & (F.col("_lead") >= margin)).select("word", "term", "score")
