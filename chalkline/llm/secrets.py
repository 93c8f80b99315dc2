"""Operator 5: secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into (name, literal) pairs: ``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``name => x``.  Literals and sums of literals bound to a name are constants of the document; a later
``other = name`` carries the literal to ``other``.  A literal is scored by the most sensitive name it reaches and by its
own shape (length, character classes, entropy); from ``MIN_SCORE`` on its span is a secret of kind ``literal``.  Three
plain patterns (assign, access, hex) are always reported beside it.

Constants are never spelled out: a sum only points to its parts, and a literal's shape is a bounded state (character
counts by code point modulo 256, classes, first and last 16 characters) that two parts' states add up to.  So a text costs
time and memory in proportion to its length, also where ``a = a + a`` doubles a constant on every line.  A sum ends
before an unquoted part that holds an operator itself, because an assignment of its own begins there.

Defined results: null text counts as empty (no spans); repeated rows are scanned row by row; offsets are code points,
end exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from operator import add
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from chalkline.llm.common import map_rows, small, texts

MIN_SCORE = 0.6
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal, so asking for 18 in all drops exactly the short ones
HEX = re.compile(r"[0-9a-f]{16,}")
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

OPERATOR = re.compile(r":=|=>|(?<![=!<>+*/-])=(?!=)|:(?![:/])")
NAME_START = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
NAME = NAME_START | frozenset("0123456789.-")
BLANKS = re.compile(r"[ \t]*")
QUOTED = re.compile(r"\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)'|`([^`\n]*)`")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>+]+")
REFERENCE = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")
PLUS = re.compile(r"[ \t]*\+(?!\+|=)")
PLACEHOLDER = re.compile(r"(?i)\$\{|\{\{|%\(|example|changeme|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}")
VOID = frozenset(("none", "null", "true", "false", "undefined"))
EDGE, HUGE = 16, 1e12  # an edge is longer than any placeholder that two parts could make together
# Name parts and how far a name holding them asks for secrecy.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "auth": 0.7, "bearer": 0.8, "signingkey": 0.9, "encryptionkey": 0.9}


def name_score(name: str) -> float:
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((v for k, v in SENSITIVE.items() if k in flat), default=0.0)


class Shape(NamedTuple):
    """What a literal's score needs, whatever its length; ``+`` gives the shape of two literals in a row."""

    counts: dict[int, float]
    n: float
    classes: frozenset[str]
    bad: bool
    head: str
    tail: str

    @staticmethod
    def of(literal: str) -> Shape:
        counts: dict[int, float] = {}
        for char, k in Counter(literal).items():
            counts[ord(char) % 256] = counts.get(ord(char) % 256, 0) + k
        classes = frozenset(c for c, p in zip("aA0.", ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) if re.search(p, literal))
        return Shape(counts, len(literal), classes, bool(PLACEHOLDER.search(literal)) or any(map(str.isspace, literal)), literal[:EDGE], literal[-EDGE:])

    def __add__(self, other: Shape) -> Shape:
        counts, n = dict(self.counts), self.n + other.n
        for char, k in other.counts.items():
            counts[char] = counts.get(char, 0) + k
        if n > HUGE:  # only proportions matter there
            counts, n = {char: k * 1e-6 for char, k in counts.items()}, n * 1e-6
        bad = self.bad or other.bad or bool(PLACEHOLDER.search(self.tail + other.head))
        return Shape(counts, n, self.classes | other.classes, bad, (self.head + other.head)[:EDGE], (self.tail + other.tail)[-EDGE:])

    def score(self) -> float:
        """0..1: long, mixed, high-entropy literals look like secrets; words and placeholders do not."""
        if self.n < 8 or self.bad or len(self.classes) < 2 or self.n <= EDGE and self.head.lower() in VOID:
            return 0.0
        entropy = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        return min(1.0, self.n / 16) * 0.3 + min(1.0, entropy / 3.5) * 0.4 + (len(self.classes) - 1) / 2 * 0.3


def name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, blanks and a quote aside, or nothing.  Names and blanks hold no operator, so all walks
    together are linear in the text."""
    at -= text.endswith("\n", 0, at)
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] in "\"'":
        at -= 1
    start = at
    while start and text[start - 1] in NAME:
        start -= 1
    return text[start:at] if start < at and text[start] in NAME_START else ""


class Constants:
    """(name, literal) pairs of a text.  A literal is a part [start, end, next part of the same bare run] or a sum of them."""

    def __init__(self, text: str) -> None:
        self.text, self.parts, self.sums, self.pairs = text, [], [], []
        ops = [m.span() for m in OPERATOR.finditer(text)]
        self._starts = [s for s, _ in ops]
        known: dict[str, int] = {}
        run, last = (0, 0), -1  # the bare run that the latest value began in, and the latest part in it
        for start, at in ops:
            if not (name := name_before(text, start)):
                continue
            made: list[int] = []  # parts as they are, sums as negative numbers
            while True:
                at = BLANKS.match(text, at).end()
                if quoted := QUOTED.match(text, at):
                    made.append(self._part(*quoted.span(quoted.lastindex)))
                    at = quoted.end()
                else:
                    bare = BARE.match(text, at) if not run[0] <= at < run[1] else None
                    if bare is None and not run[0] <= at < run[1]:
                        break
                    end = bare.end() if bare else run[1]
                    holds = self._operator_within(at, end)
                    if holds and made:
                        break
                    word = "" if holds else text[at:end]
                    if word in known:
                        made.append(known[word])
                    elif not holds and REFERENCE.fullmatch(word):
                        break  # computed elsewhere
                    else:
                        part = self._part(at, end)
                        if run[0] <= at < run[1] and last >= 0:
                            self.parts[last][2] = part
                        if not made:
                            run, last = (run if bare is None else (at, end)), part
                        made.append(part)
                    at = end
                    if holds:
                        break
                if not (plus := PLUS.match(text, at)):
                    break
                at = plus.end()
            if made:
                known[name] = made[0] if len(made) == 1 else self._sum(made)
                self.pairs.append((name, known[name]))

    def _part(self, start: int, end: int) -> int:
        self.parts.append([start, end, None])
        return len(self.parts) - 1

    def _sum(self, made: list[int]) -> int:
        self.sums.append(tuple(made))
        return -len(self.sums)

    def _operator_within(self, start: int, end: int) -> bool:
        k = bisect_left(self._starts, start)
        return k < len(self._starts) and self._starts[k] < end

    def _reachable(self, roots: list[int]) -> tuple[list[int], list[int]]:
        """Parts and sums (both oldest first) that the roots are made of; each is visited once."""
        seen, todo = set(roots), list(set(roots))
        while todo:
            item = todo.pop()
            more = self.sums[-item - 1] if item < 0 else ()
            todo += (new := set(more) - seen)
            seen |= new
        return sorted(i for i in seen if i >= 0), sorted((i for i in seen if i < 0), reverse=True)

    def secret_spans(self) -> list[tuple[int, int]]:
        """Spans of the parts of all literals that reach a sensitive name and look like a secret."""
        weights = [(item, weight) for name, item in self.pairs if (weight := name_score(name))]
        parts, sums = self._reachable([item for item, _ in weights])
        rest, stack = set(parts), list(parts)
        while stack:  # a part's shape needs those of the later parts of its run
            after = self.parts[stack.pop()][2]
            if after is not None and after not in rest:
                rest.add(after)
                stack.append(after)
        shapes: dict[int, Shape] = {}
        for k in sorted(rest, reverse=True):
            start, end, after = self.parts[k]
            shapes[k] = Shape.of(self.text[start:end]) if after is None else Shape.of(self.text[start : self.parts[after][0]]) + shapes[after]
        for k in sums:
            shapes[k] = reduce(add, (shapes[i] for i in self.sums[-k - 1]))
        secret = [item for item, weight in weights if weight * shapes[item].score() >= MIN_SCORE]
        return [(s, e) for s, e, _ in (self.parts[k] for k in self._reachable(secret)[0]) if e > s]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if any(c in low for c in CUES) else []
    return found + [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain patterns' spans, and those with the lexer's literals that no plain span holds already."""
    base = in_order(base_spans(text))
    if ":" not in text and "=" not in text:
        return base, base
    starts, reach = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max, initial=0))
    more = {("literal", s, e) for s, e in Constants(text).secret_spans() if reach[bisect_right(starts, s)] < e}
    return base, in_order(base + list(more))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret replaced; overlapping spans become one mark."""
    out, at = [], 0
    for _, start, end in sorted(all_spans(text)[1], key=lambda x: x[1]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())])
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        cols: list[list] = [[] for _ in range(6)]
        for raw in texts(batch):
            base, every = all_spans(raw.decode())
            kinds = Counter(k for k, _, _ in every)
            for col, value in zip(cols, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), kinds["literal"])):
                col.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(RESULT)[1:]))], schema=RESULT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of secrets per document; one scan, no shuffle."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, DDL)


def _redact(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        new = pa.array([None if t is None else redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced by a mark; null texts stay null."""
    return map_rows(docs, _redact)
