"""Operator 13: how far the sources of a language differ in their terms, by one-hot level products.

Terms are runs of letters (A-Z lower-cased, all characters beyond ASCII count).  A language keeps the terms of at least
``min_docs`` of its documents.  A group (lang, source), and the language as a whole, prices a kept term of count c at
p = 1 + floor(10^9 * (c + 5) / (N + 5 * V)), N its count over kept terms and V their number; prices are exact (decimals).

A pair's distance is the sum of |p - q| over all kept terms.  The kept terms of a language are dealt to blocks of about
``block`` terms.  In a block, every group has an indicator column for each count level it shows; the matrix of these
columns for ``groups`` groups, transposed and multiplied by that of others, is the exact joint table (how many terms have
level a here and level b there), for all pairs of groups at once.  A joint table times |price a - price b|, summed over
its levels, is the block's share of the distance.  Counts and products are integers below 2^24 in float32 matrices,
shares are 64-bit integers: nothing is rounded.

What moves: (lang, source, term) counts, added up before they leave a task; then kept counts.  A block holds ``block``
counts of every source of its language, so a task's memory follows the number of sources, of which the result has all
pairs.  Shares are added up over the blocks of a task before they leave it.

Defined results: null text, lang and source read as ''; groups without terms have price floors alone (0 counts); a language
without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs; repeated rows count
each; ties go by item in UTF-8 order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.common import materialize, small, texts

MIN_DOCS, TOP = 30, 50
BLOCK, GROUPS = 200, 8
FLUSH = 300_000

_LETTERS = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in _LETTERS)

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _count(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, given out whenever ``flush`` of them are held; a row without a term stands for the group."""

    def rows() -> pa.RecordBatch:
        made = [(*g, t and t.decode(), n, d) for g, (ns, ds) in held.items() for t, n, d in [(None, 0, 0), *((t, n, ds[t]) for t, n in ns.items())]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), COUNTS)], schema=COUNTS)

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in small(batches):
        for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, 2)):
            ns, ds = held.setdefault((lang, source), (Counter(), Counter()))
            found = terms(raw)
            before = len(ns)
            ns.update(found)
            ds.update(set(found))
            size += len(ns) - before
            if size >= flush:
                yield rows()
                size = 0
    if held:
        yield rows()


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, flush: int = FLUSH) -> DataFrame:
    """lang, source, term, n, total (of the language), lead (one row of every kept term has it); a null term per group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = plain.mapInArrow(partial(_count, flush=flush), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("in_docs"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    return marked.where(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("in_docs")


def _price(n: str, total: str) -> F.Column:
    return F.expr(f"1 + (cast(1000000000 as decimal(20,0)) * cast({n} + 5 as decimal(18,0))) div cast({total} + 5 * n_terms as decimal(20,0))")


def priced(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """kept counts with n_terms (V), n_blocks, p (the group's price), floor (the group's for count 0) and q (the language's)."""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.sum(F.when(F.col("term").isNotNull() & F.col("lead"), 1).otherwise(0)).alias("n_terms"))
    stats = groups.join(langs, "lang")
    # without any kept term N and V are 0; there is nothing to price then
    safe = stats.withColumn("n_terms", F.col("n_terms").cast("long")).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / block)).cast("int"))
    zero = F.col("n_terms") == 0
    return kept.join(safe, ["lang", "source"]).select(
        "lang", "source", "term", "n", "n_terms", "n_blocks", *[F.when(zero, F.lit(0).cast("long")).otherwise(e).alias(c) for c, e in (("p", _price("n", "in_group")), ("floor", _price("0", "in_group")), ("q", _price("total", "in_lang")))]
    )


SHARES = pa.schema([("lang", pa.string()), ("one", pa.string()), ("other", pa.string()), ("share", pa.int64())])


def _levels(counts: np.ndarray, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some groups: the one-hot matrix (terms x levels), the levels' prices, and where each group's levels begin."""
    columns, price, start = [], [], []
    for row, cost in zip(counts, prices):
        _, first, place = np.unique(row, return_index=True, return_inverse=True)
        start.append(sum(map(len, price)))
        columns.append(place + start[-1])
        price.append(cost[first])
    hot = np.zeros((counts.shape[1], sum(map(len, price))), np.float32)
    for c in columns:
        hot[np.arange(counts.shape[1]), c] = 1
    return hot, np.concatenate(price), np.array(start)


def _distances(counts: np.ndarray, prices: np.ndarray, groups: int, add: dict[tuple[int, int], np.ndarray]) -> None:
    """A block's shares for all pairs of groups, added to ``add`` by the places of their group blocks."""
    if not counts.shape[1]:
        return
    parts = {at: _levels(counts[at : at + groups], prices[at : at + groups]) for at in range(0, len(counts), groups)}
    for a, (hot, price, start) in parts.items():
        for b, (others, other_price, other_start) in parts.items():
            if a <= b:
                joint = (hot.T @ others).astype(np.int64)
                joint *= np.abs(price[:, None] - other_price[None, :])
                add[a, b] = add.get((a, b), 0) + np.add.reduceat(np.add.reduceat(joint, start, axis=0), other_start, axis=1)


def _pair_shares(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of lang and block -> shares of every pair of sources, once for each language of the task."""

    def finish() -> None:
        nonlocal sources
        rows = pa.Table.from_batches(pieces)
        pieces.clear()
        body, heads = rows.filter(pc.is_valid(rows["term"])), rows.filter(pc.is_null(rows["term"])).sort_by("source")
        sources = heads["source"].to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        words, column = np.unique(np.array(body["term"].to_pylist(), object), return_inverse=True)
        row = [place[s] for s in body["source"].to_pylist()]
        counts = np.zeros((len(sources), len(words)), np.int64)
        prices = np.repeat(np.asarray(heads["floor"], np.int64)[:, None], len(words), axis=1)
        counts[row, column], prices[row, column] = np.asarray(body["n"]), np.asarray(body["p"])
        _distances(counts, prices, groups, shares)

    def given(lang: str) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(sources), groups):
            for b in range(a, len(sources), groups):
                found = shares.get((a, b))
                pairs = [(lang, one, other, 0 if found is None else int(found[i, j])) for i, one in enumerate(sources[a : a + groups]) for j, other in enumerate(sources[b : b + groups]) if a + i < b + j]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs), SHARES)], schema=SHARES)
        shares.clear()

    pieces: list[pa.RecordBatch] = []
    shares: dict[tuple[int, int], np.ndarray] = {}
    sources: list[str] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for at, end in zip(cuts, cuts[1:]):
            if now is not None and keys[at] != now:
                finish()
                if keys[at][0] != now[0]:
                    yield from given(now[0])
            now = keys[at]
            pieces.append(batch.slice(at, end - at))
    if now is not None:
        finish()
        yield from given(now[0])


def pair_distances(price: DataFrame, groups: int = GROUPS) -> DataFrame:
    """lang, one, other (one before other), value: the sum of |p - q| over the kept terms of the language."""
    block = F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int")
    body = price.where("term is not null").select("lang", block.alias("block"), "source", "term", "n", "p", "floor")
    heads = price.where("term is null").select("lang", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "source", "term", "n", "p", "floor")
    dealt = body.unionByName(heads).repartition("lang", "block").sortWithinPartitions("lang", "block")
    return dealt.mapInArrow(partial(_pair_shares, groups=groups), "lang string, one string, other string, share long").groupBy("lang", "one", "other").agg(F.sum("share").alias("value"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, groups: int = GROUPS, flush: int = FLUSH) -> DataFrame:
    """Both parts: ``pair`` (all other sources of the language, by distance) and ``term`` (the group's most typical terms)."""
    price = materialize(priced(materialize(kept_counts(docs, min_docs, flush), "kept"), block), "priced")
    pairs = pair_distances(price, groups)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("one").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    listed = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    typical = price.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = both.withColumn("rank", F.row_number().over(listed)).withColumn("part", F.lit("pair"))
    best = typical.withColumn("rank", F.row_number().over(listed)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return ranked.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {min_docs}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (kept.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM grid WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


ORACLE = oracle()
