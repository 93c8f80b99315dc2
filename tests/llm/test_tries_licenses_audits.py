"""Operators 11 to 13 against plain versions, on tables with nulls, ties, repeats, long values and clashing names."""

import hashlib
import random
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chalkline.llm import divergence, licenses, prefix_trie
from tests.llm.fixture import SCHEMA, documents, texts
from tests.test_queries import table


def by_sql(sql, frame, name="documents"):
    con = duckdb.connect()
    con.register("given", frame)
    con.execute(f"create table {name} as select * from given")
    return con.execute(sql).df()


# 11
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, x string, part string, owner double"


def conversations(seed, n=60, longest=14):
    """Shared first turns, whole copies, prefixes of others, null turns, roles and texts; some ids have no lead."""
    rng = random.Random(seed)
    known, rows = [], []
    for c in rng.sample(range(-40, 400), n):
        kind = rng.random()
        if known and kind < 0.6:
            own = list(rng.choice(known)[: rng.randrange(1, longest)])
        else:
            own = []
        while len(own) < 1 or rng.random() < 0.6:
            own.append((rng.choice(["user", "assistant", None]), rng.choice(["hi", "é…", "", None, "long " * 50, "bye"])))
        known.append(own)
        first = [None] if rng.random() < 0.2 else [0]
        rows += [(c, (first + list(range(1, len(own))))[i], role, text) for i, (role, text) in enumerate(own)]
    return rows


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        rest = c % 5 if c >= 0 else -(-c % 5)
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = ts if rest == 0 else own.get(c - rest, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)

    def below(s):
        saved = (len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        found = [below(k) for k in children.get(s, [])]
        return saved + sum(f[0] for f in found), sum(f[1] for f in found) or 1

    out = []
    for s, members in nodes.items():
        saved, leaves = below(s)
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(s))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    got = prefix_trie.trie_nodes(df)
    assert got.columns == NODES
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "x", None, 0.5) for r in rows + [(None, 1, "user", "hi")]], CONVERSATIONS)
    assert trie(df) == plain_trie(rows)


def test_trie_of_empty_table_and_turnless_conversations(spark):
    assert trie(spark.createDataFrame([], CONVERSATIONS)) == []
    lone = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie(spark.createDataFrame([(lone, 0, "user", "hi", 1, "", "", 0.0)], CONVERSATIONS)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_of_one_long_conversation_and_many_copies(spark):
    """A conversation of half of all turns lies in several parts; 3,000 copies end at one node."""
    long = [(0, i, "user", f"turn {i}") for i in range(6000)]
    copies = [(10_000 + 5 * i, t, "user", ["turn 0", "same"][t]) for i in range(3000) for t in range(2)]
    df = spark.createDataFrame([(*r, 1, "x", None, 0.5) for r in long + copies], CONVERSATIONS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few turns are one part
    try:
        placed, _ = prefix_trie.placed_turns(df)
        assert placed.where("conv_id = 0").select("part").distinct().count() > 1
        got = prefix_trie.trie_nodes(df).toPandas().set_index(["conv_id", "depth"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ids = ",".join(str(10_000 + 5 * i) for i in range(3000))
    assert len(got) == 6002 and got.loc[(10_000, 2)].ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()
    assert got.loc[(0, 1)].n_convs == 3001 and got.loc[(0, 1)].n_leaves == 2 and got.loc[(0, 0)].saved_tokens == 3000 * 6 + 2999 * 4


def test_ties_and_repeated_turns_have_one_order(spark):
    rows = [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, None, "z", None), (10, 1, "user", "a"), (10, None, "z", ""), (10, 1, "user", "a"), (10, 1, "user", "b")]
    df = spark.createDataFrame([(*r, 1, "x", None, 0.5) for r in rows], CONVERSATIONS)
    assert {r[3] for r in trie(df)} == {2} and len(trie(df)) == 5


# 12
NOTICE = licenses.NOTICES[0].text


def license_texts():
    words = NOTICE.split()
    prose = ("ein text ohne alles " * 60).strip()
    return [
        None, "", " \n", "MIT License", "mit\nLICENSE, mit-license mit licenses", "GNU General Public License v3 under the Apache License", NOTICE.upper(), f"{prose} {NOTICE} {prose}", " ".join(words[4:]), " ".join(words[12:]),
        f"{prose}\n" + "\n".join(words) + f"\n{prose}", "licence mit", "ÉMIT license", "mit license " * 3000, "license " * 5000, "general public " * 200 + "license", "x" * 100_000, prose * 50 + " mit license", "Licensed under CC BY-NC 4.0.", "mit license",
    ]


def license_documents(spark):
    rows = [(i * 3, t, "en", "a", 1, "k", 1, 0.5, "l", "c", b"t") for i, t in enumerate(license_texts() + texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "mit license", None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize("step, threshold", [(licenses.STEP, licenses.THRESHOLD), (16, 0.5), (30, 1.0)])
def test_license_blocks_against_all_blocks(spark, step, threshold, monkeypatch):
    docs = license_documents(spark)
    scan = licenses.scan_licenses
    monkeypatch.setattr(licenses, "scan_licenses", lambda d: scan(d, threshold=threshold, step=step))
    assert table(licenses.license_labels(docs).toPandas()) == table(by_sql(licenses.oracle(threshold=threshold, step=step), docs.select("doc_id", "text").toPandas()))


def test_license_labels_of_known_texts(spark):
    got = {r.doc_id: r for r in licenses.license_labels(license_documents(spark)).collect()}
    at = {t: i * 3 for i, t in reversed(list(enumerate(license_texts())))}
    assert got[at[NOTICE.upper()]].labels == "mit" and got[at[NOTICE.upper()]].n_base == 0 and got[at[NOTICE.upper()]].score == 1.0
    assert got[at["mit license " * 3000]].n_base == 3000 and got[at["mit license " * 3000]].last_word == 5998
    both = got[at["GNU General Public License v3 under the Apache License"]]
    assert (both.base_labels, both.first_word, both.last_word) == ("apache,gpl", 1, 7)
    none = got[at[None]]
    assert (none.n_words, none.n_base, none.first_word, none.base_labels, none.labels, none.score) == (0, 0, None, "", "", 0.0)


def test_license_scan_keeps_columns_and_empty_tables(spark):
    docs = license_documents(spark).withColumn("license_words", F.lit("mine")).withColumn("a.b", F.lit(1))
    got = licenses.scan_licenses(docs)
    assert got.columns == [*[c for c in docs.columns if c != "license_words"], "license_words", "license_places", "license_blocks"] and got.count() == docs.count()
    assert licenses.license_labels(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, phrases=()).where("size(license_places) > 0").count() == 0 and licenses.scan_licenses(docs, notices=()).where("size(license_blocks) > 0").count() == 0


def test_license_scan_is_linear_in_a_text(spark):
    began = time.time()
    got = licenses.license_labels(spark.createDataFrame([(1, "mit license " * 100_000), (2, "a " * 500_000), (3, "sublicense" * 100_000)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_base for r in got} == {1: 100_000, 2: 0, 3: 0} and time.time() - began < 60


# 13
def audited(spark, seed=5):
    rng = random.Random(seed)
    names = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "été", "straße", "ǅ"]
    rows = []
    for i in range(400):
        text = rng.choice([None, "", " ".join(rng.choice(names[: rng.choice([5, 40, 124])]).upper() for _ in range(rng.randrange(60)))])
        rows.append((i % 350, text, rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s1", "s2", None, "", *(f"u{j}" for j in range(20))]), 1, "term", 1, 0.5, "p", "q", b"n"))
    rows += [(900, "lonely words", "xx", "only", 1, "", 1, 0.5, "", "", b""), (901, None, "yy", "a", 1, "", 1, 0.5, "", "", b""), (902, "few", "yy", "b", 1, "", 1, 0.5, "", "", b""), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("min_docs, top, block, groups, flush", [(30, 50, 200, 8, 300_000), (3, 7, 10, 3, 40), (1, 50, 1000, 100, 1)])
def test_audit_against_sql(spark, min_docs, top, block, groups, flush):
    docs = audited(spark)
    got = divergence.audit_sources(docs, min_docs, top, block, groups, flush).toPandas()
    assert table(got) == table(by_sql(divergence.oracle(min_docs, top), docs.select("lang", "source", "text").toPandas()))
    assert len(got[got["lang"] == "yy"]) >= 2 and not len(got[(got["lang"] == "xx") & (got["part"] == "pair")])


def test_audit_of_empty_tables_and_hostile_texts(spark):
    docs = documents(spark)
    assert divergence.audit_sources(docs.limit(0)).count() == 0
    assert divergence.audit_sources(docs, min_docs=1000).where("value <> 0 or part <> 'pair'").count() == 0
    big = spark.createDataFrame([(i, "word " * 200_000 + "x" * i, "en", f"s{i % 2}") for i in range(4)], "doc_id long, text string, lang string, source string")
    assert divergence.audit_sources(big, min_docs=2).where("part = 'pair' and value = 0").count() == 2


def test_prices_of_counts_beyond_long_products(spark):
    kept = spark.createDataFrame([("en", "a", None, 0, 0, True), ("en", "a", "big", 9 * 10**15, 9 * 10**15, True), ("en", "a", "small", 1, 1, True)], "lang string, source string, term string, n long, total long, lead boolean")
    total = 9 * 10**15 + 1
    assert {r.term: r.p for r in divergence.priced(kept).collect() if r.term} == {t: 1 + 10**9 * (n + 5) // (total + 10) for t, n in (("big", 9 * 10**15), ("small", 1))}
