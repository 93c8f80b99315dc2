"""Every registered query that has SQL agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from chalkline.operators.held import cut
from chalkline.plans import lessons_queries, topics_queries

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return str([plain(x) for x in v])
    if pd.isna(v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module", autouse=True)
def judged_once():
    """Topic and lesson queries begin with the same lexical evidence and judged candidates; here these are made once."""
    made, patch = {}, pytest.MonkeyPatch()

    def once(name, make):
        def held(spark, d):
            if (name, d) not in made:
                made[name, d] = cut(make(spark, d))
            return made[name, d]

        return held

    for name in ("lexical", "candidates", "judged", "_sem"):
        held = once(name, getattr(topics_queries, name))
        for module in (topics_queries, lessons_queries):
            if hasattr(module, name):
                patch.setattr(module, name, held)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert table(QUERIES[name](spark, sf_dir).toPandas()) == table(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLES) <= set(QUERIES)
