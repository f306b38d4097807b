"""Every query with SQL against another engine, over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from siltstone.operators import order, rules, symbols
from siltstone.plans import join_queries  # noqa: F401
from siltstone.plans import queries as tables  # noqa: F401
from siltstone.plans import registry as queries
from siltstone.plans import source_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def rows(frame):
    d = frame[sorted(frame.columns)].astype(object)
    d = d.where(d.notna(), None)
    return sorted(tuple(f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in d.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, db, name):
    assert rows(queries.QUERIES[name](spark, FOLDER).toPandas()) == rows(db.execute(queries.SQL[name]).df())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_flagship_scans_once(spark):
    """Hits are read three times; the documents behind them are searched once, and no finding goes through the driver."""
    plan = queries.QUERIES["flagship"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Broadcast" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pattern_summary_scans_once(spark):
    """Hits are counted and their first files found from what is stored; pages are searched once."""
    plan = queries.QUERIES["pattern_summary"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "pages.parquet" not in plan


def test_lookups_without_a_broadcast(spark, tmp_path):
    """Types, methods and the names that are looked for are dealt out by key, however small their tables are on disk."""
    spark.range(30).selectExpr("id AS c_custkey", "id % 5 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = queries.QUERIES["method_lookups"](spark, str(tmp_path))
    assert Counter(r.how for r in found.collect()) == {"by name": 30, "by class": 20, "endpoint": 30, "verb": 30, "file": 3, "class": 30}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_candidates_without_a_broadcast_of_rows(spark, tmp_path, monkeypatch):
    """Hits, spans and counts of files are dealt out by key; what is broadcast is a row per range."""
    spark.range(30).selectExpr("id AS c_custkey", "id % 5 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    met = []

    def kept(df, name, keep=order.stored):
        df.collect()
        met.append(df)
        return keep(df, name)

    for module in (order, rules, symbols, source_queries):
        monkeypatch.setattr(module, "stored", kept)
    assert queries.QUERIES["source_candidates"](spark, str(tmp_path)).count() == 120
    joined = [x for d in met for x in d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x]
    assert joined and not [x for x in joined if "Broadcast" in x and "run_part" not in x]
