"""Every query of the catalogue against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerscope.plans.catalogue import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert len(columns) == len(set(columns))
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_is_imported_by_nothing_else():
    root = Path(__file__).resolve().parents[1] / "ledgerscope"
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "ledgerscope.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text()


def test_latest_is_limited_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["latest_score_per_company"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate" in plan
