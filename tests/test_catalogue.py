"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__
from thalweg.plans.catalogue import ORACLES, QUERIES

#: Searches and replicate simulations take many jobs each; the driver runs them, here one stands for each kind.
SLOW = {"incidence_by_search", "genetic_search", "evaluate_refined", "mlpe_reference_labels", "curve_heat_map", "best_per_variable"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def key(row, columns):
    def plain(v):
        return None if v is None else round(v, 4) + 0.0 if isinstance(v, float) else v

    return repr([plain(v) for _, v in sorted(zip(columns, row))])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    expected = found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert sorted(key(r, df.columns) for r in rows) == sorted(key(r, columns) for r in expected)


def test_entry_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_library_does_not_import_the_corpus_operators():
    for path in glob.glob(os.path.join(os.path.dirname(__file__), "..", "thalweg", "**", "*.py"), recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", open(path).read(), re.M), path
