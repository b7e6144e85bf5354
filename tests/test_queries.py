"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from quadrille import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r[c] for c in cols) for r in df.collect()]
    if name not in queries.ORACLES:
        assert rows
        return
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]

    def key(row):
        return tuple(v.isoformat() if isinstance(v, datetime.datetime) else repr(v) for v in row)

    assert sorted(map(key, rows)) == sorted(map(key, want))


#: Plans that may hold a nested loop: one side has one row, or rows without a variable go with all others.
LOOPS = {"vkg_optional_chain", "kg_optional_then_join", "kg_snapshot_roundtrip", "er_bands_counts", "er_topk_blocking", "bitemporal_asof", "text_search", "files_versions"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - LOOPS))
def test_plan_has_no_cross_join(name, spark):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_identity_spreads_brands_of_all_parts(spark, tmp_path):
    rows = [(1, "Red Bolt", "A"), (500, "red bolt", "B"), (501, "red-bolt", "B"), (502, "other", "C")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["same_as_closure"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "B"), (500, "A"), (501, "A")]


def test_derived_key_join_is_whole(spark, tmp_path):
    n = 100_001
    for name, key, label in (("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name")):
        spark.range(n).selectExpr(f"id AS {key}", f"lpad(id, 9, '0') AS {label}").write.parquet(f"{tmp_path}/{name}.parquet")
    assert queries.QUERIES["sql_derived_key_join"](spark, str(tmp_path)).count() == n


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
