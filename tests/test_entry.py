"""Driver contract: entry runs, and every registered query agrees with its
DuckDB oracle on the smallest tables (row count, columns and values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tillwise.plans.oracle import NOT_SQL
from tillwise.plans.oracle import oracle_sql as core_oracle
from tillwise.plans.registry import queries as core_queries

from conftest import SF_SMALL

TABLES = ["nation", "customer", "part", "orders", "lineitem", "events"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["Segment", "count"]
    assert sum(r["count"] for r in rows) > 0


def test_every_query_has_an_oracle():
    assert set(core_queries()) == set(core_oracle()) | set(NOT_SQL) and not set(core_oracle()) & set(NOT_SQL)
    assert set(core_queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(core_oracle()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols, d_rows = [c[0] for c in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _canon(s_cols, s_rows) == _canon(d_cols, d_rows)


def test_forest_queries_return_its_predictions_and_metrics(spark):
    """No SQL grows a forest: its rows are compared with the split and the labels, its metrics with its own predictions."""
    from tillwise.operators.models import binary_metrics, exact_split
    q = core_queries()
    rows = {r["CustomerID"]: r for r in q["ch8_churn_predictions"](spark, SF_SMALL).collect()}
    labels = {r["CustomerID"]: r for r in q["ch5_features"](spark, SF_SMALL).collect()}
    split = {r["CustomerID"] for r in q["ch6_split"](spark, SF_SMALL).where("is_test").collect()}
    assert set(rows) == split and len(split) == math.ceil(0.2 * len(labels))
    assert all(r["Churn"] == labels[c]["Churn"] and r["prediction"] in (0.0, 1.0) and 0 <= r["score"] <= 1 and (r["prediction"] == 1.0) == (r["score"] > 0.5)
               for c, r in rows.items())
    for name in ("ch9_13_metrics_model", "ch9_13_metrics_leak_free"):
        m = q[name](spark, SF_SMALL).collect()
        assert len(m) == 1 and all(0 <= m[0][c] <= 1 for c in ("accuracy", "precision", "recall", "f1"))
