"""Exact quantiles and quantile bins against numpy / pandas on random data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions.scalars import attach_scalars
from tillwise.functions.quantiles import bin_by_edges, exact_quantiles, qcut_probs, quantile_edges


def _frame(spark, values, groups=None):
    pdf = pd.DataFrame({"v": values})
    if groups is not None:
        pdf["g"] = groups
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_matches_numpy_bitwise(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 400))
    values = np.round(rng.lognormal(3, 1.5, n), 2)
    values[rng.random(n) < 0.3] = 7.0  # a hot value
    probs = [0.0, 0.1, 0.25, 0.5, 0.6000000000000001, 0.75, 0.99, 1.0]
    got = exact_quantiles(_frame(spark, values), "v", probs).first()
    want = np.percentile(values, np.array(probs) * 100.0)
    assert got["n"] == n
    assert list(got["q"]) == list(want)


def test_grouped_and_weighted(spark):
    rng = np.random.default_rng(5)
    vals = rng.integers(0, 30, 500).astype(float)
    grp = rng.choice(["a", "b", "c"], 500, p=[0.7, 0.2, 0.1])
    res = {r["g"]: list(r["q"]) for r in
           exact_quantiles(_frame(spark, vals, grp), "v", [0.25, 0.5, 0.75], by=["g"]).collect()}
    for g in "abc":
        assert res[g] == list(np.percentile(vals[grp == g], [25, 50, 75]))
    # weighted input (pre-aggregated) gives the same answer as the expanded rows
    pdf = pd.DataFrame({"v": vals}).value_counts().rename("w").reset_index()
    wq = exact_quantiles(spark.createDataFrame(pdf), "v", [0.25, 0.5, 0.75], weight="w").first()["q"]
    assert list(wq) == list(np.percentile(vals, [25, 50, 75]))


def test_missing_values_ignored_and_empty(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, None, float("nan"), 3.0]}))
    assert list(exact_quantiles(df, "v", [0.5]).first()["q"]) == [2.0]
    empty = df.where(F.col("v") > 100)
    assert [(r.n, r.q) for r in exact_quantiles(empty, "v", [0.5]).collect()] == [(0, [None])]
    assert exact_quantiles(empty.withColumn("g", F.lit(1)), "v", [0.5], by=["g"]).count() == 0


@pytest.mark.parametrize("values", [
    [1, 1, 1, 1, 1, 2, 3, 9],             # three bins after dropping repeated edges
    list(range(1, 101)),                   # five bins
    [1, 1, 1, 1, 2, 4] * 20,               # two bins
    [5.5, 1.25, 3.0, 3.0, 2.0, 8.0, 13.0, 0.5, 2.0, 2.0, 21.0],
])
@pytest.mark.parametrize("reverse", [False, True])
def test_bins_match_qcut(spark, values, reverse):
    s = pd.Series(values, dtype=float)
    codes, bins = pd.qcut(s, 5, labels=False, retbins=True, duplicates="drop")
    b = len(bins) - 1
    want = [(b - c if reverse else c + 1) for c in codes]
    df = _frame(spark, s.values).withColumn("id", F.monotonically_increasing_id())
    edges = quantile_edges(df, "v", 5, out="e")
    got = (df.crossJoin(edges).withColumn("k", bin_by_edges(F.col("v"), F.col("e"), 6, reverse))
             .orderBy("id").select("k").toPandas()["k"].tolist())
    assert got == want


def test_all_equal_column_gives_null(spark):
    df = _frame(spark, [4.0] * 10)
    edges = quantile_edges(df, "v", 5, out="e")
    got = df.crossJoin(edges).select(bin_by_edges(F.col("v"), F.col("e"), 6).alias("k")).collect()
    assert all(r["k"] is None for r in got)


def test_qcut_probs_follow_linspace():
    assert qcut_probs(5) == [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]


def test_null_group_key_is_a_group(spark):
    pdf = pd.DataFrame({"g": ["a", None, None, "a", None], "v": [1.0, 2.0, 4.0, 3.0, 6.0]})
    res = {r["g"]: list(r["q"]) for r in
           exact_quantiles(spark.createDataFrame(pdf), "v", [0.5], by=["g"]).collect()}
    assert res == {"a": [2.0], None: [4.0]}


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_ranks_do_not_rest_on_a_reused_exchange(spark, parts):
    """A million distinct values, no exchange reuse, no coalescing: the ranks are the same."""
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    old = {k: spark.conf.get(k) for k in conf}
    n = 1_000_003
    df = spark.range(n).select(((F.col("id") * 48271) % n / 7.0).alias("v"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = exact_quantiles(df, "v", [0.25, 0.5, 0.75, 0.875]).first()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got["n"] == n
    assert list(got["q"]) == list(np.percentile(np.arange(n) / 7.0, [25, 50, 75, 87.5]))


def test_no_values_is_one_row_without_groups(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert [(r.n, r.q) for r in exact_quantiles(df, "v", [0.5]).collect()] == [(0, [None])]


def test_scalars_must_be_one_row(spark):
    df = spark.range(3)
    assert attach_scalars(df, spark.createDataFrame([(7,)], "x long")).count() == 3
    for rows in ([], [(1,), (2,)]):
        with pytest.raises(Exception, match="one row"):
            attach_scalars(df, spark.createDataFrame(rows, "x long")).collect()


def test_buckets_are_found_without_lambdas(spark):
    """A bucket search that whole-stage code does not run costs microseconds a value."""
    from tillwise.functions.quantiles import SPLITS, _count_below
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 63, 64, 65, 400, SPLITS - 1):
        splits = np.unique(rng.integers(0, 2000, 4 * n + 1).astype(float))[:n]
        values = np.concatenate((rng.integers(-5, 2005, 300).astype(float), splits))
        df = spark.createDataFrame([(float(v), splits.tolist()) for v in values] + [(float("nan"), splits.tolist()), (None, splits.tolist())], "v double, s array<double>")
        got = df.select("v", _count_below(F.col("s"), F.col("v")).alias("b"))
        assert [r["b"] for r in got.collect()] == [*np.searchsorted(splits, values, "left").tolist(), len(splits), 0]
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
