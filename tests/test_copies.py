"""Copies by fingerprints, the IQR cascade's fences, and running totals' odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.functions import fingerprints as FP
from tillwise.functions.cascade import cascade_fences, within
from tillwise.operators import cleaning as C
from tillwise.sources.testdata import dirty_lines, table

SF_SMALL = "/root/testdata/sf0.001"

SCHEMA = "a string, b string, x double, n long"


def rows():
    out = [(f"k{i % 50}", None if i % 3 else "v", float(i % 7), i % 11) for i in range(600)]
    return out + [("hot", "v", 1.0, 1)] * 700 + [(None, "a", None, None), ("a", None, None, None), (None, None, None, None)] * 2 \
        + [("z", "z", float("nan"), 0)] * 3 + [("z", "z", 0.0, 0), ("z", "z", -0.0, 0)]


def plain(df):
    return sorted(map(str, df.dropDuplicates().collect()))


@pytest.mark.parametrize("most", [FP.MAX_BROADCAST, 0])
@pytest.mark.parametrize("of", [FP.fingerprint, lambda df: (F.lit(1).cast("long"), F.coalesce(F.length("a"), F.lit(0)).cast("long"))], ids=["hash", "clash"])
def test_distinct_rows_equal_plain_ones(spark, of, most):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    assert sorted(map(str, FP.distinct_rows(df, of, most).collect())) == plain(df)
    assert FP.repeated_rows(df, of, most).first()[0] == len(rows()) - df.dropDuplicates().count()


def test_rows_without_copies_and_no_rows(spark):
    df = spark.range(100).withColumn("t", F.lit("x"))
    assert FP.distinct_rows(df).count() == 100 and FP.repeated_rows(df).first()[0] == 0
    none = df.limit(0)
    assert FP.distinct_rows(none).count() == 0 and FP.repeated_rows(none).first()[0] == 0


def test_nulls_in_other_columns_are_other_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert df.select(*[c.alias(f"c{i}") for i, c in enumerate(FP.fingerprint(df))]).distinct().count() == 2


def test_few_bytes_are_shuffled_for_wide_rows(spark):
    """The exchange that counts fingerprints carries two longs and a count, whatever the width of the rows."""
    df = spark.range(1000).withColumns({f"c{i}": F.repeat(F.lit("x"), 500) for i in range(6)})
    high, low = FP.fingerprint(df)
    plan = df.withColumns({"h": high, "l": low}).groupBy("h", "l").count()._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "hashpartitioning" in line)
    assert "c0" not in exchange


def brute_fences(data, cols, k=1.5):
    out = {}
    for c in cols:
        kept = [r for r in data if all(lo <= r[x] <= hi for x, (lo, hi) in out.items())]
        q1, q3 = np.percentile([r[c] for r in kept], [25, 75])
        out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cascade_fences(spark, seed):
    rng = np.random.default_rng(seed)
    data = [{"a": float(np.round(rng.standard_cauchy(), seed)), "b": float(rng.gamma(1, 50)), "c": float(rng.integers(0, 5))} for _ in range(2500)]
    df = spark.createDataFrame([tuple(d.values()) for d in data], "a double, b double, c double").repartition(7)
    assert cascade_fences(df, ["a", "b", "c"]) == brute_fences(data, ["a", "b", "c"])
    assert cascade_fences(df, ["c", "a"]) == brute_fences(data, ["c", "a"])


def test_cascade_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None)], "a double, b double")
    fences = cascade_fences(df, ["a", "b"])
    assert fences["a"] == (0.5, 2.5) and fences["b"] == (None, None)
    assert df.where(within(fences)).count() == 0 and df.where(within({"a": fences["a"]})).count() == 2
    assert cascade_fences(df.limit(0), ["a"]) == {"a": (None, None)}


def test_fences_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS Quantity", "CAST(id % 9 AS DOUBLE) AS UnitPrice").write.parquet(str(tmp_path / "t"))
    out = C.iqr_cascade(spark.read.parquet(str(tmp_path / "t")))
    assert "GreaterThanOrEqual(Quantity" in out._jdf.queryExecution().executedPlan().toString()


def test_many_copies_are_compared_once(spark):
    """With more repeated fingerprints than are broadcast, the shuffle of whole rows runs once, not for each reader of the result."""
    df = FP.distinct_rows(spark.createDataFrame(rows(), SCHEMA).repartition(6), max_broadcast=0)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_dirty_lines_take_one_join(spark):
    lines = dirty_lines(spark, SF_SMALL)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 5  # five tables, each once
    keys = table(spark, SF_SMALL, "lineitem").select("l_orderkey")
    twice = lines.groupBy(F.col("InvoiceNo").cast("long").alias("k")).count()
    want = keys.groupBy(F.col("l_orderkey").alias("k")).agg((F.count("*") * F.when(F.col("k") % 53 == 0, 2).otherwise(1)).alias("n"))
    assert twice.join(want, "k", "full").where("count IS NULL OR n IS NULL OR count != n").count() == 0
