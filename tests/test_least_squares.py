"""Least squares on dependent features, the exact split, and the area under the curve, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.functions.least_squares import least_squares
from tillwise.functions.prefix import running_totals
from tillwise.operators import models as M


def table(spark, x, y, parts=5):
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return cols, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(parts)


def plain(x, y):
    """Least norm on centred columns, as the common libraries fit it."""
    return np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]


def dependent(rng, n=3000):
    r, f, m = rng.integers(1, 6, (3, n)).astype(float)
    money = rng.gamma(2.0, 40_000.0, n)
    return np.column_stack([rng.integers(0, 700, n), f * 3 + rng.integers(0, 9, n), money, r, f, m, 100 * r + 10 * f + m])


def test_dependent_features_have_the_coefficients_of_least_norm(spark):
    rng = np.random.default_rng(1)
    x = dependent(rng)
    y = x @ np.array([1.5, -20.0, 0.3, 7.0, 1.0, 2.0, 0.5]) + rng.normal(0, 50, len(x))
    cols, df = table(spark, x, y)
    fit = least_squares(df, cols, "y")
    want = plain(x, y)
    assert fit.rank == 6 and fit.rows == len(x)
    assert np.allclose(fit.coefficients, want, rtol=1e-7, atol=1e-9)
    got = np.array([r[0] for r in df.select(fit.value()).collect()])
    xs = np.array(df.select(*cols).collect())
    assert np.abs(got - (y.mean() + (xs - x.mean(0)) @ want)).max() < 1e-5
    assert abs(fit.intercept - (y.mean() - x.mean(0) @ want)) < 1e-4


def test_a_target_among_the_features_is_met_to_the_last_digits(spark):
    x = dependent(np.random.default_rng(2))
    cols, df = table(spark, x, x[:, 2])
    fit = least_squares(df, cols, "y")
    worst = df.select(F.max(F.abs(fit.value() - F.col("y")))).first()[0]
    assert worst < 1e-7


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_scales_do_not_decide_the_rank(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 3)) * [scale, 1.0, 1e6] + [0, 5, 1e9]
    y = x @ np.array([2.0 / scale, 1.0, 1e-6]) + 3
    cols, df = table(spark, x, y)
    fit = least_squares(df, cols, "y")
    assert fit.rank == 3 and df.select(F.max(F.abs(fit.value() - F.col("y")))).first()[0] < 1e-5


def test_constant_repeated_and_few_rows(spark):
    x = np.column_stack([np.full(40, 0.1), np.arange(40.0), np.arange(40.0)])
    cols, df = table(spark, x, 2 * np.arange(40.0) + 1)
    fit = least_squares(df, cols, "y")
    assert fit.rank == 1 and fit.coefficients[0] == 0 and np.allclose(fit.coefficients[1:], 1)
    cols, df = table(spark, np.array([[1.0, 2.0]]), np.array([7.0]))
    one = least_squares(df, cols, "y")
    assert one.rank == 0 and one.base == 7.0
    cols, df = table(spark, np.array([[1.0, 2.0, 4.0], [3.0, 5.0, 1.0]]), np.array([7.0, 9.0]))
    two = least_squares(df, cols, "y")
    assert two.rank == 1 and np.allclose(two.coefficients, plain(np.array([[1.0, 2.0, 4.0], [3.0, 5.0, 1.0]]), np.array([7.0, 9.0])))


def test_missing_values_and_no_rows_are_errors(spark):
    _, df = table(spark, np.array([[1.0], [np.nan]]), np.array([1.0, 2.0]))
    with pytest.raises(ValueError, match="missing values in x0"):
        least_squares(df, ["x0"], "y")
    with pytest.raises(ValueError, match="no rows"):
        least_squares(df.limit(0), ["x0"], "y")


def test_predictions_are_null_where_a_feature_is_missing(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(9)], "CustomerID long, a double, CLV double")
    model = M.train_clv(df, ["a"])
    holes = df.withColumn("a", F.when(F.col("CustomerID") % 2 == 0, F.col("a")))
    got = {r["CustomerID"]: r["prediction"] for r in M.predict(model, holes, label="CLV").collect()}
    assert all((got[i] is None) == bool(i % 2) and (i % 2 or abs(got[i] - 2 * i) < 1e-12) for i in range(9))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 15, 101, 5000])
def test_split_has_exactly_its_share(spark, n):
    df = spark.range(n).withColumnRenamed("id", "CustomerID")
    want = {int(i) for i in sorted(map(str, range(n)), key=lambda i: (__import__("hashlib").md5(f"{i}:42".encode()).hexdigest(), i))[:-(-n // 5)]}
    got = {r[0] for r in M.exact_split(df.repartition(3)).where(M.IS_TEST).select("CustomerID").collect()}
    assert got == want and len(got) == math.ceil(n / 5)


def test_split_of_odd_tables(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (1,)], "CustomerID long")
    marked = M.exact_split(df, test_fraction=0.5).collect()
    assert len(marked) == 4 and len({r["is_test"] for r in marked if r["CustomerID"] == 1}) == 1  # a key stays on one side
    assert M.exact_split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.exact_split(df, test_fraction=1.0)


def pairs(y, s):
    p, n = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])


@pytest.mark.parametrize("levels", [1, 3, 50, 10_000])
def test_area_under_the_curve_counts_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    y = rng.integers(0, 2, 700)
    s = np.round((rng.normal(0, 1, 700) + y) * levels) / levels
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "Churn int, score double").repartition(4)
    assert abs(M.roc_auc(df).first()[0] - pairs(y, s)) < 1e-12


def test_area_of_one_class_and_of_missing_scores(spark):
    assert M.roc_auc(spark.createDataFrame([(1, 0.5), (1, 0.1)], "Churn int, score double")).first()[0] is None
    with pytest.raises(Exception, match="without a score"):
        M.roc_auc(spark.createDataFrame([(1, 0.5), (0, None)], "Churn int, score double")).first()


def test_forest_probabilities_order_its_rows(spark):
    """Two clouds that a threshold on one feature parts: predictions, probabilities and metrics are known."""
    rows = [(i, float(i % 40) + 100 * (i % 2), float(i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "CustomerID long, a double, b double, Churn int")
    parts = M.exact_split(df)
    pred = M.predict(M.train_churn(parts.where(~F.col(M.IS_TEST)), ["a", "b"], num_trees=20, max_depth=5), parts.where(M.IS_TEST), label="Churn", score="score")
    got = pred.collect()
    assert len(got) == 80 and all(r["prediction"] == r["Churn"] and (r["score"] > 0.5) == (r["Churn"] == 1) for r in got)
    m = M.binary_metrics(pred).first()
    assert m["accuracy"] == m["precision"] == m["recall"] == m["f1"] == m["roc_auc"] == 1.0 and M.roc_auc(pred).first()[0] == 1.0


def test_forest_on_the_leaking_features(spark):
    """Recency decides the label, so a forest of the reference's size has next to nothing to get wrong on 300 rows."""
    rng = np.random.default_rng(5)
    rows = [(i, int(r := rng.integers(0, 400)), int(rng.integers(1, 30)), float(rng.gamma(2, 500)), int(r > 90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "CustomerID long, Recency int, Frequency int, Monetary double, Churn int")
    parts = M.exact_split(df)
    assert parts.where(M.IS_TEST).count() == 300
    cols = ["Recency", "Frequency", "Monetary"]
    pred = M.predict(M.train_churn(parts.where(~F.col(M.IS_TEST)), cols), parts.where(M.IS_TEST), label="Churn", score="score")
    m = M.binary_metrics(pred).first()
    assert min(m["accuracy"], m["precision"], m["recall"], m["f1"]) >= 0.98 and M.roc_auc(pred).first()[0] >= 0.99


def test_running_totals(spark):
    rng = np.random.default_rng(7)
    rows = [("a" if i % 3 else None, float(rng.integers(0, 900)), int(rng.integers(0, 5))) for i in range(4000)] + [("hot", 1.0, 1)] * 500
    out = running_totals(spark.createDataFrame(rows, "g string, v double, w long").repartition(6), "v", ["w"], by=["g"]).collect()
    for g in (None, "a", "hot"):
        mine = sorted((r["v"], r["w"], r["w_before"], r["w_all"]) for r in out if r["g"] == g)
        before, total = 0, sum(w for k, _, w in rows if k == g)
        assert len({v for k, v, _ in rows if k == g}) == len(mine)
        for v, w, b, a in mine:
            assert (w, b, a) == (sum(x for k, u, x in rows if k == g and u == v), before, total)
            before += w
