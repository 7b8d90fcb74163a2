"""Split, metrics and model fits."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import models as M
from tillwise.operators import rfm as R
from tillwise.operators.customers import with_clv
from tillwise.sources.testdata import retail_lines

from conftest import SF_SMALL


def test_hash_split_is_deterministic_and_about_a_fifth(spark):
    cust = R.rfm(retail_lines(spark, SF_SMALL))
    a = M.hash_split(cust).where(F.col("is_test")).select("CustomerID")
    b = M.hash_split(cust.repartition(3)).where(F.col("is_test")).select("CustomerID")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    share = a.count() / cust.count()
    assert 0.1 < share < 0.3
    assert M.split_threshold(0.2) == "3" * 32


def test_binary_metrics_on_fixed_predictions(spark):
    pdf = pd.DataFrame({"Churn": [1, 1, 0, 0, 1, 0, 1, 0], "prediction": [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0]})
    m = M.binary_metrics(spark.createDataFrame(pdf)).first()
    tp, fp, tn, fn = 3, 1, 3, 1
    assert m["accuracy"] == 6 / 8
    assert m["precision"] == tp / (tp + fp) and m["recall"] == tp / (tp + fn)
    assert abs(m["f1"] - 2 * tp / (2 * tp + fp + fn)) < 1e-12
    assert abs(m["roc_auc"] - (tp / (tp + fn) + tn / (tn + fp)) / 2) < 1e-12
    one_class = M.binary_metrics(spark.createDataFrame(pdf.assign(Churn=0))).first()
    assert one_class["roc_auc"] is None and one_class["precision"] == 0.0


def test_regression_metrics(spark):
    pdf = pd.DataFrame({"CLV": [1.0, 2.0, 3.0, 4.0], "prediction": [1.5, 2.0, 2.0, 4.5]})
    m = M.regression_metrics(spark.createDataFrame(pdf)).first()
    err = pdf["CLV"] - pdf["prediction"]
    assert abs(m["mae"] - err.abs().mean()) < 1e-12
    assert abs(m["mse"] - (err ** 2).mean()) < 1e-12
    sst = ((pdf["CLV"] - pdf["CLV"].mean()) ** 2).sum()
    assert abs(m["r2"] - (1 - (err ** 2).sum() / sst)) < 1e-12


def test_missing_features_are_neither_skipped_nor_guessed(spark):
    rows = [(i, float(i % 7), float(i), float(i % 2), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "CustomerID long, a double, b double, c double, Churn int")
    test = train.withColumn("b", F.when(F.col("CustomerID") % 2 == 0, F.col("b")))
    pred = M.predict(M.train_churn(train, cols=["a", "b", "c"], num_trees=5, max_depth=4), test, label="Churn").collect()
    assert len(pred) == 40 and all((r.prediction is None) == (r.CustomerID % 2 == 1) for r in pred)
    with pytest.raises(ValueError, match="20 of 40"):
        M.train_churn(test, cols=["a", "b", "c"])
    assert M.complete_rows(test, ["a", "b", "c"]).count() == 20
    assert M.features(test, ["a", "b", "c"]).where("features IS NULL").count() == 20
    few = M.train_churn(train, cols=["a", "b", "c"], num_trees=3, max_depth=3, max_rows=10)
    assert M.predict(few, train).count() == 40


def test_models_fit_and_predict(spark):
    cust = with_clv(R.rfm_segmented(retail_lines(spark, SF_SMALL), churn_days=90))
    parts = M.hash_split(cust)
    train, test = parts.where(~F.col("is_test")), parts.where(F.col("is_test"))
    pred = M.predict(M.train_churn(train, num_trees=10, max_depth=5), test, label="Churn")
    assert pred.count() == test.count()
    assert set(r["prediction"] for r in pred.collect()) <= {0.0, 1.0}
    lr = M.predict(M.train_clv(train), test, label="CLV")
    # CLV equals the feature Monetary: the fit is exact by construction
    assert M.regression_metrics(lr).first()["r2"] > 0.999
