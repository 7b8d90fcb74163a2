"""Properties: results do not depend on the number of shuffle partitions (the
exact quantiles rely on range partitions, which AQE may coalesce), and a value or
group holding a third of all rows is handled exactly."""

import numpy as np
import pandas as pd
import pytest

from tillwise.functions.quantiles import exact_quantiles
from tillwise.operators import rfm as R
from tillwise.sources.testdata import retail_lines

from conftest import SF_SMALL


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_scores_independent_of_shuffle_partitions(spark, parts):
    base = {r["CustomerID"]: (r["R_score"], r["F_score"], r["M_score"], r["Segment"])
            for r in R.rfm_segmented(retail_lines(spark, SF_SMALL)).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r["CustomerID"]: (r["R_score"], r["F_score"], r["M_score"], r["Segment"])
               for r in R.rfm_segmented(retail_lines(spark, SF_SMALL)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == base


@pytest.mark.parametrize("parts", [2, 8, 31])
def test_hot_group_and_hot_value(spark, parts):
    rng = np.random.default_rng(parts)
    n = 3000
    grp = np.where(rng.random(n) < 0.34, "hot", rng.choice(["a", "b", "c", "d"], n))
    val = np.round(rng.normal(100, 30, n), 1)
    val[(grp == "hot") & (rng.random(n) < 0.5)] = 42.0      # a hot value inside the hot group
    pdf = pd.DataFrame({"g": grp, "v": val})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        res = {r["g"]: (r["n"], list(r["q"])) for r in
               exact_quantiles(spark.createDataFrame(pdf), "v", [0.0, 0.25, 0.5, 0.9, 1.0], by=["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g, sub in pdf.groupby("g"):
        assert res[g][0] == len(sub)
        assert res[g][1] == list(np.percentile(sub["v"].values, [0, 25, 50, 90, 100]))
