"""Products, drill-down and profiles against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tillwise.operators import products as PR
from tillwise.operators import profiling as P
from tillwise.operators import rfm as R
from tillwise.operators import segments as SG
from tillwise.sources.testdata import dirty_lines, retail_lines

from conftest import SF_SMALL


def test_product_performance_and_top(spark):
    tx = retail_lines(spark, SF_SMALL)
    pdf = tx.toPandas()
    perf = PR.product_performance(tx)
    want = pdf.groupby("StockCode").agg(q=("Quantity", "sum"), r=("TotalPrice", "sum"))
    got = perf.toPandas().set_index("StockCode").sort_index()
    assert np.allclose(got["TotalQuantitySold"], want["q"].sort_index())
    assert np.allclose(got["TotalRevenue"], want["r"].sort_index(), rtol=1e-12)
    top = PR.top_products(perf, "TotalRevenue", 10).toPandas()
    exp = want.reset_index().sort_values(["r", "StockCode"], ascending=[False, True]).head(10)
    assert top["StockCode"].tolist() == exp["StockCode"].tolist()
    both = set(PR.top_products(perf, "TotalQuantitySold", 10).toPandas()["StockCode"]) & set(exp["StockCode"])
    assert set(PR.dual_top_products(perf, 10).toPandas()["StockCode"]) == both
    summ = PR.dual_top_summary(perf, 10).first()
    assert summ["n_common"] == len(both)


def test_segment_top_products_and_countries(spark):
    tx = retail_lines(spark, SF_SMALL)
    cust = R.rfm_segmented(tx)
    merged = tx.toPandas().merge(cust.toPandas()[["CustomerID", "Segment"]], on="CustomerID")
    top = SG.segment_top_products(tx, cust, 10).toPandas()
    for seg, grp in merged.groupby("Segment"):
        vc = grp["Description"].value_counts()
        vc = vc.reset_index().sort_values(["count", "Description"], ascending=[False, True]).head(10)
        g = top[top["Segment"] == seg].sort_values("rank")
        assert g["Description"].tolist() == vc["Description"].tolist()
        assert g["count"].tolist() == vc["count"].tolist()
    countries = SG.segment_countries(tx, cust).toPandas()
    assert countries["count"].sum() == len(merged)
    largest = R.top_segment(cust).first()["Segment"]
    assert SG.in_segment(cust).where(F.col("Segment") != largest).count() == 0


def test_profiles(spark):
    tx = retail_lines(spark, SF_SMALL)
    pdf = tx.toPandas()
    d = P.describe(tx, ["Quantity", "TotalPrice"]).toPandas().set_index("column")
    for c in ["Quantity", "TotalPrice"]:
        desc = pdf[c].describe()
        assert d.loc[c, "count"] == desc["count"]
        assert d.loc[c, "q25"] == desc["25%"] and d.loc[c, "q50"] == desc["50%"] and d.loc[c, "q75"] == desc["75%"]
        assert abs(d.loc[c, "mean"] - desc["mean"]) < 1e-5 and abs(d.loc[c, "std"] - desc["std"]) < 1e-5
    nu = P.nunique(tx).toPandas().set_index("column")["nunique"]
    assert all(nu[c] == pdf[c].nunique() for c in pdf.columns)
    raw = dirty_lines(spark, SF_SMALL)
    rp = raw.toPandas()
    nc = P.null_counts(raw).toPandas().set_index("column")["missing"]
    assert all(nc[c] == rp[c].isnull().sum() for c in rp.columns)
    assert P.duplicate_count(raw).first()["duplicates"] == rp.duplicated().sum()
    box = P.boxplot_stats(tx, ["TotalPrice"]).first()
    x = pdf["TotalPrice"]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert box["whisker_low"] == x[x >= lo].min() and box["whisker_high"] == x[x <= hi].max()
    assert box["n_fliers"] == ((x < lo) | (x > hi)).sum()
    dv = P.distinct_values(tx, ["Country"], k=5).toPandas()
    assert dv["value"].tolist() == sorted(pdf["Country"].unique())[:5]


def test_describe_datetime_matches_pandas(spark):
    from tillwise.sources.testdata import clock_lines
    for lines in (retail_lines(spark, SF_SMALL), clock_lines(spark, SF_SMALL)):
        pdf = lines.toPandas()
        desc = pdf["InvoiceDate"].describe()
        got = P.describe_datetime(lines).first()
        assert got["count"] == desc["count"]
        for ours, theirs in [("mean", "mean"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                             ("q75", "75%"), ("max", "max")]:
            assert pd.Timestamp(got[ours]) == pd.Timestamp(desc[theirs]).floor("us"), ours
