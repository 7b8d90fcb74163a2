"""Readers on files as other tools write them; scratch folder; fixture plans."""

import os

import pytest
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.operators import cleaning as C
from tillwise.operators import profiling as P
from tillwise.operators import segments as SG
from tillwise.session import cluster_settings, release_scratch, scratch_scope
from tillwise.sources.files import read_rfm, read_transactions
from tillwise.sources.testdata import retail_lines

from conftest import SF_SMALL

HEAD = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country,TotalPrice"


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_quotes_and_commas(spark, tmp_path):
    p = _write(tmp_path / "a.csv", HEAD, '536365,85123A,"SET OF 2 ""RETRO"" TINS, RED",6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom,15.3')
    r = read_transactions(spark, p).first()
    assert r.Description == 'SET OF 2 "RETRO" TINS, RED' and r.Quantity == "6" and r.CustomerID == 17850.0 and str(r.InvoiceDate) == "2010-12-01 08:26:00"
    q = _write(tmp_path / "b.csv", HEAD, '1,2,"two\nlines",6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom,15.3')
    assert read_transactions(spark, q, multi_line=True).first().Description == "two\nlines"


def test_timestamp_pattern(spark, tmp_path):
    p = _write(tmp_path / "a.csv", HEAD, "1,2,x,6,12/1/2010 8:26,2.55,17850,UK,15.3", "1,2,x,6,2010-12-02 08:26:00,2.55,17850,UK,15.3")
    assert [r.InvoiceDate for r in read_transactions(spark, p).collect()][0] is None
    got = [str(r.InvoiceDate) for r in read_transactions(spark, p, timestamp_format="M/d/yyyy H:mm").collect()]
    assert got == ["2010-12-01 08:26:00", "2010-12-02 08:26:00"]


def test_files_with_different_column_order(spark, tmp_path):
    d = tmp_path / "both"
    d.mkdir()
    a = _write(d / "a.csv", "CustomerID,Recency,Frequency,Monetary", "1,10,2,5.5")
    b = _write(d / "b.csv", "Recency,CustomerID,Monetary,Frequency", "20,2,7.5,3")
    with pytest.raises(Exception):
        read_rfm(spark, str(d)).collect()
    got = sorted((r.CustomerID, r.Recency, r.Frequency, r.Monetary) for r in read_rfm(spark, [a, b]).collect())
    assert got == [(1, 10, 2, 5.5), (2, 20, 3, 7.5)]


def test_file_without_total_price(spark, tmp_path):
    head = HEAD.removesuffix(",TotalPrice")
    p = _write(tmp_path / "a.csv", head, *[f"{i},s,d,{i + 1},2010-12-01 08:26:00,2.5,{i % 3},UK" for i in range(60)])
    raw = read_transactions(spark, p)
    assert raw.count() == 60 and "TotalPrice" not in raw.columns
    clean = C.clean(raw)
    assert clean.count() > 50 and clean.where("TotalPrice != Quantity * UnitPrice").count() == 0
    with pytest.raises(ValueError):
        C.clean(raw, order="outliers_first")
    q = _write(tmp_path / "b.csv", head.replace("Quantity", "Qty"), "1,s,d,1,2010-12-01 08:26:00,2.5,1,UK")
    with pytest.raises(ValueError, match="Quantity"):
        read_transactions(spark, q)


def test_numbers_in_parquet_are_not_parsed_as_text(spark, tmp_path):
    p = str(tmp_path / "lines")
    retail_lines(spark, SF_SMALL).write.parquet(p)
    df = C.positive_only(C.coerce_numeric(read_transactions(spark, p, fmt="parquet")), plain=["Quantity", "UnitPrice"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Quantity,0.0)" in plan.split("PushedFilters")[1]
    assert df.count() == retail_lines(spark, SF_SMALL).count()


def test_scratch_is_released(spark):
    before = set()
    with scratch_scope(spark):
        t = materialize_table(spark.range(5), "probe")
        path = t.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        path = "/" + path.lstrip("/")
        assert os.path.isdir(path) and t.count() == 5
    assert not os.path.exists(path) and not before
    materialize_table(spark.range(5), "probe")
    assert release_scratch(spark) >= 1 and release_scratch(spark) == 0


def test_cluster_settings_follow_the_cores():
    s = cluster_settings(100 * 10 ** 12, 8000)
    assert 16_000 <= int(s["spark.sql.shuffle.partitions"]) <= 32_000
    tasks = 100 * 10 ** 12 / int(s["spark.sql.files.maxPartitionBytes"])
    assert tasks <= 33 * 8000


def test_skewed_order_join_can_be_split(spark):
    """No forced partitioning in front of the order join, and lines do not meet customers by a shuffle on the customer."""
    plan = retail_lines(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    hot = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("CustomerID"), F.concat(F.lit("x"), F.col("id")).alias("StockCode"))
    customers = spark.range(2000).select(F.col("id").alias("CustomerID"), F.lit("A").alias("Segment"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = hot.repartition(12)
        plain = hot.join(customers, "CustomerID")
        plain.collect()
        text = plain._jdf.queryExecution().executedPlan().toString()
        df = SG.tx_with_segment(hot, customers)
        assert df.count() == plain.count()
        df.collect()
        segments = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    # a plain join has a skewed side to split; the lines' join with their segments has none left, its hot lines do not move
    assert "skew=true" in text and "skew=true" not in segments and "BroadcastHashJoin" in segments


def test_describe_does_not_round_and_profiles_read_once(spark):
    df = spark.createDataFrame([(1e-8,), (3e-8,), (None,)], "x double")
    r = P.describe(df).first()
    assert r["count"] == 2 and abs(r["mean"] - 2e-8) < 1e-20 and abs(r["std"] - 2 ** 0.5 * 1e-8) < 1e-20
    tx = retail_lines(spark, SF_SMALL)
    plan = P.distinct_values(tx)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == 5  # five tables, each once
    empty = P.nunique(tx.limit(0)).collect()
    assert sorted(r["column"] for r in empty) == sorted(tx.columns) and all(r["nunique"] == 0 for r in empty)
