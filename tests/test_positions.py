"""File order, broken rows, heavy keys, outlier points: against plain Python over the same files and rows."""

import csv
import os
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.functions.heavy import heavy_keys, join_with_heavy
from tillwise.operators import profiling as P
from tillwise.operators import segments as SG
from tillwise.schema import TX_COLUMNS
from tillwise.sources import files as S
from tillwise.sources.positions import POSITION, with_position

HEADER = ",".join(TX_COLUMNS)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def lines_of(n, seed):
    rng = random.Random(seed)
    return [f"{rng.randrange(50)},{rng.choice('zyxwvu')}{rng.randrange(30)},item {rng.randrange(9)},{rng.randrange(9)},2020-01-01,1.5,{rng.randrange(9)},{rng.choice(['UK', 'NO', ''])},3.0"
            for _ in range(n)]


def write(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join([HEADER, *lines]) + "\n")


def test_first_rows_and_first_seen_values_of_csv_files(spark, tmp_path, small_splits):
    lines = {f"part-{i}.csv": lines_of(300, i) for i in (2, 0, 1)}
    for name, rows in lines.items():
        write(tmp_path / "t", name, rows)
    tx = S.read_transactions(spark, str(tmp_path / "t"), position=POSITION)
    assert tx.rdd.getNumPartitions() > 5
    rows = [r for name in sorted(lines) for r in csv.reader(lines[name])]
    moved = tx.repartition(7)  # the position is data by now
    got = P.head(moved, 7).select("InvoiceNo", "StockCode").collect()
    assert [tuple(r) for r in got] == [tuple(r[:2]) for r in rows[:7]]
    for col, at in (("StockCode", 1), ("Country", 7)):
        want = list(dict.fromkeys(r[at] or None for r in rows))
        some = P.first_seen_values(moved, [col], k=20).orderBy("rank").collect()
        assert [r["value"] for r in some] == want[:20] and [r["rank"] for r in some] == list(range(1, len(want[:20]) + 1))
        every = P.first_seen_values(moved, [col], k=None).orderBy("rank").collect()
        assert [(r["rank"], r["value"]) for r in every] == list(enumerate(want, 1))


def test_parquet_numbers_its_rows(spark, tmp_path, small_splits):
    spark.range(0, 20_000, 1, 3).selectExpr("(id * 7919) % 20000 AS v").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "p"))
    import pyarrow.parquet as pq
    want = [v for f in sorted(os.listdir(tmp_path / "p")) if f.endswith(".parquet") for v in pq.read_table(tmp_path / "p" / f)["v"].to_pylist()]
    df = with_position(spark.read.parquet(str(tmp_path / "p")))
    assert [r["v"] for r in P.head(df, 12).collect()] == want[:12]
    assert [r["v"] for r in df.orderBy(POSITION).collect()] == want


def test_empty_files_have_no_first_rows(spark, tmp_path):
    write(tmp_path / "e", "a.csv", [])
    tx = S.read_transactions(spark, str(tmp_path / "e"), position=POSITION)
    assert P.head(tx, 3).count() == 0 and P.first_seen_values(tx).count() == 0


def test_broken_rows_come_out_with_their_text(spark, tmp_path, small_splits):
    good = lines_of(200, 5) + ['1,"A,1","say ""x""",2,2020-01-01,1.0,3,UK,2.0']
    bad = ["7,short", "8,a,b,1,2020-01-01,1.0,2,UK,2.0,extra", "lonely"]
    lines = good + bad
    random.Random(1).shuffle(lines)
    write(tmp_path / "b", "one.csv", lines[:100])
    write(tmp_path / "b", "two.csv", lines[100:])
    rows, rejected = S.read_transactions_rescued(spark, str(tmp_path / "b"))
    got = rejected.collect()
    assert sorted(r["line"] for r in got) == sorted(bad)
    assert all(r["line"] in open(r["file"].removeprefix("file:")).read().split("\n") for r in got)
    assert rows.count() == len(good) and rows.count() + rejected.count() == len(lines)
    assert rows.where("StockCode = 'A,1' AND Description = 'say \"x\"'").count() == 1
    assert rows.columns == TX_COLUMNS and rows.agg(F.sum("TotalPrice")).first()[0] == 3.0 * 200 + 2.0


def test_files_without_a_header_are_rescued_too(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.csv").write_text("1,A,x,2,2020-01-01,1.0,3,UK,2.0\n2,B\n")
    rows, rejected = S.read_transactions_rescued(spark, str(tmp_path / "n"), header=False)
    assert rows.count() == 1 and [r["line"] for r in rejected.collect()] == ["2,B"]


def test_heavy_keys_are_found(spark):
    rows = [(7,)] * 3000 + [(8,)] * 600 + [(None,)] * 5000 + [(100 + i,) for i in range(6000)]
    df = spark.createDataFrame(rows, "k long").repartition(9)
    assert {r["k"] for r in heavy_keys(df, "k", 0.01).collect()} == {7, 8}
    assert heavy_keys(df.limit(0), "k").count() == 0


def test_a_hot_customer_does_not_fill_one_task(spark):
    """A third of the lines are one customer's; adaptive execution and broadcasts by size are off."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("false", "-1", "16")):
            spark.conf.set(k, v)
        tx = spark.range(0, 60_000, 1, 16).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("CustomerID"), F.col("id").alias("line"))
        customers = spark.range(60_000).select(F.col("id").alias("CustomerID"), F.concat(F.lit("s"), F.col("id") % 4).alias("Segment"))
        out = SG.tx_with_segment(tx, customers)
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.count() == 60_000 and max(sizes) < 3 * median(sizes)
        plain = tx.join(customers, "CustomerID").groupBy(F.spark_partition_id()).count().collect()
        assert max(r[1] for r in plain) > 5 * median(r[1] for r in plain)
        assert out.exceptAll(tx.join(customers, "CustomerID")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lines_without_a_customer_or_segment_are_not_joined(spark):
    tx = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (9, 4)], "k long, line int")
    table = spark.createDataFrame([(1, "a"), (None, "b")], "k long, s string")
    assert sorted(tuple(r) for r in join_with_heavy(tx, table, "k").collect()) == [(1, 2, "a"), (1, 3, "a")]


def test_outlier_points_of_box_plots(spark):
    rng = np.random.default_rng(4)
    a = np.round(rng.standard_cauchy(3000), 1)
    rows = [(float(x), 5.0) for x in a] + [(None, 5.0), (float("nan"), 5.0)]
    out = P.boxplot_fliers(spark.createDataFrame(rows, "a double, flat double").repartition(4)).collect()
    q1, q3 = np.percentile(a, [25, 75])
    for side, mine in (("low", sorted(x for x in a if x < q1 - 1.5 * (q3 - q1))), ("high", sorted((x for x in a if x > q3 + 1.5 * (q3 - q1)), reverse=True))):
        got = sorted((r["rank"], r["value"], r["count"], r["points_before"]) for r in out if r["side"] == side)
        values = list(dict.fromkeys(mine))
        assert [(g[0], g[1]) for g in got] == list(enumerate(values, 1))
        assert all(c == mine.count(v) and before == mine.index(v) for _, v, c, before in got)
    stats = {r["column"]: r["n_fliers"] for r in P.boxplot_stats(spark.createDataFrame(rows, "a double, flat double")).collect()}
    assert {r["column"] for r in out} == {"a"} and stats["flat"] == 0 and stats["a"] == sum(r["count"] for r in out)


def test_first_seen_values_fold_by_hashes(spark):
    """Cells meet a hash aggregate first: the least struct alone would sort every cell of a task."""
    df = spark.range(100).selectExpr("CAST(id % 7 AS STRING) AS a", "named_struct('file', 'f', 'block', 0L, 'row', id) AS at")
    firsts = P.first_seen_values(df, ["a"], k=3, position="at")
    plan = [x for x in firsts._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x]
    assert "HashAggregate" in plan[-1] and [r["value"] for r in firsts.orderBy("rank").collect()] == ["0", "1", "2"]
