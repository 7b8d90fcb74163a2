"""Retail views over the driver's test tables (TPC-H-like parquet).

``retail_lines`` maps order lines to the transaction schema:

    InvoiceNo   = orderkey as text      StockCode  = partkey as text
    Description = part name             Quantity   = line quantity
    InvoiceDate = order date            UnitPrice  = extended price / quantity
    CustomerID  = order's customer      Country    = customer's nation name
    TotalPrice  = extended price

Variants (same expressions in the DuckDB oracle): raw text numerics, injected
dirt, coarse invoice ids, time of day, and purchase events. Joins are plain equi-joins;
Catalyst/AQE choose the strategy from runtime sizes (the nation table is tiny and
gets broadcast by the size check; the big tables are shuffled on their keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources.positions import with_position
from tillwise.schema import (
    COUNTRY, CUSTOMER, DESCRIPTION, INVOICE, INVOICE_DATE, QUANTITY, STOCK, TOTAL_PRICE,
    TX_COLUMNS, UNIT_PRICE,
)

from tillwise.session import derived_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined(spark: SparkSession, sf_dir: str, position: str | None = None) -> DataFrame:
    # orders meet customers first, at order grain: lines are then joined on the order
    # key only, so they are never shuffled on a hot customer before an aggregate has
    # folded them, and adaptive execution is free to split a skewed order join
    li = table(spark, sf_dir, "lineitem")
    li = with_position(li, position) if position else li
    li = li.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", *([position] if position else []))
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cust_country = cu.join(na, cu.c_nationkey == na.n_nationkey).select("c_custkey", "n_name")
    order_country = od.join(cust_country, od.o_custkey == cust_country.c_custkey)
    return li.join(order_country, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)


def retail_lines(spark: SparkSession, sf_dir: str, position: str | None = None) -> DataFrame:
    """Typed transaction lines (the base fixture). ``position`` names a column for the place of the line in its file."""
    j = _joined(spark, sf_dir, position)
    return j.select(
        F.col("o_orderkey").cast("string").alias(INVOICE),
        F.col("l_partkey").cast("string").alias(STOCK),
        F.col("p_name").alias(DESCRIPTION),
        F.col("l_quantity").cast("double").alias(QUANTITY),
        F.col("o_orderdate").cast("timestamp_ntz").alias(INVOICE_DATE),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias(UNIT_PRICE),
        F.col("o_custkey").cast("bigint").alias(CUSTOMER),
        F.col("n_name").alias(COUNTRY),
        F.col("l_extendedprice").cast("double").alias(TOTAL_PRICE),
        *([position] if position else []),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base lines in the raw schema: numerics as text, fractional-typed customer id."""
    return _to_raw(retail_lines(spark, sf_dir))


def _to_raw(tx: DataFrame) -> DataFrame:
    return tx.select(
        INVOICE, STOCK, DESCRIPTION,
        F.col(QUANTITY).cast("string").alias(QUANTITY),
        INVOICE_DATE,
        F.col(UNIT_PRICE).cast("string").alias(UNIT_PRICE),
        F.col(CUSTOMER).cast("double").alias(CUSTOMER),
        COUNTRY, TOTAL_PRICE)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines with injected dirt, keyed on the order key:
    customer missing (key % 97 = 0), quantity 'n/a' (% 89), negative quantity
    (% 83), and lines of orders with key % 53 = 0 present twice."""
    j = _joined(spark, sf_dir)
    k = F.col("o_orderkey")
    qty = (F.when(k % 89 == 0, F.lit("n/a"))
            .when(k % 83 == 0, (-F.col("l_quantity")).cast("string"))
            .otherwise(F.col("l_quantity").cast("string")))
    base = j.select(
        k.cast("string").alias(INVOICE),
        F.col("l_partkey").cast("string").alias(STOCK),
        F.col("p_name").alias(DESCRIPTION),
        qty.alias(QUANTITY),
        F.col("o_orderdate").cast("timestamp_ntz").alias(INVOICE_DATE),
        (F.col("l_extendedprice") / F.col("l_quantity")).cast("string").alias(UNIT_PRICE),
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("o_custkey")).cast("double").alias(CUSTOMER),
        F.col("n_name").alias(COUNTRY),
        F.col("l_extendedprice").cast("double").alias(TOTAL_PRICE),
        k.alias("_key"),
    )
    # one pass for both copies: a union would read and join the lines twice
    copies = F.when(F.col("_key") % 53 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.withColumn("_copy", F.explode(copies)).drop("_key", "_copy")


def coarse_lines(spark: SparkSession, sf_dir: str, invoices: int) -> DataFrame:
    """All base lines with their order keys folded to ``invoices`` invoice ids: few distinct invoices per
    customer, so quantile edges repeat (1: every customer has Frequency 1)."""
    return retail_lines(spark, sf_dir).withColumn(INVOICE, (F.col(INVOICE).cast("bigint") % invoices).cast("string"))


def clock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base lines with a time of day: + ((days since 1995-01-01) * 7 % 24) hours."""
    tx = retail_lines(spark, sf_dir)
    days = F.datediff(F.col(INVOICE_DATE).cast("date"), F.lit("1995-01-01").cast("date"))
    shifted = F.timestamp_add("HOUR", (days * 7) % 24, F.col(INVOICE_DATE))
    return tx.withColumn(INVOICE_DATE, shifted.cast("timestamp_ntz"))


def broken_csv(spark: SparkSession, sf_dir: str) -> str:
    """Base lines as header CSV, written by Spark, of which some are broken: those of orders with key % 97 = 0 lack the last two
    fields, those with key % 89 = 0 have one too many. Returns the path."""
    tx, k = retail_lines(spark, sf_dir), F.col(INVOICE).cast("bigint")
    cells = [F.col(c).cast("string") if c != DESCRIPTION else F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in TX_COLUMNS]
    line = F.when(k % 97 == 0, F.concat_ws(",", *cells[:-2])).when(k % 89 == 0, F.concat_ws(",", *cells, F.lit("more"))).otherwise(F.concat_ws(",", *cells))
    path = derived_path(spark, "broken-lines-csv")
    lines = tx.select(line.alias("value"))
    # each file begins with the header: the writer's own, for a table of one column whose name is the header line
    lines.select(F.col("value").alias(",".join(TX_COLUMNS))).write.options(header=True, sep="\x01", quote="", escapeQuotes=False).csv(path)
    return path


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as transaction lines (real time of day, 30-day span)."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        F.col("event_id").cast("string").alias(INVOICE),
        F.lit(None).cast("string").alias(STOCK),
        F.lit(None).cast("string").alias(DESCRIPTION),
        F.lit(1.0).alias(QUANTITY),
        F.col("ts").cast("timestamp_ntz").alias(INVOICE_DATE),
        F.col("value").cast("double").alias(UNIT_PRICE),
        F.col("user_id").cast("bigint").alias(CUSTOMER),
        F.lit(None).cast("string").alias(COUNTRY),
        F.col("value").cast("double").alias(TOTAL_PRICE),
    ).select(*TX_COLUMNS)
