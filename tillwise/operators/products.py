"""Product performance (PR1-PR8) and the product entity view.

Quantity and revenue per StockCode come from one ``groupBy`` aggregate (no
second aggregate joined back). Top-N is ``orderBy(...).limit(n)``, which Spark
plans as a per-partition top-N merged once (TakeOrderedAndProject), never a
full sort; ties are broken by StockCode so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize
from tillwise.functions.numeric import money_sum, money_total
from tillwise.schema import COUNTRY, CUSTOMER, DESCRIPTION, LINES, MONEY, QUANTITY, STOCK, TOTAL_PRICE, TOTAL_QUANTITY, TOTAL_REVENUE, UNIT_PRICE

METRICS = (TOTAL_QUANTITY, TOTAL_REVENUE)


def fold_lines(tx: DataFrame) -> DataFrame:
    """Lines folded to (customer, product, description, country), with their number, quantity and exact money: all that the
    product and drill-down reports need of them. Written once, it stands for the lines in ``product_performance`` and in the
    counts of ``segments``, so that they do not read all lines again."""
    return tx.groupBy(CUSTOMER, STOCK, DESCRIPTION, COUNTRY).agg(
        F.count(F.lit(1)).alias(LINES), F.sum(QUANTITY).alias(QUANTITY), money_total(F.col(TOTAL_PRICE)).alias(MONEY))


def product_performance(tx: DataFrame) -> DataFrame:
    """PR1-PR3: StockCode, TotalQuantitySold, TotalRevenue (exact money sum), of lines or folded lines."""
    money = F.sum(MONEY).cast("double") if MONEY in tx.columns else money_sum(F.col(TOTAL_PRICE))
    return tx.where(F.col(STOCK).isNotNull()).groupBy(STOCK).agg(F.sum(QUANTITY).alias(TOTAL_QUANTITY), money.alias(TOTAL_REVENUE))


def top_products(perf: DataFrame, metric: str = TOTAL_QUANTITY, n: int = 10) -> DataFrame:
    """PR4 / PR5: the n products with the largest ``metric`` (ties by StockCode)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return perf.orderBy(F.desc(metric), F.asc(STOCK)).limit(n)


def dual_top_products(perf: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """PR6 / PR7: full rows of the products in both top-n lists, optionally
    ordered by one metric (descending)."""
    # read three times (two top-n lists, then the rows): compute the product
    # table once instead of three differently pruned passes over the lines
    perf = materialize(perf)
    codes = (top_products(perf, TOTAL_QUANTITY, n).select(STOCK)
             .intersect(top_products(perf, TOTAL_REVENUE, n).select(STOCK)))
    # both lists hold at most n rows: the semi join's right side is bounded by n
    rows = perf.join(F.broadcast(codes), STOCK, "left_semi")
    if order_by is not None:
        if order_by not in METRICS:
            raise ValueError(f"order_by must be one of {METRICS}")
        rows = rows.orderBy(F.desc(order_by), F.asc(STOCK))
    return rows


def dual_top_summary(perf: DataFrame, n: int = 10) -> DataFrame:
    """PR8: how many products are in both lists, and the leader of each metric among them."""
    dual = dual_top_products(perf, n)
    return dual.agg(
        F.count(F.lit(1)).alias("n_common"),
        # largest metric, smallest code on ties
        F.min_by(STOCK, F.struct(-F.col(TOTAL_QUANTITY), F.col(STOCK))).alias("quantity_leader"),
        F.min_by(STOCK, F.struct(-F.col(TOTAL_REVENUE), F.col(STOCK))).alias("revenue_leader"),
    )


def products(tx: DataFrame) -> DataFrame:
    """StockCode, the most frequent Description (smallest on ties), and the
    lowest / highest UnitPrice seen for it."""
    # one pass: lines fold to (product, description), from which all three are derived
    counts = tx.where(F.col(STOCK).isNotNull()).groupBy(STOCK, DESCRIPTION).agg(
        F.count(F.lit(1)).alias("_n"), F.min(UNIT_PRICE).alias("_min"), F.max(UNIT_PRICE).alias("_max"))
    order = F.struct(F.col(DESCRIPTION).isNull(), -F.col("_n"), F.col(DESCRIPTION))
    return counts.groupBy(STOCK).agg(F.min_by(DESCRIPTION, order).alias(DESCRIPTION),
                                     F.min("_min").alias("MinUnitPrice"), F.max("_max").alias("MaxUnitPrice"))
