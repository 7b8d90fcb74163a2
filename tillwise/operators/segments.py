"""Segment drill-down (SG1-SG6).

Line-level questions about segments (top products, countries) are answered by
pre-aggregating lines per (CustomerID, key) before the join with the customer
table, so the join moves one row per customer and key instead of every line,
and a customer holding a large share of all lines is folded map-side first.
Top-n per segment is a ``row_number() <= n`` filter, which Spark turns into a
per-partition group limit ahead of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.heavy import join_with_heavy
from tillwise.operators.profiling import grouped_describe
from tillwise.operators.rfm import ranked_segments
from tillwise.schema import COUNTRY, CUSTOMER, DESCRIPTION, FREQUENCY, LINES, MONETARY, RECENCY, SEGMENT


def _chosen(customers: DataFrame, seg: str | None, largest: bool) -> DataFrame:
    """Customers restricted to one segment: ``seg`` by name, or the largest one."""
    if seg is not None:
        return customers.where(F.col(SEGMENT) == seg)
    if largest:
        top = ranked_segments(customers).where(F.col("rank") == 1).select(SEGMENT)
        # one row by construction
        return customers.join(F.broadcast(top), SEGMENT, "left_semi")
    return customers.where(F.col(SEGMENT).isNotNull())


def in_segment(customers: DataFrame, seg: str | None = None, largest: bool = True) -> DataFrame:
    """SG2: the customers of a chosen segment (default: the largest)."""
    return _chosen(customers, seg, largest and seg is None)


def segment_profile(customers: DataFrame, seg: str | None = None, largest: bool = False) -> DataFrame:
    """SG3: describe Recency, Frequency, Monetary within each segment (or one
    segment): count, mean, std, min, 25%, 50%, 75%, max; all segments in one pass."""
    chosen = _chosen(customers, seg, largest)
    return grouped_describe(chosen, [RECENCY, FREQUENCY, MONETARY], by=[SEGMENT])


def tx_with_segment(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """SG4: lines joined (inner, on CustomerID) with their customer's Segment. Lines of customers that hold more than a thousandth
    of them are joined where they are, the others by a shuffle (``functions.heavy``). Runs a pass that finds those customers."""
    return join_with_heavy(tx, customers.select(CUSTOMER, SEGMENT), CUSTOMER)


def _segment_line_counts(tx: DataFrame, customers: DataFrame, key: str, seg: str | None,
                         largest: bool) -> DataFrame:
    lines = F.sum(LINES) if LINES in tx.columns else F.count(F.lit(1))
    per_customer = tx.where(F.col(key).isNotNull()).groupBy(CUSTOMER, key).agg(lines.alias("_n"))
    chosen = _chosen(customers, seg, largest).select(CUSTOMER, SEGMENT)
    return (per_customer.join(chosen, CUSTOMER, "inner")
            .groupBy(SEGMENT, key).agg(F.sum("_n").alias("count")))


def segment_top_products(tx: DataFrame, customers: DataFrame, n: int = 10, seg: str | None = None,
                         largest: bool = False) -> DataFrame:
    """SG5: per segment, the n Descriptions bought on the most lines (ties by name), of lines or folded lines."""
    counts = _segment_line_counts(tx, customers, DESCRIPTION, seg, largest)
    w = Window.partitionBy(SEGMENT).orderBy(F.desc("count"), F.asc(DESCRIPTION))
    return (counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def segment_countries(tx: DataFrame, customers: DataFrame, seg: str | None = None,
                      largest: bool = False) -> DataFrame:
    """SG6: per segment, lines per Country, largest first within a segment (ties by name)."""
    return _segment_line_counts(tx, customers, COUNTRY, seg, largest).orderBy(SEGMENT, F.desc("count"), COUNTRY)
