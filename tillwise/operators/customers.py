"""Customer-level views: churn (CH1-CH4), lifetime value and home country
(CL1-CL3), and the customer / transaction entity views (E1, E3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize
from tillwise.functions.scalars import attach_scalars
from tillwise.operators.rfm import LAST_PURCHASE, last_purchase, most_frequent, rfm_segmented
from tillwise.schema import (
    CHURN, CLV, COUNTRY, CUSTOMER, F_SCORE, FREQUENCY, INVOICE, INVOICE_DATE, M_SCORE,
    MONETARY, QUANTITY, R_SCORE, RECENCY, RFM_SCORE, SEGMENT, STOCK, UNIT_PRICE,
)

CHURN_THRESHOLD = "ChurnThreshold"


def churn_threshold(tx: DataFrame, days: int = 90) -> DataFrame:
    """CH1: one row, the latest InvoiceDate minus ``days`` days."""
    return tx.agg(F.timestamp_add("DAY", F.lit(-days), F.max(INVOICE_DATE)).alias(CHURN_THRESHOLD))


def churned_customers(tx: DataFrame, days: int = 90) -> DataFrame:
    """CH2: customers whose last purchase is strictly before the threshold."""
    last = materialize(last_purchase(tx))  # read twice: threshold and filter
    thr = last.agg(F.timestamp_add("DAY", F.lit(-days), F.max(LAST_PURCHASE)).alias(CHURN_THRESHOLD))
    return (attach_scalars(last, thr).where(F.col(LAST_PURCHASE) < F.col(CHURN_THRESHOLD))
            .select(CUSTOMER, LAST_PURCHASE))


def churn_flag(customers: DataFrame, tx: DataFrame, days: int = 90) -> DataFrame:
    """CH3: Churn = 1 for customers in ``churned_customers(tx)``, else 0 (hash
    semi-membership through a left join; at most one churned row per customer)."""
    churned = churned_customers(tx, days).select(CUSTOMER, F.lit(1).alias("_churned"))
    return (customers.join(churned, CUSTOMER, "left")
            .withColumn(CHURN, F.coalesce(F.col("_churned"), F.lit(0))).drop("_churned"))


def churn_count(customers: DataFrame) -> DataFrame:
    """CH4: number of churned customers (one row)."""
    return customers.agg(F.coalesce(F.sum(CHURN), F.lit(0)).cast("bigint").alias("churned"))


def customer_country(tx: DataFrame) -> DataFrame:
    """CL2: most frequent Country of each customer, the smallest name on ties.
    A customer with no known country gets NULL; lines without a customer are no customer."""
    counts = tx.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER, COUNTRY).agg(F.count(F.lit(1)).alias("_n"))
    return most_frequent(counts, [CUSTOMER], COUNTRY)


def with_clv(customers: DataFrame) -> DataFrame:
    """CL1: lifetime value = Monetary."""
    return customers.withColumn(CLV, F.col(MONETARY))


def with_country(customers: DataFrame, tx: DataFrame) -> DataFrame:
    """CL3: left join of the home country onto the customer table."""
    return customers.join(customer_country(tx), CUSTOMER, "left")


def customer_table(tx: DataFrame, churn_days: int = 90, q: int = 5) -> DataFrame:
    """E1 + churn + CLV: one row per customer with id, country, R/F/M, scores,
    RFM score, segment, Churn and CLV (the full analysis table)."""
    # one pass over the lines for the metrics, the churn flag and the home country
    return with_clv(rfm_segmented(tx, q=q, churn_days=churn_days, country=True))


def customers(tx: DataFrame, q: int = 5) -> DataFrame:
    """CustomerID, Country, Recency, Frequency, Monetary, the scores and Segment."""
    t = rfm_segmented(tx, q=q, country=True)
    return t.select(CUSTOMER, COUNTRY, RECENCY, FREQUENCY, MONETARY, R_SCORE, F_SCORE, M_SCORE,
                    RFM_SCORE, SEGMENT)


def transactions(tx: DataFrame) -> DataFrame:
    """The eight line attributes."""
    return tx.select(INVOICE, STOCK, QUANTITY, INVOICE_DATE, UNIT_PRICE, CUSTOMER, COUNTRY,
                     F.col("TotalPrice"))

