"""Recency, frequency, monetary value per customer; quantile scores and segments.

One ``groupBy(CustomerID)`` aggregate computes last purchase, distinct invoices
and money spent together (no per-metric aggregates joined back); the two
dataset-wide instants (reference date, churn threshold) come from one ungrouped
aggregate attached by a broadcast cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize, materialize_table
from tillwise.functions.numeric import money_sum
from tillwise.functions.quantiles import bin_by_edges, quantile_edges
from tillwise.functions.scalars import attach_scalars
from tillwise.schema import (
    COUNTRY, CUSTOMER, F_SCORE, FREQUENCY, INVOICE, INVOICE_DATE, M_SCORE, MONETARY, R_SCORE, RECENCY,
    RFM_SCORE, SEGMENT, TOTAL_PRICE,
)

LAST_PURCHASE = "LastPurchase"
REFERENCE_DATE = "ReferenceDate"

# Segment rules, checked top to bottom on the three-digit RFM score.
SEGMENT_RULES = [
    (555, "Best Customers"),
    (454, "Loyal Customers"),
    (414, "Recent but Infrequent"),
    (333, "Promising"),
    (222, "At Risk"),
    (111, "Lost Customers"),
]
OTHER_SEGMENT = "Others"


def last_purchase(tx: DataFrame) -> DataFrame:
    """Latest InvoiceDate per customer (lines without a customer are no customer)."""
    return tx.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER).agg(F.max(INVOICE_DATE).alias(LAST_PURCHASE))


def reference_date(tx: DataFrame, days: int = 1) -> DataFrame:
    """R2: one row, the latest InvoiceDate plus ``days`` (time of day kept)."""
    return tx.agg(F.timestamp_add("DAY", F.lit(days), F.max(INVOICE_DATE)).alias(REFERENCE_DATE))


def rfm(tx: DataFrame, churn_days: int | None = None, country: bool = False) -> DataFrame:
    """CustomerID, Recency (whole elapsed days to the reference date),
    Frequency (distinct invoices), Monetary (exact money sum).

    With ``churn_days`` the same single aggregate also yields CH3's flag:
    Churn = 1 when the customer's last purchase is strictly before the latest
    purchase overall minus ``churn_days`` days. With ``country`` the customer's
    most frequent Country (smallest on ties, CL2) comes from the same pass."""
    # one pass over the lines; the customer-level result is written once because
    # the dataset-wide latest purchase (= the latest of the per-customer maxima,
    # lines without a customer included) is read from it: a column-pruned second
    # evaluation would re-read the lines
    if country:
        # lines fold to (customer, country, invoice) once; the metrics and the
        # country counts are both read from that table
        pieces = materialize_table(tx.groupBy(CUSTOMER, COUNTRY, INVOICE).agg(
            F.max(INVOICE_DATE).alias("_last"), _money(TOTAL_PRICE).alias("_money"), F.count(F.lit(1)).alias("_n")), "invoices")
        metrics = pieces.groupBy(CUSTOMER).agg(F.max("_last").alias(LAST_PURCHASE), F.count_distinct(INVOICE).alias(FREQUENCY),
                                               F.sum("_money").cast("double").alias(MONETARY))
        homes = most_frequent(pieces.where(F.col(CUSTOMER).isNotNull()).groupBy(CUSTOMER, COUNTRY).agg(F.sum("_n").alias("_n")),
                              [CUSTOMER], COUNTRY)
        per_customer = materialize(metrics.join(homes, CUSTOMER, "left"))
    else:
        per_customer = materialize(tx.groupBy(CUSTOMER).agg(
            F.max(INVOICE_DATE).alias(LAST_PURCHASE), F.count_distinct(INVOICE).alias(FREQUENCY), money_sum(F.col(TOTAL_PRICE)).alias(MONETARY)))
    latest = F.max(LAST_PURCHASE)
    scalars = [F.timestamp_add("DAY", F.lit(1), latest).alias(REFERENCE_DATE)]
    if churn_days is not None:
        scalars.append(F.timestamp_add("DAY", F.lit(-churn_days), latest).alias("_churn_before"))
    with_ref = attach_scalars(per_customer.where(F.col(CUSTOMER).isNotNull()), per_customer.agg(*scalars))
    cols = [
        CUSTOMER,
        F.timestamp_diff("DAY", F.col(LAST_PURCHASE), F.col(REFERENCE_DATE)).cast("int").alias(RECENCY),
        F.col(FREQUENCY).cast("int").alias(FREQUENCY),
        F.col(MONETARY),
    ]
    if churn_days is not None:
        cols.append((F.col(LAST_PURCHASE) < F.col("_churn_before")).cast("int").alias("Churn"))
    if country:
        cols.append(F.col(COUNTRY))
    return with_ref.select(*cols)


def most_frequent(counts: DataFrame, by: Sequence[str], value: str, n: str = "_n") -> DataFrame:
    """by..., value: the value with the largest count per group, the smallest on ties, NULL if no other is known.
    From counted values, so no task holds a value -> count map of a group."""
    order = F.struct(F.col(value).isNull(), -F.col(n), F.col(value))
    return counts.groupBy(*by).agg(F.min_by(value, order).alias(value))


def _money(column: str):
    """The decimal behind money_sum, to be added up further."""
    return money_sum(F.col(column)).cast("decimal(28,4)")


def quantile_score(df: DataFrame, column: str, out: str, q: int = 5, reverse: bool = False,
                   duplicates: str = "drop") -> DataFrame:
    """R8 (and R7 with ``duplicates='raise'``): score a column by its exact quantile bins.

    Edges are the exact 0, 1/q, ..., 1 quantiles with repeats dropped, so b <= q
    bins remain; the score is 1..b (b..1 when ``reverse``), right-closed, lowest
    value included. One edge only -> NULL score. With ``duplicates='raise'`` a
    repeated edge fails the query instead.
    """
    edges = quantile_edges(df, column, q=q, out="_edges")
    if duplicates == "raise":
        edges = edges.select(F.when(F.size("_edges") == q + 1, F.col("_edges")).otherwise(
            F.raise_error(F.lit(f"Bin edges must be unique for {column}; "
                                "use duplicates='drop'"))).alias("_edges"))
    elif duplicates != "drop":
        raise ValueError("duplicates must be 'drop' or 'raise'")
    scored = attach_scalars(df, edges)
    return scored.withColumn(out, bin_by_edges(F.col(column), F.col("_edges"), q + 1, reverse)).drop("_edges")


def score_rfm(rfm_df: DataFrame, q: int = 5, duplicates: str = "drop") -> DataFrame:
    """R8 x3 + R9: R_score (reversed), F_score, M_score and RFM_Score = int(concat(R, F, M)).

    The three edge sets are computed by one exact-quantile job over the three
    columns stacked long, then attached as one row.
    """
    cols = [(RECENCY, R_SCORE, True), (FREQUENCY, F_SCORE, False), (MONETARY, M_SCORE, False)]
    # the customer table feeds both its own edges and the scored output; rfm() has written it already
    long = rfm_df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c, _, _ in cols
    ])).alias("_s")).select("_s._col", "_s._val")
    edges = quantile_edges(long, "_val", q=q, by=["_col"], out="_edges")
    wide = edges.agg(*[F.max(F.when(F.col("_col") == c, F.col("_edges"))).alias(f"_e_{c}")
                       for c, _, _ in cols])
    if duplicates == "raise":
        checks = [F.when(F.size(f"_e_{c}") == q + 1, F.col(f"_e_{c}")).otherwise(
            F.raise_error(F.lit(f"Bin edges must be unique for {c}; use duplicates='drop'"))
        ).alias(f"_e_{c}") for c, _, _ in cols]
        wide = wide.select(*checks)
    elif duplicates != "drop":
        raise ValueError("duplicates must be 'drop' or 'raise'")
    scored = attach_scalars(rfm_df, wide)
    for c, out, rev in cols:
        scored = scored.withColumn(out, bin_by_edges(F.col(c), F.col(f"_e_{c}"), q + 1, rev))
    scored = scored.drop(*[f"_e_{c}" for c, _, _ in cols])
    return scored.withColumn(RFM_SCORE, rfm_score_expr())


def rfm_score_expr():
    """The three scores written side by side as text, read back as an integer."""
    return F.concat(F.col(R_SCORE).cast("string"), F.col(F_SCORE).cast("string"),
                    F.col(M_SCORE).cast("string")).cast("int")


def segment_expr(score_col: str = RFM_SCORE, rules: Sequence[tuple[int, str]] = SEGMENT_RULES,
                 other: str = OTHER_SEGMENT):
    """First rule whose threshold the score reaches; missing score -> NULL."""
    c = F.col(score_col)
    expr = None
    for threshold, name in rules:
        expr = F.when(c >= threshold, F.lit(name)) if expr is None else expr.when(c >= threshold, F.lit(name))
    return F.when(c.isNotNull(), expr.otherwise(F.lit(other)))


def segment(scored: DataFrame, rules: Sequence[tuple[int, str]] = SEGMENT_RULES) -> DataFrame:
    """R10 on a scored table."""
    return scored.withColumn(SEGMENT, segment_expr(RFM_SCORE, rules))


def rfm_segmented(tx: DataFrame, q: int = 5, duplicates: str = "drop",
                  churn_days: int | None = None, country: bool = False) -> DataFrame:
    """The scored and segmented customer table (the RFM table schema),
    plus the Churn flag when ``churn_days`` is given and the home Country when
    ``country`` is set (both from the same single pass over the lines)."""
    return segment(score_rfm(rfm(tx, churn_days, country), q=q, duplicates=duplicates))


def segment_counts(customers: DataFrame) -> DataFrame:
    """Customers per segment, largest first (ties by name); missing segment not counted."""
    return (customers.where(F.col(SEGMENT).isNotNull())
            .groupBy(SEGMENT).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(SEGMENT)))


def top_segment(customers: DataFrame) -> DataFrame:
    """SG1: the largest segment (one row: Segment, count)."""
    return segment_counts(customers).limit(1)


def ranked_segments(customers: DataFrame) -> DataFrame:
    """Segment counts with their rank (1 = largest); a tiny frame (one row per segment)."""
    counts = customers.where(F.col(SEGMENT).isNotNull()).groupBy(SEGMENT).agg(
        F.count(F.lit(1)).alias("count"))
    w = Window.orderBy(F.desc("count"), F.asc(SEGMENT))
    return counts.withColumn("rank", F.row_number().over(w))
