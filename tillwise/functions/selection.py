"""The k-th smallest of uniformly spread hashes, without a global sort.

Hex digests are counted by their first digits, then, inside the one prefix that holds the wanted rank, by the
next ones; the few rows left there are ranked. Every count folds map-side to at most ``16 ** DIGITS`` rows, and the
rows that meet in one task at the end are a ``16 ** (2 * DIGITS)``-th of all (about 6,000 of 10^11), plus rows of equal hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize, materialize_table
from tillwise.functions.scalars import attach_scalars

DIGITS = 3


def rank_cut(rows: DataFrame, digest: Column, key: Column, share: float) -> DataFrame:
    """One row (``cut_digest``, ``cut_key``): the ceil(share * n)-th smallest (digest, key) of the n rows; both NULL for no row.
    ``digest``: hex text, never NULL. Runs the selection when called."""
    all_rows = materialize_table(rows.select(digest.alias("_h"), key.alias("_k")), "digests")
    # the share as a product of whole numbers: 0.2 * 15 is 3, not 3.0000000000000004
    num, den = F.lit(round(share * 1e9)).cast("decimal(20,0)"), F.lit(10 ** 9).cast("decimal(20,0)")
    wanted = all_rows.agg(F.ceil(F.count(F.lit(1)).cast("decimal(20,0)") * num / den).cast("long").alias("_rank"))
    left = all_rows
    for level in (1, 2):
        upto = Window.orderBy("_p")
        counts = left.groupBy(F.substring("_h", 1, DIGITS * level).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        spans = attach_scalars(counts.withColumn("_after", F.sum("_n").over(upto)), wanted)
        spans = spans.withColumn("_before", F.col("_after") - F.col("_n")).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_after")))
        hit = materialize(spans.agg(F.max("_p").alias("_prefix"), F.max(F.col("_rank") - F.col("_before")).alias("_rank")))
        left = attach_scalars(left, hit.select("_prefix")).where(F.substring("_h", 1, DIGITS * level) == F.col("_prefix")).drop("_prefix")
        wanted = hit.select("_rank")
    at = attach_scalars(left.withColumn("_at", F.row_number().over(Window.orderBy("_h", F.asc_nulls_first("_k")))), wanted)
    return materialize(at.where(F.col("_at") == F.col("_rank")).agg(F.max("_h").alias("cut_digest"), F.max("_k").alias("cut_key")))
