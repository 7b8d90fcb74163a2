"""Keys that hold a large share of the rows, and joins that do not send their rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize

#: A key is heavy from this share of the rows on, so there are at most 1,000 heavy keys.
HEAVY_SHARE = 0.001


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The keys that hold more than ``share`` of the rows (one column, at most 1 / share rows), by a sketch of frequent items: one
    pass, a bounded summary a task. The sketch never misses such a key; one slightly below may be in. NULL is no key."""
    most = int(1 / share)
    items = 1 << max(10, (8 * most).bit_length())  # counts are off by a small part of the share
    top = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).agg(F.expr(f"approx_top_k(k, {most}, {items})").alias("top"), F.count(F.lit(1)).alias("n"))
    found = top.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.lit(share) * F.col("n"))
    return materialize(found.select(F.col("t.item").alias(key)))


def join_with_heavy(rows: DataFrame, table: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` that has one row a key. Rows of heavy keys never move: the few rows of the table
    that they need are broadcast. All other rows are joined as Spark sees fit, and no key among them is heavy."""
    heavy = heavy_keys(rows, key, share)
    few = table.join(F.broadcast(heavy), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(table, key))
