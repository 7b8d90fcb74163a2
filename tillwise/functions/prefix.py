"""Running totals along sorted values, without a sort in one task.

``running_totals`` gives each value of a group the totals of all smaller ones. Values are cut at up to ``SPLITS``
split values a group (data, so every read sees the same buckets); bucket totals and their prefix sums are a few rows, and
a window inside each bucket adds the rest. A hot value is one row, because equal values are folded first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.functions.quantiles import SPLITS, _count_below, _null_safe_join


def running_totals(rows: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` folded to one row for each (``by``, ``value``): the sums of ``totals`` at the value, ``<total>_before`` (over
    smaller values of the group) and ``<total>_all``. Values must not be NULL or NaN; groups may be NULL. Runs two jobs."""
    keys = [*by] or ["_all"]
    src = rows if by else rows.withColumn("_all", F.lit(0))
    folded = materialize_table(src.groupBy(*keys, value).agg(*[F.sum(t).alias(t) for t in totals]), "folded")
    cuts = [i / SPLITS for i in range(1, SPLITS)]
    splits = materialize_table(folded.groupBy(*keys).agg(F.array_sort(F.array_distinct(
        F.percentile_approx(F.col(value).cast("double"), cuts, 4 * SPLITS))).alias("_splits")), "splits")
    placed = _null_safe_join(folded, splits, keys).withColumn("_bucket", _count_below(F.col("_splits"), F.col(value).cast("double"))).drop("_splits")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "_bucket").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
    sums = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{t}").over(earlier), F.lit(0)).alias(f"_{t}_off") for t in totals],
                       *[F.sum(f"_{t}").over(whole).alias(f"{t}_all") for t in totals])
    smaller = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _null_safe_join(placed, sums, keys, ["_bucket"])
    out = out.withColumns({f"{t}_before": F.col(f"_{t}_off") + F.coalesce(F.sum(t).over(smaller), F.lit(0)) for t in totals})
    return out.drop("_bucket", *[f"_{t}_off" for t in totals], *([] if by else ["_all"]))
