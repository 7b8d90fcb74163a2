"""Scalars computed by Spark travel as one-row DataFrames.

A global aggregate without grouping keys yields exactly one row, so
broadcasting it is size-bounded by construction; the cross join then attaches
the scalar columns to every row without a driver round trip. A frame with no row
or several rows fails the query: it must neither delete nor copy the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row of ``df``; any other number of rows raises."""
    whole = one_row.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*one_row.columns)).alias("_row"))
    only = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("expected one row of scalars, found "), F.col("_n").cast("string"))))
    return df.crossJoin(F.broadcast(whole.select(only.alias("_row")).select("_row.*")))
