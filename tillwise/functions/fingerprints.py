"""Repeated rows by fingerprints: 16 bytes of a row are shuffled, not the row.

Rows are counted by a 128-bit fingerprint of all columns. Only rows whose fingerprint occurs twice or more are compared in full, so
a clash of fingerprints changes nothing but the work. The repeated fingerprints are broadcast if there are at most
``MAX_BROADCAST`` of them (a counted number: 64 MB as an open hash table), and the rows then stay where they are; with more,
rows are repeated so often that they are compared in full at once, as ``dropDuplicates`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table

MAX_BROADCAST = 1_000_000
_HIGH, _LOW = "_fp_high", "_fp_low"


def fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a row. Spark's hash passes over NULL, so which columns are NULL is hashed too."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in cols]
    return F.xxhash64(*cols, *nulls), F.xxhash64(F.lit("low"), *nulls, *reversed(cols))


def _repeated(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]]) -> tuple[DataFrame, DataFrame, int]:
    """``df`` with its fingerprints, those that occur more than once, and their number."""
    high, low = of(df)
    marked = df.withColumns({_HIGH: high, _LOW: low})
    twice = materialize_table(marked.groupBy(_HIGH, _LOW).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated")
    return marked, twice, twice.count()


def distinct_rows(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]] = fingerprint, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``df.dropDuplicates()`` for rows that are cheap to read twice (a written table). Runs the count of fingerprints."""
    marked, twice, n = _repeated(df, of)
    if n > max_broadcast:  # every row is shuffled: once, also for those who read the result more than once
        return materialize_table(df.dropDuplicates(), "distinct")
    few = F.broadcast(twice)
    once = marked.join(few, [_HIGH, _LOW], "left_anti").select(df.columns)
    return once.unionByName(marked.join(few, [_HIGH, _LOW], "left_semi").select(df.columns).dropDuplicates()) if n else once


def repeated_rows(df: DataFrame, of: Callable[[DataFrame], tuple[Column, Column]] = fingerprint, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row (``duplicates``): how many rows repeat an earlier one. Reads ``df`` twice."""
    marked, twice, n = _repeated(df, of)
    if n > max_broadcast:
        rows = df
    else:
        rows = marked.join(F.broadcast(twice), [_HIGH, _LOW], "left_semi").select(df.columns)
    groups = rows.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
