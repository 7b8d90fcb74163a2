"""Cutting lineage with written tables in the shared checkpoint folder.

Used where a small intermediate is consumed several times (quantile results,
the customer table that feeds its own quantile edges, the cascade's narrow
value table): the consumers then read a leaf instead of re-planning, and
re-running, the upstream. Never a local checkpoint: a lost executor must not
lose the data. The tables stay until ``release_scratch`` (or the end of a
``scratch_scope``) deletes them: a lazy result may still read them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tillwise.session import derived_path, scratch_scope


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` once and write it to the shared folder."""
    return materialize_table(df, "small")


def materialize_table(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Compute ``df`` once and write it as a Parquet table in the shared folder (or at ``path``);
    later reads get column pruning and filter pushdown (for wide line-level data)."""
    spark = df.sparkSession
    path = path or derived_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def only_kept(spark: SparkSession, *names: str) -> Iterator[list[str]]:
    """``with only_kept(spark, "a", "b") as (a, b): ...``: paths for the tables that outlive the block; all others that it writes
    are deleted at its end. Nothing that is read later may need them."""
    paths = [derived_path(spark, n) for n in names]
    with scratch_scope(spark):
        yield paths
