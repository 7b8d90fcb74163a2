"""tillwise: retail customer and product analytics as lazy Spark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``; scalars (maxima, quantile edges, thresholds) travel
as one-row DataFrames joined back with a broadcast cross join, never through
the driver.
"""

from tillwise.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
