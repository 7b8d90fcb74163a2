"""Makes this package importable in the Python workers of every executor, for the few operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application (the driver serves them)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tillwise-code-")) / "tillwise.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its session's workers can import this package."""
    ship(df.sparkSession)
    return df
