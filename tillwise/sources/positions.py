"""Where a row stands in its files: a sortable position that a reader attaches to each row.

The position is (file, block, row): the file's path, the first byte of the split it was read from, and the row's place
there. Parquet knows the row's place in its file. Text formats do not; there, rows of a split are numbered as they
are read, and only rows of one split are compared by that number, so it does not matter which task reads which split.
A position is attached at the scan, before anything moves rows, and travels with them like any other column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITION = "_position"


def with_position(scan: DataFrame, name: str = POSITION) -> DataFrame:
    """``scan`` (what ``spark.read`` gave) with the position of each row; files follow each other by path."""
    known = scan.select("_metadata").schema["_metadata"].dataType.fieldNames()
    if "row_index" in known:
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:  # a format that does not number its rows
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    place = F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row"))
    return scan.select("*", place.alias(name))
