"""Turns of conversations in their order, dealt out so that a conversation may span any number of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Conversation, turn (null first), then role and digest of the text, so that equal rows stand side by side.
ORDER = ("conv_id", "turn", "role", "digest")


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and digest (of the text) by a range shuffle: the partitions follow each other, each is
    sorted, and a conversation of any size is cut where its share of a partition ends. Keys hold no text, and equal rows are
    told apart by the place they were read at, so none of them meet in one task."""
    known = rows.select("conv_id", "turn", "role", "text", F.sha2(F.col("text"), 256).alias("digest"), F.monotonically_increasing_id().alias("_read"))
    keys = [F.asc_nulls_first(c) for c in ORDER]
    return known.repartitionByRange(*keys, "_read").sortWithinPartitions(*keys).drop("_read")
