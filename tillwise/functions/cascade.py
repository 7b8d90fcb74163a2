"""Fences of an IQR cascade: each column's quartiles come from the rows that the fences before it kept.

The weighted tuples of all columns are put into buckets once, along splits of every column that one pass finds, and
written. A step then is one query over that table: bucket totals of the rows still kept, the buckets that hold the ranks of
the quartiles, exact running counts inside those. Its two fences are numbers, so the next step's filter, and
that of the full rows, reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.functions.quantiles import _B, _C, _K, _V, SPLITS, _count_below, _pick
from tillwise.functions.scalars import attach_scalars

Fence = tuple[float | None, float | None]


def within(fences: dict[str, Fence]) -> Column:
    """True for rows inside all fences (inclusive); a fence of a column without values keeps nothing."""
    cond = F.lit(True)
    for c, (lo, hi) in fences.items():
        cond = cond & (F.col(f"`{c}`") >= F.lit(lo).cast("double")) & (F.col(f"`{c}`") <= F.lit(hi).cast("double"))
    return cond


def cascade_fences(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, Fence]:
    """The fences of each column in turn: Q1 - k * IQR and Q3 + k * IQR, exact, of the rows that the earlier ones keep.
    NULL and NaN are no values. Two jobs for the table, one a column."""
    names = {c: f"v{i}" for i, c in enumerate(cols)}
    values = df.select(*[F.col(c).cast("double").alias(v) for c, v in names.items()])
    tuples = materialize_table(values.groupBy(*names.values()).agg(F.count(F.lit(1)).alias(_C)), "cascade-tuples")
    cuts = [i / SPLITS for i in range(1, SPLITS)]
    splits = tuples.agg(*[F.array_sort(F.array_distinct(F.percentile_approx(F.nanvl(v, F.lit(None).cast("double")), cuts, 4 * SPLITS))).alias(f"s_{v}")
                          for v in names.values()])
    table = attach_scalars(tuples, splits).withColumns({f"b_{v}": _count_below(F.col(f"s_{v}"), F.col(v)) for v in names.values()})
    table = materialize_table(table.drop(*[f"s_{v}" for v in names.values()]), "cascade-buckets")
    fences: dict[str, Fence] = {}
    for c, v in names.items():
        kept = table.where(within({names[x]: f for x, f in fences.items()}) & F.col(v).isNotNull() & ~F.isnan(v))
        rows = kept.select(F.lit(0).alias(_K), F.col(v).alias(_V), _C, F.col(f"b_{v}").alias(_B))
        q1, q3 = _pick(rows, [_K], [], [0.25, 0.75], "q", "n", folded=False).first()["q"]
        fences[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return fences
