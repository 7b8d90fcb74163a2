"""Ordinary least squares on features that may depend on each other.

Normal equations square the condition number, and a solver that factors them breaks where a feature is a sum of
others. Here the rows are reduced by orthogonal factorisations instead: each task folds its rows, centred and scaled, into one
triangular factor of (columns + 2) squared numbers, block by block; factors are stacked and factored again in
``MERGE_TASKS`` tasks, and the few that are left on the driver. The singular values of the last factor tell the rank.
Where columns depend on each other, the coefficients are those of least norm, in the units of the data, that reach the
least squares; every choice predicts the same on rows with the same dependence.

Scale: one aggregate (means and deviations) and one pass over the columns in use. What moves is a small matrix a
task, whatever the number of rows; no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.shipping import shipped

MERGE_TASKS, BLOCK_ROWS = 64, 8192
#: Directions of the scaled features below this share of the largest one are no directions of their own.
RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class LinearFit:
    """A fitted plane: value = base + sum(coefficient * (column - centre))."""

    cols: tuple[str, ...]
    coefficients: tuple[float, ...]
    centres: tuple[float, ...]
    base: float
    rank: int
    rows: int

    @property
    def intercept(self) -> float:
        return self.base - sum(b * m for b, m in zip(self.coefficients, self.centres, strict=True))

    def value(self) -> Column:
        """The prediction as an expression over the columns (NULL where one is missing)."""
        out = F.lit(self.base)
        for c, b, m in zip(self.cols, self.coefficients, self.centres, strict=True):
            out = out + (F.col(c).cast("double") - F.lit(m)) * F.lit(b)
        return out


def _factor(rows: np.ndarray, factor: np.ndarray | None) -> np.ndarray:
    return np.linalg.qr(rows if factor is None else np.vstack([factor, rows]), mode="r")


def _factors(batches: Iterable[pa.RecordBatch], centre: list[float], scale: list[float]) -> Iterator[pa.RecordBatch]:
    """One factor of all rows of a partition; the first column is of ones, the last one is the label."""
    factor = None
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(lo, BLOCK_ROWS)
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
            factor = _factor(np.column_stack([np.ones(len(x)), (x - centre) / scale]), factor)
    yield _row(factor)


def _merged(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    factor = None
    for b in batches:
        for flat in b.column("factor").to_pylist():
            factor = _factor(np.reshape(flat, (-1, width)), factor)
    yield _row(factor)


def _row(factor: np.ndarray | None) -> pa.RecordBatch:
    rows = [] if factor is None else [factor.ravel().tolist()]
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["factor"])


def least_squares(rows: DataFrame, cols: Sequence[str], label: str, tolerance: float = RANK_TOLERANCE) -> LinearFit:
    """Fits ``label`` on ``cols`` with an intercept. Every row must have all of them: a missing one is an error. Constant columns
    get the coefficient 0. Runs two jobs."""
    names = [*cols, label]
    x = shipped(rows).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    known = [F.col(f"x{i}") for i in range(len(names))]
    stats = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c.isNull() | F.isnan(c)).alias(f"bad{i}") for i, c in enumerate(known)],
                  *[F.avg(c).alias(f"m{i}") for i, c in enumerate(known)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(known)]).first()
    if not stats["n"]:
        raise ValueError("no rows to fit")
    bad = [c for i, c in enumerate(names) if stats[f"bad{i}"]]
    if bad:
        raise ValueError(f"missing values in {', '.join(bad)}")
    centre = [stats[f"m{i}"] for i in range(len(names))]
    # a constant column leaves rounding noise behind its mean: no scale, and no direction, of its own
    varies = [stats[f"s{i}"] > 1e-12 * abs(m) for i, m in enumerate(centre)]
    scale = [stats[f"s{i}"] if ok else 1.0 for i, ok in enumerate(varies)]
    factors = x.mapInArrow(partial(_factors, centre=centre, scale=scale), "factor array<double>").repartition(MERGE_TASKS)
    few = factors.mapInArrow(partial(_merged, width=len(names) + 1), "factor array<double>").collect()
    factor = None
    for r in few:
        factor = _factor(np.reshape(r["factor"], (-1, len(names) + 1)), factor)

    a, z = factor[:, :-1].copy(), factor[:, -1]
    a[:, [1 + i for i, ok in enumerate(varies[:-1]) if not ok]] = 0.0
    u, s, vt = np.linalg.svd(a, full_matrices=True)
    rank = int((s > tolerance * s[0]).sum())
    w = vt[:rank].T @ ((u[:, :rank].T @ z) / s[:rank])
    unit = scale[-1] / np.array(scale[:-1])
    b = w[1:] * unit
    if rank < len(vt):  # what may be added without a change of the values goes, in the units of the data
        free = np.linalg.qr((vt[rank:, 1:] / np.array(scale[:-1])).T)[0]
        b = b - free @ (free.T @ b)
    b = np.where(varies[:-1], b, 0.0)
    return LinearFit(tuple(cols), tuple(map(float, b)), tuple(centre[:-1]), float(centre[-1] + w[0] * scale[-1]), rank - 1, stats["n"])
