"""Exact, linearly interpolated quantiles computed as a distributed Spark job.

Definition (the "linear" rule of the common array libraries): for n values
sorted ascending and a probability p, let pos = (n - 1) * p, g = pos - floor(pos),
a = v[floor(pos)], b = v[ceil(pos)] (0-based ranks); the quantile is
a + (b - a) * g when g < 0.5 and b - (b - a) * (1 - g) otherwise. The two-sided
form is what those libraries evaluate, so results agree to the last bit.

Why not ``percentile`` or ``percentile_approx``: ``percentile`` keeps a
value -> count map that is merged in ONE task for a global aggregate, so its
memory grows with the number of distinct values (prices, per-customer money);
``percentile_approx`` / ``approxQuantile`` / ``summary`` do not interpolate and
are not exact.

Plan, all DataFrame operators, no collect:

1. ``groupBy(keys, v)`` - the distinct values with their counts, written once to
   the shared folder. Map-side partial aggregation folds a hot value or a hot group
   before the shuffle.
2. Per group, up to ``SPLITS`` split values (approximate quantiles of the distinct
   values; one small row per group), written once as well. They only cut the work
   into buckets of similar size: the result does not depend on which splits they
   are, so their approximation is harmless. They are data, so every later read
   sees the same buckets: nothing is matched on a partition id, and no exchange
   has to be reused for the ranks to be right.
3. A value's bucket is the number of splits below it. Bucket totals (at most
   ``SPLITS`` + 1 rows per group) and their prefix sums give each bucket's rank span.
4. Only buckets that hold a wanted rank are read again; a running count inside
   them (each is 1 / SPLITS of a group's distinct values) gives exact ranks, and
   one small aggregate per group interpolates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize as _materialize
from tillwise.functions.materialize import materialize_table

SPLITS = 512  # 8 * 8 * 8, see _count_below
_V, _C, _N, _K, _B = "_q_v", "_q_c", "_q_n", "_q_key", "_q_bucket"


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float],
                    by: Sequence[str] = (), out: str = "q", count_col: str = "n",
                    weight: str | None = None, materialize: bool = True, folded: bool = False) -> DataFrame:
    """Exact linear quantiles of ``value`` for each group of ``by``.

    Returns one row per group that has at least one non-missing value:
    ``by..., n (non-missing count), q (array<double>, same order as probs)``.
    Without ``by`` there is always one row; with no value at all it is n = 0 and
    NULL quantiles. NULL and NaN are ignored, as missing values are. ``weight``
    names an integer column of row multiplicities (for pre-aggregated input); ``folded``
    says that ``df`` is a written table with one row for each group and value, which is
    then not folded and written again.
    Runs jobs when called (the counted values and the splits); the result (a few
    rows) is checkpointed by default so consumers read a leaf, not this plan.
    """
    probs = [float(p) for p in probs]
    if not probs or any(p < 0.0 or p > 1.0 for p in probs):
        raise ValueError("probabilities must lie in [0, 1]")
    by = list(by)
    keys = by or [_K]
    vcol = F.col(value) if isinstance(value, str) else value
    wcol = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    src = df.select(*[F.col(k) for k in by], vcol.cast("double").alias(_V), wcol.alias("_q_w"))
    if not by:
        src = src.withColumn(_K, F.lit(0))
    src = src.where(F.col(_V).isNotNull() & ~F.isnan(F.col(_V)) & (F.col("_q_w") > 0))

    counted = src.withColumnRenamed("_q_w", _C) if folded else materialize_table(src.groupBy(*keys, _V).agg(F.sum("_q_w").alias(_C)), "counted")
    cuts = [i / SPLITS for i in range(1, SPLITS)]
    splits = materialize_table(counted.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(_V, cuts, 4 * SPLITS))).alias("_q_splits")), "splits")
    ranged = _null_safe_join(counted, splits, keys).withColumn(_B, _count_below(F.col("_q_splits"), F.col(_V))).drop("_q_splits")

    result = _pick(ranged, keys, by, probs, out, count_col)
    return _materialize(result) if materialize else result


def _pick(ranged: DataFrame, keys: list[str], by: list[str], probs: list[float], out: str, count_col: str, folded: bool = True) -> DataFrame:
    """The quantiles of weighted values in buckets (``keys``, value, count, bucket). ``folded``: equal values are one row
    already; else only those of the buckets that hold a wanted rank are folded."""
    upto = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranged.groupBy(*keys, _B).agg(F.sum(_C).alias("_q_t"))
    buckets = totals.select(*keys, _B, "_q_t", (F.sum("_q_t").over(upto) - F.col("_q_t")).alias("_q_off"),
                            F.sum("_q_t").over(Window.partitionBy(*keys)).alias(_N))

    def pos(p: float) -> Column:
        return (F.col(_N) - 1).cast("double") * F.lit(p)

    def spans(rank: Column, low: Column, high: Column) -> Column:
        return (low <= rank) & (rank < high)

    ranks = [r for p in probs for r in (F.floor(pos(p)), F.ceil(pos(p)))]
    off = F.col("_q_off")
    wanted = buckets.where(_any([spans(r, off, off + F.col("_q_t")) for r in ranks])).drop("_q_t")
    running = Window.partitionBy(*keys, _B).orderBy(_V).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not by:
        wanted = F.broadcast(wanted)  # a bucket or two for each probability
    inside = _null_safe_join(ranged, wanted, keys, [_B])
    if not folded:
        inside = inside.groupBy(*keys, _B, _V, "_q_off", _N).agg(F.sum(_C).alias(_C))
    inside = inside.withColumn("_q_after", off + F.sum(_C).over(running)) \
        .withColumn("_q_before", F.col("_q_after") - F.col(_C))

    def covers(rank: Column) -> Column:
        return spans(rank, F.col("_q_before"), F.col("_q_after"))

    picked = inside.where(_any([covers(r) for r in ranks]))
    aggs = [F.max(_N).alias(_N)]
    for i, p in enumerate(probs):
        aggs.append(F.max(F.when(covers(F.floor(pos(p))), F.col(_V))).alias(f"_q_lo{i}"))
        aggs.append(F.max(F.when(covers(F.ceil(pos(p))), F.col(_V))).alias(f"_q_hi{i}"))
    picked = picked.groupBy(*by).agg(*aggs)

    qs = []
    for i, p in enumerate(probs):
        lo, hi = F.col(f"_q_lo{i}"), F.col(f"_q_hi{i}")
        g = pos(p) - F.floor(pos(p)).cast("double")
        qs.append(F.when(g >= 0.5, hi - (hi - lo) * (F.lit(1.0) - g)).otherwise(lo + (hi - lo) * g))
    n = F.col(_N) if by else F.coalesce(F.col(_N), F.lit(0))
    return picked.select(*[F.col(k) for k in by], n.alias(count_col), F.array(*qs).alias(out))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """Inner join on columns of both sides, kept once; a NULL group key is a group like any other (``plain`` keys are never NULL)."""
    a, b = left.alias("_q_l"), right.alias("_q_r")
    cond = None
    for k in [*keys, *plain]:
        same = F.col(f"_q_l.{k}") == F.col(f"_q_r.{k}") if k in plain else F.col(f"_q_l.{k}").eqNullSafe(F.col(f"_q_r.{k}"))
        cond = same if cond is None else cond & same
    both = {*keys, *plain}
    return a.join(b, cond).select(*[F.col(f"_q_l.{c}") for c in left.columns], *[F.col(f"_q_r.{c}") for c in right.columns if c not in both])


def _count_below(splits: Column, v: Column) -> Column:
    """How many of the ascending splits lie below v (SPLITS - 1 at most): three levels of seven plain comparisons each, which
    whole-stage code runs; a level's result is one common subexpression of the next. Past the array's end nothing is below."""
    def below(at: Column, width: int) -> Column:
        return sum((F.when(F.get(splits, at + (i * width - 1)) < v, F.lit(width)).otherwise(F.lit(0)) for i in range(1, 8)), at)

    found = F.lit(0)
    for width in (64, 8, 1):
        found = below(found, width)
    return found


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def qcut_probs(q: int) -> list[float]:
    """Probabilities of the q + 1 edges of q equal-count bins, produced the way
    the reference's binning produces them: ``linspace(0, 1, q + 1)`` passed on as
    percentages (x 100, then / 100). For q = 5 the fourth is 0.6000000000000001."""
    import numpy as np
    return np.true_divide(np.linspace(0, 1, q + 1) * 100.0, 100).tolist()


def quantile_edges(df: DataFrame, value: str, q: int = 5, by: Sequence[str] = (),
                   out: str = "edges") -> DataFrame:
    """Bin edges of ``q`` equal-count bins, repeated edges dropped (ascending)."""
    probs = qcut_probs(q)
    qs = exact_quantiles(df, value, probs, by=by, out="_q_all")
    return qs.select(*by, F.array_sort(F.array_distinct("_q_all")).alias(out))


def bin_by_edges(x: Column, edges: Column, max_edges: int, reverse: bool = False) -> Column:
    """1-based bin of ``x`` among right-closed intervals over ``edges``.

    Intervals are (e0, e1], (e1, e2], ... with the lowest value e0 in the first
    bin. With b = size(edges) - 1 bins the result lies in 1..b (clamped, so a
    value that drifts past the top edge by an ulp stays in the top bin);
    ``reverse`` maps bin k to b + 1 - k. Fewer than two edges -> NULL.
    ``max_edges`` bounds the unrolled comparison (q + 1), which keeps the
    expression inside whole-stage codegen instead of a lambda.
    """
    below = None
    for i in range(max_edges):
        term = F.when(F.get(edges, i) < x, F.lit(1)).otherwise(F.lit(0))
        below = term if below is None else below + term
    nbins = F.size(edges) - 1
    k = F.least(nbins, F.greatest(F.lit(1), below))
    if reverse:
        k = nbins + 1 - k
    return F.when(x.isNotNull() & (nbins >= 1), k).cast("int")
