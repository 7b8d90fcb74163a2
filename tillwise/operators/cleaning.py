"""Cleaning: missing values, numeric coercion, positivity, ids, duplicates, IQR outliers.

All steps are lazy projections and filters except ``dedupe`` (one shuffle on the
full row; map-side partial aggregation folds a heavily copied row before the
shuffle), the IQR bounds (an exact-quantile job whose one-row result is
attached by a broadcast cross join) and the cascade (a query a column). The whole
pipelines find copies by fingerprints (``functions.fingerprints``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.cascade import cascade_fences, within
from tillwise.functions.fingerprints import distinct_rows
from tillwise.functions.materialize import materialize as _materialize
from tillwise.functions.materialize import materialize_table
from tillwise.functions.numeric import coerce_double
from tillwise.functions.quantiles import exact_quantiles
from tillwise.functions.scalars import attach_scalars
from tillwise.schema import CUSTOMER, QUANTITY, TOTAL_PRICE, TX_COLUMNS, UNIT_PRICE

LINE_OUTLIER_COLUMNS = [QUANTITY, UNIT_PRICE, TOTAL_PRICE]
RFM_OUTLIER_COLUMNS = ["Recency", "Frequency", "Monetary"]


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """C1 (all columns) / C2 (``subset``): drop rows with a missing value.
    Floating NaN counts as missing, as it does in a dataframe library."""
    cols = list(subset) if subset is not None else df.columns
    cond = None
    for c in cols:
        ok = _nan_as_null(df, c).isNotNull()
        cond = ok if cond is None else cond & ok
    return df if cond is None else df.where(cond)


def _nan_as_null(df: DataFrame, c: str):
    """The column with NaN read as NULL, naming the column once: a predicate on it
    that Catalyst pushes below a projection then inlines that projection once."""
    if dict(df.dtypes)[c] in ("double", "float"):
        return F.nanvl(F.col(c), F.lit(None).cast("double"))
    return F.col(c)


def coerce_numeric(df: DataFrame, cols: Sequence[str] = (QUANTITY, UNIT_PRICE)) -> DataFrame:
    """Text to double; text that is not a number becomes NULL (never an error). Columns that are numbers
    already are only widened, so a filter on them still reaches the scan."""
    types = dict(df.dtypes)
    return df.withColumns({c: coerce_double(F.col(c), types[c]) for c in cols})


def positive_only(df: DataFrame, cols: Sequence[str] = (QUANTITY, UNIT_PRICE), plain: Sequence[str] = ()) -> DataFrame:
    """C4: keep rows where every given column is > 0 (NULL and NaN fail the test; in Spark NaN > 0 is true, so NaN is
    excluded explicitly). ``plain`` columns are columns of the source, not parsed text: their test is two plain
    comparisons (NaN is above infinity), which a scan can apply; a parsed column is named once instead."""
    cond = None
    for c in cols:
        ok = (F.col(c) > 0) & (F.col(c) <= F.lit(float("inf"))) if c in plain else _nan_as_null(df, c) > 0
        cond = ok if cond is None else cond & ok
    return df.where(cond)


def to_int(df: DataFrame, col: str = CUSTOMER) -> DataFrame:
    """Fractional-typed id to a 64-bit integer (truncating)."""
    return df.withColumn(col, F.col(col).cast("bigint"))


def with_total_price(df: DataFrame) -> DataFrame:
    """TotalPrice = Quantity * UnitPrice."""
    return df.withColumn(TOTAL_PRICE, F.col(QUANTITY) * F.col(UNIT_PRICE))


def dedupe(df: DataFrame) -> DataFrame:
    """Drop repeated rows, keeping one of each."""
    return df.dropDuplicates()


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, weight: str | None = None) -> DataFrame:
    """One row: exact Q1, Q3 and the fences Q1 - k*IQR, Q3 + k*IQR of ``col``."""
    qs = exact_quantiles(df, col, [0.25, 0.75], out="_iqr_q", weight=weight)
    q1, q3 = F.col("_iqr_q")[0], F.col("_iqr_q")[1]
    return qs.select(q1.alias("q1"), q3.alias("q3"),
                     (q1 - F.lit(k) * (q3 - q1)).alias("lower_bound"),
                     (q3 + F.lit(k) * (q3 - q1)).alias("upper_bound"))


def remove_outliers_iqr(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Keep rows with lower_bound <= col <= upper_bound (inclusive)."""
    b = iqr_bounds(df, col, k).select(F.col("lower_bound").alias("_lo"),
                                      F.col("upper_bound").alias("_hi"))
    kept = attach_scalars(df, b)
    return kept.where((F.col(col) >= F.col("_lo")) & (F.col(col) <= F.col("_hi"))).drop("_lo", "_hi")


def iqr_cascade(df: DataFrame, cols: Sequence[str] = LINE_OUTLIER_COLUMNS, k: float = 1.5,
                materialize: bool = False) -> DataFrame:
    """C8 over each column in turn; each step's quartiles come from the
    rows the previous steps kept. Columns not present are skipped.

    The quartiles of all steps come from one bucketed table of the distinct column tuples (``functions.cascade``), one
    query a step, and the full rows are filtered once by all fences, which are numbers by then and reach the
    scan. Runs those jobs when called.

    ``materialize=True`` first writes the input to the shared checkpoint folder
    (cuts the lineage when the upstream is expensive or unreliable to recompute).
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if materialize:
        df = _materialize(df)
    return df.where(within(cascade_fences(df, cols, k)))


def clean(raw: DataFrame, order: str = "dedupe_first", outlier_cols: Sequence[str] = LINE_OUTLIER_COLUMNS,
          k: float = 1.5, materialize: bool = True) -> DataFrame:
    """The full cleaning pipeline over raw lines.

    ``order='outliers_first'`` (C11): drop missing -> coerce -> positive -> drop
    missing id -> id to int -> IQR cascade -> dedupe; TotalPrice as read.
    ``order='dedupe_first'`` (C12, default): drop missing -> coerce -> positive ->
    drop missing id -> id to int -> TotalPrice recomputed -> dedupe -> IQR cascade.
    The two keep different rows when copies exist, since the quartiles then see
    different populations. ``materialize`` writes the coerced lines once to the
    shared folder (default), instead of computing the upstream several times, and
    lets the copies be found by fingerprints instead of shuffling every line.
    """
    cols = [c for c in TX_COLUMNS if c in raw.columns]
    df = drop_missing(raw.select(*cols))  # the columns the input has: a file may come without TotalPrice
    numbers = [c for c, t in raw.dtypes if t != "string"]
    df = coerce_numeric(df)
    df = positive_only(df, plain=numbers)
    df = drop_missing(df, [CUSTOMER])
    df = to_int(df)
    if order not in ("dedupe_first", "outliers_first"):
        raise ValueError("order must be 'dedupe_first' or 'outliers_first'")
    if order == "dedupe_first":
        df = with_total_price(df)
    elif TOTAL_PRICE not in df.columns:
        raise ValueError("order='outliers_first' takes TotalPrice as read, and the input has none")
    # the copies are found by fingerprints of written lines; the cascade reads its input once for the value table and once
    # for the final filter: write it once (Parquet: the value table reads 3 columns)
    repeats = distinct_rows if materialize else dedupe
    if materialize:
        df = materialize_table(df, "clean-lines")
    if order == "dedupe_first":
        return iqr_cascade(repeats(df), outlier_cols, k)
    return repeats(iqr_cascade(df, outlier_cols, k))
