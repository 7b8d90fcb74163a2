"""Data-quality profiles (P1-P12). Each returns a small report DataFrame.

Per-column reports are computed by ONE aggregate over all columns (wide), then
turned into one row per column; quantiles come from the exact distributed
quantile job over the columns stacked long, so every column shares one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.materialize import materialize_table
from tillwise.functions.numeric import nan_to_null
from tillwise.functions.prefix import running_totals
from tillwise.functions.quantiles import exact_quantiles
from tillwise.sources.positions import POSITION

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def columns_of_type(df: DataFrame, kind: str) -> list[str]:
    """Column names by type class: 'string' (text) or 'numeric'. Schema only, no job."""
    if kind == "string":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if kind == "numeric":
        return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    raise ValueError("kind must be 'string' or 'numeric'")


def _rows_per_column(one_row: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn a one-row frame with columns ``{field}__{col}`` into one row per column."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols]
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))


def column_info(df: DataFrame) -> DataFrame:
    """Column, Spark type and non-missing count (one aggregate)."""
    cols = df.columns
    one = df.agg(*[F.count(F.col(c)).alias(f"non_null__{c}") for c in cols])
    types = dict(df.dtypes)
    out = _rows_per_column(one, cols, ["non_null"])
    mapping = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return out.select("column", mapping[F.col("column")].alias("dtype"), "non_null")


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns stacked long: by..., column, value (double, NaN as missing)."""
    structs = [F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c).cast("double")).alias("value"))
               for c in cols]
    return df.select(*by, F.explode(F.array(*structs)).alias("_s")).select(*by, "_s.column", "_s.value")


def grouped_describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """P3 per group: by..., column, count, mean, std (n-1), min, q25, q50, q75, max.

    One read of the source: equal values of a column fold to one row with a count (map-side first), and every
    statistic comes from that table. Nothing is rounded here. A column without any value has count 0 and NULL statistics.
    """
    by = list(by)
    keys = [*by, "column"]
    counted = materialize_table(_long(df, cols, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c")), "values")
    v, c = F.col("value"), F.col("_c")
    n = F.sum(F.when(v.isNotNull(), c))
    moments = counted.groupBy(*keys).agg(F.coalesce(n, F.lit(0)).alias("count"), (F.sum(v * c) / n).alias("mean"),
                                         F.min(v).alias("min"), F.max(v).alias("max"))
    spread = _same(counted, moments.select(*keys, "mean", "count"), keys).where(v.isNotNull()) \
        .groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))), F.max("count") - 1)).alias("std"))
    qs = exact_quantiles(counted, "value", [0.25, 0.5, 0.75], by=keys, out="_q", count_col="_qn", weight="_c", materialize=False, folded=True)
    joined = _same(_same(moments, spread, keys, "left"), qs, keys, "left")
    return joined.select(*by, "column", "count", "mean", "std", "min",
                         F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"),
                         F.col("_q")[2].alias("q75"), "max")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the right side's other columns come along."""
    a, b = left.alias("_l"), right.alias("_r")
    cond = reduce(lambda x, y: x & y, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    return a.join(b, cond, how).select(*[F.col(f"_l.{c}") for c in left.columns],
                                       *[F.col(f"_r.{c}") for c in right.columns if c not in left.columns])


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Describe the numeric columns (exact quantiles, not approximate)."""
    return grouped_describe(df, list(cols) if cols is not None else columns_of_type(df, "numeric"))


_EPOCH = "1970-01-01 00:00:00"


def describe_datetime(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P3 for date-time columns: column, count, mean, min, q25, q50, q75, max
    (no deviation). Computed on microseconds since 1970-01-01 without any time
    zone (``timestamp_diff`` on ``timestamp_ntz``); mean and quartiles are
    truncated to the microsecond."""
    if cols is None:
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType))]
    epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    structs = [F.struct(F.lit(c).alias("column"),
                        F.timestamp_diff("MICROSECOND", epoch, F.col(c).cast("timestamp_ntz")).alias("us"))
               for c in cols]
    long = df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.column", "_s.us")

    def back(us):
        return F.timestamp_add("MICROSECOND", us, epoch)

    moments = long.groupBy("column").agg(
        # exact integer sum, then one division: independent of summation order
        F.count("us").alias("count"),
        (F.sum(F.col("us").cast("decimal(38,0)")).cast("double") / F.count("us")).alias("_mean"),
        F.min("us").alias("_min"), F.max("us").alias("_max"))
    qs = exact_quantiles(long, "us", [0.25, 0.5, 0.75], by=["column"], out="_q", count_col="_qn")
    j = moments.join(qs, "column", "left")
    trunc = lambda c: F.col(c).cast("long")  # noqa: E731  (double -> long truncates)
    return j.select("column", "count", back(trunc("_mean")).alias("mean"), back(F.col("_min")).alias("min"),
                    back(F.col("_q")[0].cast("long")).alias("q25"), back(F.col("_q")[1].cast("long")).alias("q50"),
                    back(F.col("_q")[2].cast("long")).alias("q75"), back(F.col("_max")).alias("max"))


def preview(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """The first n rows by a key (all columns when no key is given)."""
    return df.orderBy(*(order or df.columns)).limit(n)


def head(df: DataFrame, n: int = 5, position: str = POSITION) -> DataFrame:
    """The first n rows of the files, by the position that the reader attached. The least n of each task meet, not the rows."""
    return df.orderBy(position).limit(n).drop(position)


def first_seen_values(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = 50, position: str = POSITION) -> DataFrame:
    """Per text column, its first ``k`` distinct values in the order in which the files show them (missing is a value), as
    (column, rank, value); ``k=None`` gives all. One read of the source: a value folds to its least position before the shuffle."""
    cols = list(cols if cols is not None else columns_of_type(df, "string"))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.col(position).alias("_at")) for c in cols]
    # a value's least row of each split first: a plain number, which a hash aggregate folds; the least struct needs a sort, of
    # the few rows that are left
    splits = df.select(F.inline(F.array(*cells))).groupBy("column", "value", F.col("_at.file").alias("file"), F.col("_at.block").alias("block")) \
        .agg(F.min("_at.row").alias("row"))
    firsts = splits.groupBy("column", "value").agg(F.min(F.struct("file", "block", "row")).alias("_at"))
    if k is not None:
        seen = Window.partitionBy("column").orderBy("_at")
        return firsts.withColumn("rank", F.row_number().over(seen)).where(F.col("rank") <= k).select("column", "rank", "value")
    # every value: ranks by running totals over files, then over places in a file
    return _ranked_by_position(firsts)


def _ranked_by_position(firsts: DataFrame) -> DataFrame:
    """Ranks of any number of values: each file's values are counted by block and by place (``running_totals``), no task sorts them all."""
    at = firsts.select("column", "value", F.col("_at.file").alias("file"), F.col("_at.block").alias("block"), F.col("_at.row").alias("row"), F.lit(1).alias("n"))
    splits = at.groupBy("column", "file", "block").agg(F.count(F.lit(1)).alias("in_split"))
    before = Window.partitionBy("column").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("in_split").over(before), F.lit(0))).drop("in_split")
    places = running_totals(at, "row", ["n"], by=["column", "file", "block"])
    return at.drop("n").join(places, ["column", "file", "block", "row"]).join(splits, ["column", "file", "block"]).select(
        "column", (F.col("before") + F.col("n_before") + 1).alias("rank"), "value")


def nunique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """P5: distinct non-missing values per column; ``approx`` uses HyperLogLog++."""
    cols = list(cols or df.columns)
    if approx:
        one = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"nunique__{c}") for c in cols])
        return _rows_per_column(one, cols, ["nunique"])
    # one (column, value) row per cell, folded before the shuffle; several distinct counts in one aggregate would
    # copy each wide row once per column instead
    pairs = _text_cells(df, cols).where(F.col("value").isNotNull()).distinct()
    counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("_n"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("_n", F.lit(0)).alias("nunique"))


def _text_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value as text): one row per cell, from one read."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*cells)))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column (NaN counts as missing)."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)

    def missing(c):
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return m

    one = df.agg(*[F.count_if(missing(c)).alias(f"missing__{c}") for c in cols])
    return _rows_per_column(one, cols, ["missing"])


def distinct_values(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = 50) -> DataFrame:
    """Per text column, up to ``k`` distinct values (missing is a
    value), smallest first; ``k=None`` gives all of them. One read of the source for
    all columns; the limit is a group limit per partition ahead of the shuffle."""
    cols = list(cols if cols is not None else columns_of_type(df, "string"))
    values = _text_cells(df, cols).distinct()
    if k is None:
        return values
    first = Window.partitionBy("column").orderBy(F.asc_nulls_first("value"))
    return values.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")


def boxplot_stats(df: DataFrame, cols: Sequence[str] | None = None, whis: float = 1.5) -> DataFrame:
    """Per numeric column the box-plot statistics: q1, median, q3, whisker
    ends (furthest values within whis*IQR of the box) and the number of fliers."""
    cols = list(cols if cols is not None else columns_of_type(df, "numeric"))
    j = _with_fences(df, cols, whis)
    v = F.col("value")
    return j.groupBy("column").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), F.col("_c"))), F.lit(0)).alias("n_fliers"))


def _with_fences(df: DataFrame, cols: Sequence[str], whis: float) -> DataFrame:
    """column, value, _c (its rows), q1, median, q3, _lo and _hi: one row per distinct value."""
    long = materialize_table(_long(df, cols).where(F.col("value").isNotNull())
                             .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c")), "values")
    qs = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column"], out="_q", count_col="_n", weight="_c", folded=True)
    fences = qs.select("column", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                       F.col("_q")[2].alias("q3"))
    fences = fences.withColumns({
        "_lo": F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1")),
        "_hi": F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))})
    # one row per profiled column: bounded by the number of columns
    return long.join(F.broadcast(fences), "column")


def boxplot_fliers(df: DataFrame, cols: Sequence[str] | None = None, whis: float = 1.5) -> DataFrame:
    """The outlier points of the box plots, folded by value: column, side ('low' or 'high'), value, count (its rows),
    rank (1 for the value farthest out on its side) and points_before (rows farther out). A chart or a caller takes ranks a to b,
    or points a to b, of a side; no task sorts a side's points."""
    cols = list(cols if cols is not None else columns_of_type(df, "numeric"))
    v = F.col("value")
    side = F.when(v < F.col("_lo"), "low").when(v > F.col("_hi"), "high")
    out = _with_fences(df, cols, whis).select("column", side.alias("side"), F.when(side == "low", v).otherwise(-v).alias("_outward"),
                                              F.col("_c").alias("count"), F.lit(1).alias("one")).where(F.col("side").isNotNull())
    ranked = running_totals(out, "_outward", ["count", "one"], by=["column", "side"])
    return ranked.select("column", "side", F.when(F.col("side") == "low", F.col("_outward")).otherwise(-F.col("_outward")).alias("value"), "count",
                         (F.col("one_before") + 1).alias("rank"), F.col("count_before").alias("points_before"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, and whether the key is unique."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys")
                  ).withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """P10: rows that repeat an earlier identical row (missing equals missing)."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
