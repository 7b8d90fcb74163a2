"""File sources with a schema declared at the edge (no inference pass over the data).

S1 reads transaction lines from CSV or Parquet. The original input was a
spreadsheet; Spark has no spreadsheet source, so that single-machine codec is
not built: export the sheet to CSV/Parquet first.

S2 reads the precomputed customer (RFM) table from a CSV file with a header.
Missing markers are normalised the way a dataframe CSV reader treats them
(empty, NA, N/A, null, nan, ...).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.sources.positions import POSITION, with_position
from tillwise.schema import F_SCORE, M_SCORE, R_SCORE, RAW_TX_SCHEMA, RFM_SCHEMA, RFM_SCORE, SEGMENT, TOTAL_PRICE

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Text a dataframe CSV reader takes as missing by default.
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                   "n/a", "nan", "null"]

JUNK_COLUMNS = ["Unnamed: 8", "CheckBlank"]


#: Columns a file may lack: they are computed or scored anyway.
OPTIONAL_TX = (TOTAL_PRICE,)
OPTIONAL_RFM = (R_SCORE, F_SCORE, M_SCORE, RFM_SCORE, SEGMENT)


#: Text of a row that has not as many fields as its header.
BROKEN = "_broken_line"


def read_transactions(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", header: bool = True,
                      multi_line: bool = False, timestamp_format: str | None = None, position: str | None = None) -> DataFrame:
    """Raw transaction lines with the declared raw schema.

    Columns are matched by NAME (a header CSV is read as text, no inference pass),
    so column order and extra columns such as the junk ``Unnamed: 8`` /
    ``CheckBlank`` do not matter. The files of one path must have one header, else
    the query fails; pass a list of paths for files that differ, each is matched by
    its own header. A file without ``TotalPrice`` gives lines without that column;
    any other declared column that is absent is an error.

    CSV fields may be quoted, with quotes inside doubled (``multi_line`` for line
    breaks in them). ``timestamp_format``: a pattern tried where a date is not in
    ISO form, such as ``M/d/yyyy H:mm``. ``position`` names a column for the place of
    each row in its files (``sources.positions``). A CSV row with too few or too many
    fields is filled up or cut; ``read_transactions_rescued`` sets such rows apart.
    """
    parts = []
    for p in [path] if isinstance(path, str) else path:
        if fmt == "parquet":
            df = spark.read.parquet(p)
            df = with_position(df, position) if position else df
        elif fmt == "csv":
            df = _csv(spark, p, header, multi_line, position=position)
        else:
            raise ValueError(f"unsupported format {fmt!r}; export spreadsheets to csv or parquet")
        parts.append(_typed(df, RAW_TX_SCHEMA, fmt == "csv", OPTIONAL_TX, p, timestamp_format, [position] if position else []))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_transactions_rescued(spark: SparkSession, path: str | Sequence[str], header: bool = True, multi_line: bool = False,
                              timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 for CSV files that may be broken: (lines, rejected). Rows whose number of fields differs from the header's are no
    lines: they come out in the second frame as (file, block, line), with their text as it stands in the file. Every row of the
    files is in one of the two frames, empty lines in neither."""
    lines, rejected = [], []
    for p in [path] if isinstance(path, str) else path:
        df = _csv(spark, p, header, multi_line, broken=BROKEN, position=POSITION)
        # Spark refuses to read the text of broken rows alone, so both filters look at a field as well
        read = F.coalesce(F.length(F.col(f"`{df.columns[0]}`")), F.lit(0)) >= 0
        rejected.append(df.where(F.col(BROKEN).isNotNull() & read).select(f"{POSITION}.file", f"{POSITION}.block", F.col(BROKEN).alias("line")))
        lines.append(_typed(df.where(F.col(BROKEN).isNull() & read), RAW_TX_SCHEMA, True, OPTIONAL_TX, p, timestamp_format))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lines), reduce(DataFrame.unionByName, rejected)


def read_rfm(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """The precomputed customer table (header CSV) with the declared RFM schema; headers as in
    ``read_transactions``. Scores and segment may be absent."""
    parts = [_typed(_csv(spark, p, True, multi_line), RFM_SCHEMA, True, OPTIONAL_RFM, p) for p in ([path] if isinstance(path, str) else path)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv(spark: SparkSession, path: str, header: bool, multi_line: bool, broken: str | None = None, position: str | None = None) -> DataFrame:
    """Text columns named by the header; a second file with another header fails instead of being read by position. ``broken``
    names a column for the text of rows with a wrong number of fields (NULL for others)."""
    options = {"header": header, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "multiLine": multi_line}
    if header:
        names = spark.read.options(**options).csv(path).columns  # the first line of one file
        options["enforceSchema"] = False
    else:
        names = [f.name for f in RAW_TX_SCHEMA.fields]
    if broken:
        names = [*names, broken]
        # a row is only measured where all of its fields are parsed
        options |= {"columnNameOfCorruptRecord": broken, "columnPruning": False}
    df = spark.read.options(**options).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    return with_position(df, position) if position else df


def _typed(df: DataFrame, schema: T.StructType, text: bool, optional: Sequence[str], path: str,
           timestamp_format: str | None = None, more: Sequence[str] = ()) -> DataFrame:
    present = dict(df.dtypes)
    absent = [f.name for f in schema.fields if f.name not in present and f.name not in optional]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    out = []
    for f in schema.fields:
        if f.name not in present:
            continue
        c = F.col(f"`{f.name}`")
        if text:
            c = _missing_to_null(c)
        if isinstance(f.dataType, T.StringType):
            # numbers stay numbers: a filter on them can reach the scan
            number = not text and present[f.name] in NUMBERS or present[f.name].startswith("decimal")
            out.append((c if number else c.cast("string")).alias(f.name))
        elif isinstance(f.dataType, T.TimestampNTZType) and text:
            iso = c.try_cast(f.dataType)
            if timestamp_format:
                iso = F.coalesce(iso, F.try_to_timestamp(c, F.lit(timestamp_format)).cast(f.dataType))
            out.append(iso.alias(f.name))
        elif text and isinstance(f.dataType, (T.IntegerType, T.LongType)):
            # integer columns written by a dataframe library may carry '.0'
            out.append(c.try_cast("double").cast(f.dataType).alias(f.name))
        elif text:
            out.append(c.try_cast(f.dataType).alias(f.name))
        else:
            out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out, *more)


def write_rfm_csv(rfm: DataFrame, path: str) -> str:
    """Write a customer table as header CSV (the S2 input format); returns the path."""
    cols = [f.name for f in RFM_SCHEMA.fields]
    rfm.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return path


def _missing_to_null(c):
    trimmed = F.trim(c)
    return F.when(c.isNull() | trimmed.isin(MISSING_MARKERS), F.lit(None).cast("string")).otherwise(c)
