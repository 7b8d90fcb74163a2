"""Independent DuckDB SQL for the named analyses (the correctness oracle).

Each string runs on the test tables registered as views (lineitem, orders,
part, customer, nation, events, ...) and builds the same fixtures with the
same expressions as ``tillwise.sources.testdata``. Column names and types
match the Spark results. The regression is solved here by orthogonalising one
feature after the other. The forest (``NOT_SQL``) has no SQL: its tests train it
on rows that a plain version can follow.
"""

from __future__ import annotations

# ------------------------------------------------------------------ fixtures

_JOIN = """
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey"""

TX = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
       CAST(l_partkey AS VARCHAR) AS StockCode,
       p_name AS Description,
       CAST(l_quantity AS DOUBLE) AS Quantity,
       CAST(o_orderdate AS TIMESTAMP) AS InvoiceDate,
       l_extendedprice / l_quantity AS UnitPrice,
       CAST(o_custkey AS BIGINT) AS CustomerID,
       n_name AS Country,
       CAST(l_extendedprice AS DOUBLE) AS TotalPrice
{_JOIN}"""

DIRTY = f"""
WITH d0 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
         CAST(l_partkey AS VARCHAR) AS StockCode,
         p_name AS Description,
         CASE WHEN o_orderkey % 89 = 0 THEN 'n/a'
              WHEN o_orderkey % 83 = 0 THEN CAST(-l_quantity AS VARCHAR)
              ELSE CAST(l_quantity AS VARCHAR) END AS Quantity,
         CAST(o_orderdate AS TIMESTAMP) AS InvoiceDate,
         CAST(l_extendedprice / l_quantity AS VARCHAR) AS UnitPrice,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID,
         n_name AS Country,
         CAST(l_extendedprice AS DOUBLE) AS TotalPrice,
         o_orderkey AS k
  {_JOIN}
)
SELECT * EXCLUDE (k) FROM d0
UNION ALL
SELECT * EXCLUDE (k) FROM d0 WHERE k % 53 = 0"""


def _coarse(invoices: int) -> str:
    return f"SELECT * REPLACE (CAST(CAST(InvoiceNo AS BIGINT) % {invoices} AS VARCHAR) AS InvoiceNo) FROM ({TX})"


CLOCK = f"""
SELECT * REPLACE (InvoiceDate + to_hours(
         CAST((date_diff('day', DATE '1995-01-01', CAST(InvoiceDate AS DATE)) * 7) % 24 AS BIGINT))
         AS InvoiceDate)
FROM ({TX})"""

EVENTS = """
SELECT CAST(event_id AS VARCHAR) AS InvoiceNo,
       CAST(NULL AS VARCHAR) AS StockCode,
       CAST(NULL AS VARCHAR) AS Description,
       CAST(1.0 AS DOUBLE) AS Quantity,
       CAST(ts AS TIMESTAMP) AS InvoiceDate,
       CAST(value AS DOUBLE) AS UnitPrice,
       CAST(user_id AS BIGINT) AS CustomerID,
       CAST(NULL AS VARCHAR) AS Country,
       CAST(value AS DOUBLE) AS TotalPrice
FROM events WHERE event_type = 'purchase'"""

NUM_RE = (r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
          r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")


def _coerce(col: str) -> str:
    parsed = f"CASE WHEN regexp_matches({col}, '{NUM_RE}') THEN TRY_CAST({col} AS DOUBLE) END"
    return f"CASE WHEN isnan({parsed}) THEN NULL ELSE {parsed} END"


def _money_sum(col: str) -> str:
    return f"CAST(sum(CAST({col} AS DECIMAL(18, 4))) AS DOUBLE)"


def _with(*ctes: tuple[str, str], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


# ------------------------------------------------------------- building blocks

def _rfm_ctes(src: str, churn_days: int | None = None) -> list[tuple[str, str]]:
    churn = ""
    if churn_days is not None:
        churn = (f",\n CAST(last_purchase < (SELECT max(last_purchase) FROM rfm_base) "
                 f"- INTERVAL {churn_days} DAY AS INTEGER) AS Churn")
    return [
        ("rfm_base", f"""
SELECT CustomerID, max(InvoiceDate) AS last_purchase,
       count(DISTINCT InvoiceNo) AS freq, {_money_sum('TotalPrice')} AS Monetary
FROM {src} GROUP BY CustomerID"""),
        ("rfm", f"""
SELECT CustomerID,
       CAST(datesub('day', last_purchase,
            (SELECT max(last_purchase) FROM rfm_base) + INTERVAL 1 DAY) AS INTEGER) AS Recency,
       CAST(freq AS INTEGER) AS Frequency, Monetary{churn}
FROM rfm_base"""),
    ]


def _qcut_probs(q: int = 5) -> list[float]:
    """linspace(0, 1, q + 1) passed on as percentages (x 100, / 100), as the
    reference's binning does; the fourth of six is 0.6000000000000001."""
    import numpy as np
    return np.true_divide(np.linspace(0, 1, q + 1) * 100.0, 100).tolist()


def _sorted(col: str) -> str:
    """Aggregate: the non-missing values of ``col`` as a sorted DOUBLE list."""
    x = f"CAST({col} AS DOUBLE)"
    return f"list({x} ORDER BY {x}) FILTER (WHERE {col} IS NOT NULL AND NOT isnan({x}))"


def _qx(lst: str, p: float) -> str:
    """Linear quantile of a sorted list, written out: pos = (n - 1) * p,
    g = frac(pos); a + (b - a) * g if g < 0.5 else b - (b - a) * (1 - g)."""
    pos = f"(CAST(len({lst}) - 1 AS DOUBLE) * CAST('{p!r}' AS DOUBLE))"
    g = f"({pos} - floor({pos}))"
    a = f"{lst}[CAST(floor({pos}) AS BIGINT) + 1]"
    b = f"{lst}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (f"(CASE WHEN len({lst}) = 0 THEN NULL WHEN {g} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {g}) "
            f"ELSE {a} + ({b} - {a}) * {g} END)")


def _edges_of(lst: str) -> str:
    return "list_sort(list_distinct([" + ", ".join(_qx(lst, p) for p in _qcut_probs()) + "]))"


def _bin(edges: str, col: str, reverse: bool) -> str:
    k = f"least(len({edges}) - 1, greatest(1, len(list_filter({edges}, lambda z: z < {col}))))"
    if reverse:
        k = f"(len({edges}) - {k})"
    return f"CASE WHEN {col} IS NOT NULL AND len({edges}) >= 2 THEN CAST({k} AS INTEGER) END"


def _score_ctes(src: str = "rfm") -> list[tuple[str, str]]:
    return [
        ("lists", f"SELECT {_sorted('Recency')} AS lr, {_sorted('Frequency')} AS lf, "
                  f"{_sorted('Monetary')} AS lm FROM {src}"),
        ("edges", f"SELECT {_edges_of('lr')} AS er, {_edges_of('lf')} AS ef, {_edges_of('lm')} AS em "
                  f"FROM lists"),
        ("scored0", f"""
SELECT s.*, {_bin('er', 'Recency', True)} AS R_score,
       {_bin('ef', 'Frequency', False)} AS F_score,
       {_bin('em', 'Monetary', False)} AS M_score
FROM {src} s CROSS JOIN edges"""),
        ("scored", """
SELECT * , CAST(CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR)
                AS INTEGER) AS RFM_Score
FROM scored0"""),
        ("seg", """
SELECT *, CASE WHEN RFM_Score IS NULL THEN NULL
               WHEN RFM_Score >= 555 THEN 'Best Customers'
               WHEN RFM_Score >= 454 THEN 'Loyal Customers'
               WHEN RFM_Score >= 414 THEN 'Recent but Infrequent'
               WHEN RFM_Score >= 333 THEN 'Promising'
               WHEN RFM_Score >= 222 THEN 'At Risk'
               WHEN RFM_Score >= 111 THEN 'Lost Customers'
               ELSE 'Others' END AS Segment
FROM scored"""),
    ]


_RFM_COLS = ("CustomerID, Recency, Frequency, Monetary, R_score, F_score, M_score, "
             "RFM_Score, Segment")


def _segmented(fixture: str, churn_days: int | None = None) -> list[tuple[str, str]]:
    return [("tx", fixture), *_rfm_ctes("tx", churn_days), *_score_ctes("rfm")]


def _counts(fixture: str) -> str:
    return _with(*_segmented(fixture), final="""
SELECT Segment, count(*) AS count FROM seg WHERE Segment IS NOT NULL GROUP BY Segment""")


def _iqr_step(src: str, col: str, name: str) -> list[tuple[str, str]]:
    return [
        (f"{name}_b", f"SELECT {_qx('l', 0.25)} AS q1, {_qx('l', 0.75)} AS q3 "
                      f"FROM (SELECT {_sorted(col)} AS l FROM {src})"),
        (name, f"""
SELECT s.* FROM {src} s CROSS JOIN {name}_b b
WHERE s.{col} >= b.q1 - 1.5 * (b.q3 - b.q1) AND s.{col} <= b.q3 + 1.5 * (b.q3 - b.q1)"""),
    ]


def _cascade(src: str, cols: list[str], prefix: str) -> tuple[list[tuple[str, str]], str]:
    ctes, cur = [], src
    for i, c in enumerate(cols):
        name = f"{prefix}{i}"
        ctes += _iqr_step(cur, c, name)
        cur = name
    return ctes, cur


_NOT_MISSING = " AND ".join([
    "InvoiceNo IS NOT NULL", "StockCode IS NOT NULL", "Description IS NOT NULL",
    "Quantity IS NOT NULL", "InvoiceDate IS NOT NULL", "UnitPrice IS NOT NULL",
    "CustomerID IS NOT NULL AND NOT isnan(CustomerID)", "Country IS NOT NULL",
    "TotalPrice IS NOT NULL AND NOT isnan(TotalPrice)"])


def _dirty_c1_c5() -> list[tuple[str, str]]:
    return [
        ("dirty", DIRTY),
        ("c1", f"SELECT * FROM dirty WHERE {_NOT_MISSING}"),
        ("c3", f"SELECT * REPLACE ({_coerce('Quantity')} AS Quantity, {_coerce('UnitPrice')} AS UnitPrice) FROM c1"),
        ("c4", "SELECT * FROM c3 WHERE Quantity > 0 AND UnitPrice > 0"),
        ("c5", "SELECT * REPLACE (CAST(trunc(CustomerID) AS BIGINT) AS CustomerID) FROM c4 "
               "WHERE CustomerID IS NOT NULL AND NOT isnan(CustomerID)"),
    ]


def _clean(order: str) -> tuple[list[tuple[str, str]], str]:
    ctes = _dirty_c1_c5()
    if order == "outliers_first":
        casc, last = _cascade("c5", ["Quantity", "UnitPrice", "TotalPrice"], "o")
        return ctes + casc + [("cleaned", f"SELECT DISTINCT * FROM {last}")], "cleaned"
    ctes += [("c6", "SELECT * REPLACE (Quantity * UnitPrice AS TotalPrice) FROM c5"),
             ("c7", "SELECT DISTINCT * FROM c6")]
    casc, last = _cascade("c7", ["Quantity", "UnitPrice", "TotalPrice"], "o")
    return ctes + casc + [("cleaned", f"SELECT * FROM {last}")], "cleaned"


def _describe_rows(src: str, cols: list[str], by: str | None = None) -> str:
    parts = []
    for c in cols:
        key = f"{by}, " if by else ""
        group = f" GROUP BY {by}" if by else ""
        parts.append(f"""
SELECT {key}"column", count, mean, std, min,
       {_qx('l', 0.25)} AS q25, {_qx('l', 0.5)} AS q50, {_qx('l', 0.75)} AS q75, max
FROM (
  SELECT {key}'{c}' AS "column", count({c}) AS count,
         round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std,
         CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {_sorted(c)} AS l
  FROM {src}{group})""")
    return "\nUNION ALL\n".join(parts)


def _per_column(src: str, cols: list[str], expr: str, name: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {expr.format(c=c)} AS {name} FROM {src}" for c in cols)


_TX_COLS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice",
            "CustomerID", "Country", "TotalPrice"]
_TX_TYPES = {"InvoiceNo": "string", "StockCode": "string", "Description": "string",
             "Quantity": "double", "InvoiceDate": "timestamp_ntz", "UnitPrice": "double",
             "CustomerID": "bigint", "Country": "string", "TotalPrice": "double"}
_STRING_COLS = ["InvoiceNo", "StockCode", "Description", "Country"]
_NUMERIC_COLS = ["Quantity", "UnitPrice", "CustomerID", "TotalPrice"]
_LINE_NUM = ["Quantity", "UnitPrice", "TotalPrice"]


#: Queries whose result SQL cannot give: a forest of random trees.
NOT_SQL = ("ch8_churn_predictions", "ch9_13_metrics_model", "ch9_13_metrics_leak_free")


def _least_squares(cols: list[str]) -> list[tuple[str, str]]:
    """CLV on ``cols`` over the training rows: each feature loses its share of the features before it; one that then has next to
    nothing left depends on them and adds nothing. ``pred``: the test rows."""
    train = "FILTER (NOT is_test) OVER ()"
    ctes = [("fit", "SELECT CustomerID, is_test, CLV, " + f"avg(CLV) {train} AS p, "
             + ", ".join(f"CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) {train} AS c{i}" for i, c in enumerate(cols)) + " FROM parts"),
            ("fit0", "SELECT *, " + ", ".join(f"sum(c{i} * c{i}) {train} AS o{i}" for i in range(len(cols))) + " FROM fit")]
    for k in range(len(cols)):
        left = f"(CASE WHEN sum(c{k} * c{k}) {train} > 1e-16 * o{k} THEN sum(c{k} * c{k}) {train} END)"
        less = "".join(f", c{j} - c{k} * coalesce(sum(c{j} * c{k}) {train} / {left}, 0) AS c{j}" for j in range(k + 1, len(cols)))
        ctes.append((f"fit{k + 1}", f"SELECT * REPLACE (p + c{k} * coalesce(sum(c{k} * (CLV - p)) {train} / {left}, 0) AS p{less}) FROM fit{k}"))
    return [*ctes, ("pred", f"SELECT CustomerID, CLV, p AS prediction FROM fit{len(cols)} WHERE is_test")]


def _analysis() -> list[tuple[str, str]]:
    return [*_segmented(TX, churn_days=90),
            ("analysis", "SELECT *, Monetary AS CLV FROM seg"),
            ("parts", "SELECT *, row_number() OVER (ORDER BY md5(CAST(CustomerID AS VARCHAR) || ':42'), CAST(CustomerID AS VARCHAR)) "
                      "<= ceil(0.2 * count(*) OVER ()) AS is_test FROM analysis")]


def _mode_country(src: str) -> list[tuple[str, str]]:
    return [("cc0", f"""
SELECT CustomerID, Country, row_number() OVER (PARTITION BY CustomerID ORDER BY count(*) DESC, Country) AS rn
FROM {src} WHERE Country IS NOT NULL GROUP BY CustomerID, Country"""),
            ("cc1", f"SELECT DISTINCT CustomerID FROM {src}"),
            ("cc", "SELECT a.CustomerID, b.Country FROM cc1 a LEFT JOIN cc0 b "
                   "ON a.CustomerID = b.CustomerID AND b.rn = 1")]


def _products(n: int = 10) -> list[tuple[str, str]]:
    return [("tx", TX), ("perf", f"""
SELECT StockCode, sum(Quantity) AS TotalQuantitySold, {_money_sum('TotalPrice')} AS TotalRevenue
FROM tx WHERE StockCode IS NOT NULL GROUP BY StockCode"""),
            ("topq", f"SELECT * FROM perf ORDER BY TotalQuantitySold DESC, StockCode LIMIT {n}"),
            ("topr", f"SELECT * FROM perf ORDER BY TotalRevenue DESC, StockCode LIMIT {n}"),
            ("dual", "SELECT * FROM perf WHERE StockCode IN "
                     "(SELECT StockCode FROM topq INTERSECT SELECT StockCode FROM topr)")]


# Fixed value: the chosen segment of the drill-down (as in the Spark registry).
CHOSEN = "At Risk"


def _seg_line_counts(key: str, largest: bool = False, named: bool = False) -> str:
    chosen = f"seg WHERE Segment = '{CHOSEN}'" if named else "seg WHERE Segment IS NOT NULL"
    if largest:
        chosen = ("seg WHERE Segment = (SELECT Segment FROM seg WHERE Segment IS NOT NULL "
                  "GROUP BY Segment ORDER BY count(*) DESC, Segment LIMIT 1)")
    return f"""
SELECT s.Segment, t.{key}, count(*) AS count
FROM tx t JOIN (SELECT CustomerID, Segment FROM {chosen}) s ON t.CustomerID = s.CustomerID
WHERE t.{key} IS NOT NULL
GROUP BY s.Segment, t.{key}"""


def _top_products_sql(largest: bool, named: bool = False) -> str:
    return _with(*_segmented(TX), ("cnt", _seg_line_counts("Description", largest, named)), final="""
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY Segment ORDER BY count DESC, Description) AS INTEGER) AS rank
  FROM cnt) WHERE rank <= 10""")


# ------------------------------------------------------------------ queries

def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    seg_all = _with(*_segmented(TX), final=f"SELECT {_RFM_COLS} FROM seg")

    q["s1_transactions"] = TX
    q["s2_rfm_csv"] = seg_all

    q["p1_shape"] = f"SELECT count(*) AS rows, 9 AS columns FROM ({TX})"
    q["p2_column_info"] = _with(("tx", TX), final="\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", '{_TX_TYPES[c]}' AS dtype, count({c}) AS non_null FROM tx"
        for c in _TX_COLS))
    q["p3_describe"] = _with(("tx", TX), final=_describe_rows("tx", _NUMERIC_COLS))
    def _dt(fixture: str) -> str:
        x = "CAST(epoch_us(InvoiceDate) AS DOUBLE)"
        back = "make_timestamp(CAST(trunc({}) AS BIGINT))"
        return _with(("tx", fixture), ("m", f"""
SELECT count(InvoiceDate) AS count,
       CAST(sum(epoch_us(InvoiceDate)) AS DOUBLE) / count(InvoiceDate) AS mean_us, min(InvoiceDate) AS min,
       max(InvoiceDate) AS max, list({x} ORDER BY {x}) FILTER (WHERE InvoiceDate IS NOT NULL) AS l
FROM tx"""), final=f"""
SELECT 'InvoiceDate' AS "column", count, {back.format('mean_us')} AS mean, min,
       {back.format(_qx('l', 0.25))} AS q25, {back.format(_qx('l', 0.5))} AS q50,
       {back.format(_qx('l', 0.75))} AS q75, max
FROM m""")
    q["p3b_describe_datetime"] = _dt(TX)
    q["p3b_describe_datetime_clock"] = _dt(CLOCK)
    q["p4_preview"] = _with(("tx", TX), final=f"SELECT * FROM tx ORDER BY {', '.join(_TX_COLS)} LIMIT 5")
    q["p5_nunique"] = _with(("tx", TX), final=_per_column("tx", _TX_COLS, "count(DISTINCT {c})", "nunique"))
    q["p6_null_counts_dirty"] = _with(("dirty", DIRTY), final="\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count_if({c} IS NULL"
        + (f" OR isnan({c})" if c in ("CustomerID", "TotalPrice") else "") + ") AS missing FROM dirty"
        for c in _TX_COLS))
    q["p7a_distinct_values"] = _with(("tx", TX), final="\nUNION ALL\n".join(
        f"SELECT * FROM (SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM tx "
        f"ORDER BY value NULLS FIRST LIMIT 50)" for c in _STRING_COLS))
    q["p7b_countries"] = _with(("tx", TX), final="SELECT DISTINCT 'Country' AS \"column\", Country AS value FROM tx")
    def _box(src: str, cols: list[str]) -> str:
        return "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", b.q1, b.median, b.q3,
       min(CASE WHEN t.{c} >= b.q1 - 1.5 * (b.q3 - b.q1) THEN t.{c} END) AS whisker_low,
       max(CASE WHEN t.{c} <= b.q3 + 1.5 * (b.q3 - b.q1) THEN t.{c} END) AS whisker_high,
       count_if(t.{c} < b.q1 - 1.5 * (b.q3 - b.q1) OR t.{c} > b.q3 + 1.5 * (b.q3 - b.q1)) AS n_fliers
FROM {src} t CROSS JOIN (SELECT {_qx('l', 0.25)} AS q1, {_qx('l', 0.5)} AS median,
                             {_qx('l', 0.75)} AS q3 FROM (SELECT {_sorted(c)} AS l FROM {src})) b
WHERE t.{c} IS NOT NULL
GROUP BY b.q1, b.median, b.q3""" for c in cols)

    q["p8_boxplot_stats"] = _with(("tx", TX), final=_box("tx", _LINE_NUM))

    def _fliers(src: str, cols: list[str]) -> str:
        return "\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", side, value, count(*) AS count, row_number() OVER (PARTITION BY side ORDER BY CASE side WHEN 'low' THEN value ELSE -value END) AS rank,
       CAST(coalesce(sum(count(*)) OVER (PARTITION BY side ORDER BY CASE side WHEN 'low' THEN value ELSE -value END
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS points_before
FROM (SELECT CAST(t.{c} AS DOUBLE) AS value, CASE WHEN t.{c} < q1 - 1.5 * (q3 - q1) THEN 'low' WHEN t.{c} > q3 + 1.5 * (q3 - q1) THEN 'high' END AS side
      FROM {src} t CROSS JOIN (SELECT {_qx('l', 0.25)} AS q1, {_qx('l', 0.75)} AS q3 FROM (SELECT {_sorted(c)} AS l FROM {src})))
WHERE side IS NOT NULL GROUP BY side, value""" for c in cols)

    q["p8_boxplot_fliers"] = _with(("tx", TX), final=_fliers("tx", [c for c in _NUMERIC_COLS]))
    q["p8_rfm_boxplot_fliers"] = _with(*_segmented(TX), final=_fliers("seg", ["Recency", "Frequency", "Monetary"]))
    numbered = TX.replace("FROM lineitem", "FROM (SELECT *, row_number() OVER () AS line FROM lineitem) lineitem").replace(
        " AS TotalPrice", " AS TotalPrice, line")
    q["p4_head"] = _with(("tx", numbered), final="SELECT * EXCLUDE (line) FROM tx ORDER BY line LIMIT 5")
    for name, cols, upto in (("values", _STRING_COLS, 50), ("all", ["Country", "Description"], 10 ** 12)):
        q[f"p7a_first_seen_{name}"] = _with(("tx", numbered), final="\nUNION ALL\n".join(f"""
SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY min(line)) AS rank, CAST({c} AS VARCHAR) AS value FROM tx GROUP BY {c}) WHERE rank <= {upto}"""
                                                                               for c in cols))
    q["s1_rescued_lines"] = _with(("tx", TX), final="SELECT * FROM tx WHERE CAST(InvoiceNo AS BIGINT) % 97 <> 0 AND CAST(InvoiceNo AS BIGINT) % 89 <> 0")
    q["s1_rejected_lines"] = _with(("tx", TX), final="""
SELECT InvoiceNo, StockCode, CAST(InvoiceNo AS BIGINT) % 97 <> 0 AS too_long FROM tx WHERE CAST(InvoiceNo AS BIGINT) % 97 = 0 OR CAST(InvoiceNo AS BIGINT) % 89 = 0""")
    rfm_cols = [c.strip() for c in _RFM_COLS.split(",")]
    rfm_types = {"CustomerID": "bigint", "Monetary": "double", "Segment": "string"}
    q["p2_rfm_column_info"] = _with(*_segmented(TX), final="\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", '{rfm_types.get(c, 'int')}' AS dtype, count({c}) AS non_null FROM seg" for c in rfm_cols))
    q["p3_rfm_describe"] = _with(*_segmented(TX), final=_describe_rows("seg", rfm_cols[:-1]))
    q["p5_rfm_nunique"] = _with(*_segmented(TX), final=_per_column("seg", rfm_cols, "count(DISTINCT {c})", "nunique"))
    q["p6_rfm_null_counts"] = _with(*_segmented(_coarse(1)), final=_per_column("seg", rfm_cols, "count_if({c} IS NULL)", "missing"))
    q["p7b_segments"] = _with(*_segmented(TX), final="SELECT DISTINCT 'Segment' AS \"column\", Segment AS value FROM seg")
    q["p8_rfm_boxplot_stats"] = _with(*_segmented(TX), final=_box("seg", ["Recency", "Frequency", "Monetary"]))
    q["p10_rfm_duplicate_count"] = _with(*_segmented(TX), final="SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM seg)) AS BIGINT) AS duplicates FROM seg")
    q["p9_key_uniqueness"] = _with(*_segmented(TX), final="""
SELECT count(*) AS rows, count(DISTINCT CustomerID) AS distinct_keys,
       count(*) = count(DISTINCT CustomerID) AS is_unique FROM seg""")
    q["p10_duplicates_by_fingerprint"] = _with(("dirty", DIRTY), final="""
SELECT CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS duplicates""")
    q["c7_dedupe_by_fingerprint"] = _with(("dirty", DIRTY), final="SELECT DISTINCT * FROM dirty")
    q["p10_duplicate_count_dirty"] = _with(("dirty", DIRTY), final="""
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM dirty GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
        "ALL_COLUMNS_PLACEHOLDER", ", ".join(_TX_COLS)))
    ctes12, last12 = _clean("dedupe_first")
    q["p12_describe_cleaned"] = _with(*ctes12, final=_describe_rows(last12, _NUMERIC_COLS))

    base = _dirty_c1_c5()
    q["c1_drop_missing_dirty"] = _with(("dirty", DIRTY), final=f"SELECT * FROM dirty WHERE {_NOT_MISSING}")
    q["c2_drop_missing_customer_dirty"] = _with(("dirty", DIRTY), final=
        "SELECT * FROM dirty WHERE CustomerID IS NOT NULL AND NOT isnan(CustomerID)")
    q["c3_coerce_numeric_dirty"] = _with(("dirty", DIRTY), final=
        f"SELECT * REPLACE ({_coerce('Quantity')} AS Quantity, {_coerce('UnitPrice')} AS UnitPrice) FROM dirty")
    q["c4_positive_only_dirty"] = _with(("dirty", DIRTY), ("c3", f"SELECT * REPLACE ({_coerce('Quantity')} "
        f"AS Quantity, {_coerce('UnitPrice')} AS UnitPrice) FROM dirty"),
        final="SELECT * FROM c3 WHERE Quantity > 0 AND UnitPrice > 0")
    q["c5_to_int_dirty"] = _with(*base, final="SELECT * FROM c5")
    q["c6_total_price_dirty"] = _with(*base, final="SELECT * REPLACE (Quantity * UnitPrice AS TotalPrice) FROM c5")
    q["c7_dedupe_dirty"] = _with(*base, final="SELECT DISTINCT * REPLACE (Quantity * UnitPrice AS TotalPrice) FROM c5")
    q["c8_iqr_quantity"] = _with(("tx", TX), *_iqr_step("tx", "Quantity", "s0"), final="SELECT * FROM s0")
    q["c8_iqr_bounds_total_price"] = _with(("tx", TX), final=f"""
SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
FROM (SELECT {_qx('l', 0.25)} AS q1, {_qx('l', 0.75)} AS q3
      FROM (SELECT {_sorted('TotalPrice')} AS l FROM tx))""")
    casc, last = _cascade("tx", _LINE_NUM, "s")
    q["c9_iqr_cascade"] = _with(("tx", TX), *casc, final=f"SELECT * FROM {last}")
    casc, last = _cascade("seg", ["Recency", "Frequency", "Monetary"], "k")
    q["c10_iqr_cascade_rfm"] = _with(*_segmented(TX), *casc, final=f"SELECT {_RFM_COLS} FROM {last}")
    q["c10_iqr_cascade_rfm_csv"] = q["c10_iqr_cascade_rfm"]
    ctes11, last11 = _clean("outliers_first")
    q["c11_clean_outliers_first"] = _with(*ctes11, final=f"SELECT * FROM {last11}")
    q["c12_clean_dedupe_first"] = _with(*ctes12, final=f"SELECT * FROM {last12}")

    q["e1_customers"] = _with(*_segmented(TX), *_mode_country("tx"), final="""
SELECT s.CustomerID, cc.Country, Recency, Frequency, Monetary, R_score, F_score, M_score, RFM_Score, Segment
FROM seg s LEFT JOIN cc ON s.CustomerID = cc.CustomerID""")
    q["e2_products"] = _with(("tx", TX), ("d", """
SELECT StockCode, Description,
       row_number() OVER (PARTITION BY StockCode ORDER BY count(*) DESC, Description) AS rn
FROM tx WHERE Description IS NOT NULL GROUP BY StockCode, Description"""), final="""
SELECT p.StockCode, d.Description, p.MinUnitPrice, p.MaxUnitPrice
FROM (SELECT StockCode, min(UnitPrice) AS MinUnitPrice, max(UnitPrice) AS MaxUnitPrice
      FROM tx WHERE StockCode IS NOT NULL GROUP BY StockCode) p
LEFT JOIN d ON p.StockCode = d.StockCode AND d.rn = 1""")
    q["e3_transactions"] = _with(("tx", TX), final=
        "SELECT InvoiceNo, StockCode, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, TotalPrice FROM tx")

    q["r1_last_purchase"] = _with(("tx", TX), final=
        "SELECT CustomerID, max(InvoiceDate) AS LastPurchase FROM tx GROUP BY CustomerID")
    q["r2_reference_date"] = _with(("tx", TX), final=
        "SELECT max(InvoiceDate) + INTERVAL 1 DAY AS ReferenceDate FROM tx")
    q["r3_recency_clock"] = _with(("tx", CLOCK), *_rfm_ctes("tx"), final="SELECT CustomerID, Recency FROM rfm")
    q["r6_rfm"] = _with(("tx", TX), *_rfm_ctes("tx"), final="SELECT * FROM rfm")
    q["r7_strict_monetary"] = _with(("tx", TX), *_rfm_ctes("tx"),
        ("e", f"SELECT {_edges_of('lm')} AS em FROM (SELECT {_sorted('Monetary')} AS lm FROM rfm)"),
        final=f"SELECT CustomerID, {_bin('em', 'Monetary', False)} AS M_score FROM rfm CROSS JOIN e "
              f"WHERE (SELECT len(em) FROM e) = 6")
    for name, fx in (("r8_scores", TX), ("r8_scores_const", _coarse(1)), ("r8_scores_coarse3", _coarse(3))):
        q[name] = _with(*_segmented(fx), final="SELECT CustomerID, R_score, F_score, M_score FROM seg")
    q["r9_rfm_score"] = _with(*_segmented(TX), final="SELECT CustomerID, RFM_Score FROM seg")
    q["r10_segments"] = _with(*_segmented(TX), final="SELECT CustomerID, RFM_Score, Segment FROM seg")
    q["r11_segment_counts"] = _counts(TX)
    for n in (2, 3, 6):
        q[f"r11_segment_counts_coarse{n}"] = _counts(_coarse(n))
    q["r11_segment_counts_clock"] = _counts(CLOCK)
    q["r11_segment_counts_events"] = _counts(EVENTS)
    q["r11_segment_counts_cleaned"] = _with(*ctes12, *_rfm_ctes(last12), *_score_ctes("rfm"), final="""
SELECT Segment, count(*) AS count FROM seg WHERE Segment IS NOT NULL GROUP BY Segment""")

    prod = _products()
    q["pr3_product_performance"] = _with(*prod, final="SELECT * FROM perf")
    q["pr4_top_quantity"] = _with(*prod, final="SELECT * FROM topq")
    q["pr4_top_quantity_n20"] = _with(*prod, final=
        "SELECT * FROM perf ORDER BY TotalQuantitySold DESC, StockCode LIMIT 20")
    q["pr5_top_revenue"] = _with(*prod, final="SELECT * FROM topr")
    q["pr6_dual_top"] = _with(*prod, final="SELECT * FROM dual")
    q["pr7_dual_top_by_revenue"] = _with(*prod, final="SELECT * FROM dual ORDER BY TotalRevenue DESC, StockCode")
    q["pr8_dual_top_summary"] = _with(*prod, final="""
SELECT count(*) AS n_common,
       arg_min(StockCode, (-TotalQuantitySold, StockCode)) AS quantity_leader,
       arg_min(StockCode, (-TotalRevenue, StockCode)) AS revenue_leader
FROM dual""")

    q["ch1_churn_threshold"] = _with(("tx", TX), final=
        "SELECT max(InvoiceDate) - INTERVAL 90 DAY AS ChurnThreshold FROM tx")
    q["ch2_churned_customers"] = _with(("tx", TX), ("lp", "SELECT CustomerID, max(InvoiceDate) AS LastPurchase "
        "FROM tx GROUP BY CustomerID"), final=
        "SELECT CustomerID, LastPurchase FROM lp WHERE LastPurchase < (SELECT max(LastPurchase) FROM lp) - INTERVAL 90 DAY")
    q["ch3_churn_flag"] = _with(("tx", TX), *_rfm_ctes("tx", 90), final="SELECT CustomerID, Churn FROM rfm")
    q["ch4_churn_count"] = _with(*_segmented(TX, 90), final=
        "SELECT CAST(coalesce(sum(Churn), 0) AS BIGINT) AS churned FROM seg")
    q["ch4_churn_count_events"] = _with(("tx", EVENTS), *_rfm_ctes("tx", 5), final=
        "SELECT CAST(coalesce(sum(Churn), 0) AS BIGINT) AS churned FROM rfm")
    feats = "Recency, Frequency, Monetary, R_score, F_score, M_score, RFM_Score"
    q["ch5_features"] = _with(*_analysis(), final=f"SELECT CustomerID, {feats}, Churn FROM analysis")
    q["ch6_split"] = _with(*_analysis(), final="SELECT CustomerID, is_test FROM parts")
    q["ch9_13_metrics_rule"] = _with(*_analysis(), ("c", """
SELECT CAST(count_if(Churn = 1 AND p = 1) AS DOUBLE) AS tp, CAST(count_if(Churn = 0 AND p = 1) AS DOUBLE) AS fp,
       CAST(count_if(Churn = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count_if(Churn = 1 AND p = 0) AS DOUBLE) AS fn
FROM (SELECT Churn, CAST(R_score <= 2 AS INTEGER) AS p FROM parts WHERE is_test)"""), final="""
SELECT round(CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END) / 2, 6)
         AS roc_auc
FROM c""")

    q["cl1_clv"] = _with(("tx", TX), *_rfm_ctes("tx"), final="SELECT CustomerID, Monetary AS CLV FROM rfm")
    q["cl2_customer_country"] = _with(("tx", TX), *_mode_country("tx"), final="SELECT * FROM cc")
    q["cl3_with_country"] = _with(*_segmented(TX), *_mode_country("tx"), final=f"""
SELECT s.CustomerID, Recency, Frequency, Monetary, R_score, F_score, M_score, RFM_Score, Segment,
       Monetary AS CLV, cc.Country
FROM seg s LEFT JOIN cc ON s.CustomerID = cc.CustomerID""")
    q["cl4_features"] = _with(*_analysis(), final=f"SELECT CustomerID, {feats}, CLV FROM analysis")
    q["cl6_line_fit"] = _with(*_analysis(), final="""
SELECT round(regr_slope(CLV, CAST(Frequency AS DOUBLE)), 6) AS slope,
       round(regr_intercept(CLV, CAST(Frequency AS DOUBLE)), 6) AS intercept,
       round(regr_r2(CLV, CAST(Frequency AS DOUBLE)), 6) AS r2_train
FROM parts WHERE NOT is_test""")
    q["cl8_10_metrics_line"] = _with(*_analysis(), ("fit", """
SELECT regr_slope(CLV, CAST(Frequency AS DOUBLE)) AS slope, regr_intercept(CLV, CAST(Frequency AS DOUBLE)) AS intercept
FROM parts WHERE NOT is_test"""), ("pred", """
SELECT CLV, intercept + slope * Frequency AS prediction FROM parts CROSS JOIN fit WHERE is_test"""), final="""
SELECT round(avg(abs(CLV - prediction)), 2) AS mae, round(avg((CLV - prediction) * (CLV - prediction)), 2) AS mse,
       round(1 - sum((CLV - prediction) * (CLV - prediction)) / nullif(var_pop(CLV) * count(CLV), 0), 6) AS r2
FROM pred""")

    q["sg1_top_segment"] = _with(*_segmented(TX), final="""
SELECT Segment, count(*) AS count FROM seg WHERE Segment IS NOT NULL
GROUP BY Segment ORDER BY count DESC, Segment LIMIT 1""")
    q["sg2_in_segment"] = _with(*_segmented(TX), final=f"""
SELECT {_RFM_COLS} FROM seg WHERE Segment = (SELECT Segment FROM seg WHERE Segment IS NOT NULL
  GROUP BY Segment ORDER BY count(*) DESC, Segment LIMIT 1)""")
    q["sg3_segment_profile"] = _with(*_segmented(TX), ("chosen", "SELECT * FROM seg WHERE Segment IS NOT NULL"),
                                     final=_describe_rows("chosen", ["Recency", "Frequency", "Monetary"], by="Segment"))
    q["sg4_tx_with_segment"] = _with(*_segmented(TX), final="""
SELECT t.*, s.Segment FROM tx t JOIN seg s ON t.CustomerID = s.CustomerID""")
    q["sg5_segment_top_products"] = _top_products_sql(False)
    q["sg5_top_segment_products"] = _top_products_sql(True)
    q["sg6_segment_countries"] = _with(*_segmented(TX), final=_seg_line_counts("Country"))

    q["sg2_in_segment_named"] = _with(*_segmented(TX), final=f"SELECT {_RFM_COLS} FROM seg WHERE Segment = '{CHOSEN}'")
    q["sg3_segment_profile_named"] = _with(*_segmented(TX), ("chosen", f"SELECT * FROM seg WHERE Segment = '{CHOSEN}'"),
                                           final=_describe_rows("chosen", ["Recency", "Frequency", "Monetary"], by="Segment"))
    q["sg5_named_segment_products"] = _top_products_sql(False, True)
    q["sg6_named_segment_countries"] = _with(*_segmented(TX), final=_seg_line_counts("Country", named=True))
    for n in (5, 20):
        q[f"pr6_dual_top_n{n}"] = _with(*_products(n), final="SELECT * FROM dual")
    q["ch3_churn_flag_joined"] = q["ch3_churn_flag"]
    for name, cols in (("", feats.split(", ")), ("_leak_free", ["Recency", "Frequency", "R_score", "F_score"])):
        fit = [*_analysis(), *_least_squares(cols)]
        q[f"cl7_clv_predictions{name}"] = _with(*fit, final="SELECT CustomerID, CLV, round(prediction, 2) AS prediction FROM pred")
        q[f"cl8_10_metrics_model{name}"] = _with(*fit, final="""
SELECT round(avg(abs(CLV - prediction)), 2) AS mae, round(avg((CLV - prediction) * (CLV - prediction)), 2) AS mse,
       round(1 - sum((CLV - prediction) * (CLV - prediction)) / nullif(var_pop(CLV) * count(CLV), 0), 6) AS r2
FROM pred""")
    for score, expr in (("frequency", "1.0 / Frequency"), ("monetary", "-Monetary")):
        q[f"ch13_auc_{score}"] = _with(*_analysis(), ("s", f"SELECT Churn, CAST({expr} AS DOUBLE) AS score FROM analysis"), ("r", """
SELECT Churn, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s"""), final="""
SELECT round((sum(mid) FILTER (Churn = 1) - count_if(Churn = 1) * (count_if(Churn = 1) + 1) / 2.0)
             / nullif(CAST(count_if(Churn = 1) AS DOUBLE) * count_if(Churn = 0), 0), 9) AS roc_auc FROM r""")
    q["a1_run_analysis"] = _with(*ctes12, *_rfm_ctes(last12, 90), *_score_ctes("rfm"),
        ("perf", f"SELECT StockCode, sum(Quantity) AS TotalQuantitySold, {_money_sum('TotalPrice')} AS TotalRevenue "
                 f"FROM {last12} GROUP BY StockCode"), *_products()[2:],
        final="\nUNION ALL\n".join([
            "SELECT 'raw_shape' AS report, 'rows' AS item, count(*) AS value FROM dirty",
            *[f"SELECT 'raw_missing', '{c}', count_if({c} IS NULL" + (f" OR isnan({c})" if c in ("CustomerID", "TotalPrice") else "") + ") FROM dirty"
              for c in _TX_COLS],
            f"SELECT 'clean_shape', 'rows', count(*) FROM {last12}",
            *[f"SELECT 'clean_describe', '{c}', count({c}) FROM {last12}" for c in _LINE_NUM],
            "SELECT 'clean_duplicates', 'rows', 0",
            "SELECT 'segment_counts', Segment, count(*) FROM seg WHERE Segment IS NOT NULL GROUP BY Segment",
            "SELECT 'churned', 'customers', CAST(coalesce(sum(Churn), 0) AS BIGINT) FROM seg",
            "SELECT 'dual_top_summary', arg_min(StockCode, (-TotalQuantitySold, StockCode)) || '/' || "
            "arg_min(StockCode, (-TotalRevenue, StockCode)), count(*) FROM dual"]))
    q["a1_run_analysis_reports"] = _with(*ctes12, *_rfm_ctes(last12, 90), *_score_ctes("rfm"),
        ("perf", f"SELECT StockCode, sum(Quantity) AS TotalQuantitySold, {_money_sum('TotalPrice')} AS TotalRevenue "
                 f"FROM {last12} GROUP BY StockCode"), *_products()[2:], *_mode_country(last12),
        ("mine", f"""
SELECT t.* FROM {last12} t JOIN seg s ON t.CustomerID = s.CustomerID WHERE s.Segment = (
  SELECT Segment FROM seg WHERE Segment IS NOT NULL GROUP BY Segment ORDER BY count(*) DESC, Segment LIMIT 1)"""),
        final="\nUNION ALL\n".join([
            "SELECT 'segment_profile' AS report, Segment || '/' || c AS item, count(*) AS value FROM seg, (VALUES ('Recency'), ('Frequency'), ('Monetary')) v(c) "
            "WHERE Segment IS NOT NULL GROUP BY Segment, c",
            "SELECT 'drilldown_customers', 'customers', max(n) FROM (SELECT count(*) AS n FROM seg WHERE Segment IS NOT NULL GROUP BY Segment)",
            "SELECT * FROM (SELECT 'drilldown_top_products', Description, count(*) FROM mine GROUP BY Description ORDER BY count(*) DESC, Description LIMIT 10)",
            "SELECT 'drilldown_countries', Country, count(*) FROM mine GROUP BY Country",
            "SELECT 'product_performance', 'products', count(*) FROM perf",
            "SELECT 'top_quantity', StockCode, CAST(TotalQuantitySold AS BIGINT) FROM topq",
            "SELECT 'top_revenue', StockCode, CAST(floor(TotalRevenue) AS BIGINT) FROM topr",
            "SELECT 'dual_top', StockCode, CAST(TotalQuantitySold AS BIGINT) FROM dual",
            "SELECT 'customers', Country, count(*) FROM (SELECT s.CustomerID, cc.Country FROM seg s JOIN cc ON s.CustomerID = cc.CustomerID) GROUP BY Country",
        ]))

    q["v1_segment_distribution"] = q["r11_segment_counts"]
    q["v2_top_quantity_chart"] = q["pr4_top_quantity"]
    q["v2_top_revenue_chart"] = q["pr5_top_revenue"]
    q["v3_segment_country_chart"] = q["sg6_segment_countries"]
    q["v4_boxplots"] = q["p8_boxplot_stats"]
    return q
