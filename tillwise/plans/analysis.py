"""The whole customer-behaviour analysis as one call, the way the reference runs it
top to bottom, but with every shared input computed once.

``run_analysis`` cleans the raw lines (C12 by default) with one copy of them in the
shared folder, builds the customer table (RFM, scores, segment, churn, CLV,
home country) once, and derives every report from those two tables. Building it
runs jobs; the reports themselves are DataFrames, the model fits run when requested.
Wrap the call and the use of its reports in ``session.scratch_scope`` to have the
tables in the shared folder deleted afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.fingerprints import repeated_rows
from tillwise.functions.materialize import materialize, materialize_table
from tillwise.operators import cleaning as C
from tillwise.operators import customers as CU
from tillwise.operators import models as M
from tillwise.operators import products as PR
from tillwise.operators import profiling as P
from tillwise.operators import rfm as R
from tillwise.operators import segments as SG
from tillwise.schema import CHURN, CLV, CUSTOMER, QUANTITY, TOTAL_PRICE, UNIT_PRICE


def run_analysis(raw: DataFrame, order: str = "dedupe_first", churn_days: int = 90, q: int = 5,
                 top_n: int = 10, segment: str | None = None, fit_models: bool = False,
                 seed: int = 42) -> dict[str, DataFrame]:
    """Every report of the analysis from raw transaction lines.

    ``segment`` picks the drill-down segment (default: the largest).
    With ``fit_models`` the churn forest and the CLV regression are trained on
    an exact 80/20 split and their metrics added.
    """
    out: dict[str, DataFrame] = {}
    out["raw_shape"] = P.shape(raw)
    out["raw_missing"] = P.null_counts(raw)
    # the search for copies and the fences run once, not once a report
    lines = materialize_table(C.clean(raw, order=order), "clean-lines")
    out["clean_shape"] = P.shape(lines)
    out["clean_describe"] = P.describe(lines, [QUANTITY, UNIT_PRICE, TOTAL_PRICE])
    out["clean_duplicates"] = repeated_rows(lines)

    table = materialize(CU.customer_table(lines, churn_days=churn_days, q=q))
    out["customers"] = table
    out["segment_counts"] = R.segment_counts(table)
    out["segment_profile"] = SG.segment_profile(table)
    largest = segment is None
    out["drilldown_customers"] = SG.in_segment(table, segment, largest)
    # what the reports on products and countries need of the lines, in one pass
    folded = materialize_table(PR.fold_lines(lines), "folded-lines")
    out["drilldown_top_products"] = SG.segment_top_products(folded, table, top_n, segment, largest)
    out["drilldown_countries"] = SG.segment_countries(folded, table, segment, largest)
    out["churned"] = CU.churn_count(table)

    perf = materialize(PR.product_performance(folded))
    out["product_performance"] = perf
    out["top_quantity"] = PR.top_products(perf, "TotalQuantitySold", top_n)
    out["top_revenue"] = PR.top_products(perf, "TotalRevenue", top_n)
    out["dual_top"] = PR.dual_top_products(perf, top_n)
    out["dual_top_summary"] = PR.dual_top_summary(perf, top_n)

    if fit_models:
        parts = M.exact_split(table, CUSTOMER, 0.2, seed)
        train, test = parts.where(~F.col(M.IS_TEST)), parts.where(F.col(M.IS_TEST))
        churn_pred = M.predict(M.train_churn(train, seed=seed), test, label=CHURN)
        out["churn_metrics"] = M.binary_metrics(churn_pred)
        clv_pred = M.predict(M.train_clv(train), test, label=CLV)
        out["clv_metrics"] = M.regression_metrics(clv_pred)
    return out
