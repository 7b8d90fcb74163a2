"""Named analyses over the test tables: one callable ``(spark, sf_dir) -> DataFrame``
per operator of the inventory. Each reads the whole tables (through the retail
views in ``tillwise.sources.testdata``) and returns a DataFrame. Operators that need
an intermediate more than once (quantiles, RFM, cleaning, dual lists) run jobs and
write it to the shared folder while the DataFrame is built.

Keys start with the inventory id (s, p, c, e, r, pr, ch, cl, sg, v).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.fingerprints import distinct_rows, repeated_rows
from tillwise.functions.materialize import materialize, materialize_table
from tillwise.functions.numeric import round_stat
from tillwise.operators import cleaning as C
from tillwise.operators import customers as CU
from tillwise.operators import models as M
from tillwise.operators import products as PR
from tillwise.operators import profiling as P
from tillwise.operators import rfm as R
from tillwise.operators import segments as SG
from tillwise.plans.analysis import run_analysis
from tillwise.schema import (
    CHURN, CLV, COUNTRY, CUSTOMER, DESCRIPTION, F_SCORE, FREQUENCY, INVOICE, M_SCORE, MODEL_FEATURES, MONETARY, QUANTITY,
    R_SCORE, RECENCY, RFM_SCORE, SEGMENT, STOCK, TOTAL_PRICE, TOTAL_QUANTITY, TOTAL_REVENUE, UNIT_PRICE,
)
from tillwise.session import derived_path
from tillwise.sources import files as S
from tillwise.sources import testdata as TD
from tillwise.sources.positions import POSITION

Query = Callable[[SparkSession, str], DataFrame]

# Whole-table fixtures with few distinct invoices per customer, so that quantile edges repeat: the
# number of invoice ids that all order keys fold to.
COARSE = {"const": 1, "coarse2": 2, "coarse3": 3, "coarse6": 6}
EVENT_CHURN_DAYS = 5
CHOSEN_SEGMENT = "At Risk"


# ---------------------------------------------------------------- inputs

def _tx(spark, d):
    return TD.retail_lines(spark, d)


def _coarse(name):
    def f(spark, d):
        return TD.coarse_lines(spark, d, COARSE[name])
    return f


def _dirty(spark, d):
    return TD.dirty_lines(spark, d)


def _dirty_c1_c5(spark, d):
    df = C.drop_missing(_dirty(spark, d))
    df = C.positive_only(C.coerce_numeric(df))
    return C.to_int(C.drop_missing(df, [CUSTOMER]))


def _scored(spark, d):
    return R.rfm_segmented(_tx(spark, d))


def _analysis(spark, d):
    """Customer table with churn flag and CLV over the base lines."""
    return CU.with_clv(R.rfm_segmented(_tx(spark, d), churn_days=90))


# ---------------------------------------------------------------- queries

def s1_transactions(spark, d):
    raw = TD.raw_lines(spark, d)
    path = derived_path(spark, "s1-lines-csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    back = S.read_transactions(spark, path, "csv")
    return C.to_int(C.coerce_numeric(back))


def s1_rescued_lines(spark, d):
    lines, _ = S.read_transactions_rescued(spark, TD.broken_csv(spark, d))
    return C.to_int(C.coerce_numeric(lines))


def s1_rejected_lines(spark, d):
    _, rejected = S.read_transactions_rescued(spark, TD.broken_csv(spark, d))
    fields = "^([^,]*),([^,]*),"
    return rejected.select(F.regexp_extract("line", fields, 1).alias(INVOICE), F.regexp_extract("line", fields, 2).alias(STOCK), F.col("line").endswith(",more").alias("too_long"))


def s2_rfm_csv(spark, d):
    path = derived_path(spark, "s2-rfm-csv")
    S.write_rfm_csv(_scored(spark, d), path)
    return S.read_rfm(spark, path)


def p1_shape(spark, d):
    return P.shape(_tx(spark, d))


def p2_column_info(spark, d):
    return P.column_info(_tx(spark, d))


def p3_describe(spark, d):
    return _describe_rounded(P.describe(_tx(spark, d)))


def p3b_describe_datetime(spark, d):
    return P.describe_datetime(_tx(spark, d))


def p3b_describe_datetime_clock(spark, d):
    return P.describe_datetime(TD.clock_lines(spark, d))


def p4_preview(spark, d):
    return P.preview(_tx(spark, d), 5)


def p4_head(spark, d):
    return P.head(TD.retail_lines(spark, d, POSITION), 5)


def p7a_first_seen_values(spark, d):
    return P.first_seen_values(TD.retail_lines(spark, d, POSITION), k=50)


def p7a_first_seen_all(spark, d):
    return P.first_seen_values(TD.retail_lines(spark, d, POSITION), [COUNTRY, DESCRIPTION], k=None)


def p8_boxplot_fliers(spark, d):
    return P.boxplot_fliers(_tx(spark, d))


def p8_rfm_boxplot_fliers(spark, d):
    return P.boxplot_fliers(_scored(spark, d), C.RFM_OUTLIER_COLUMNS)


def p5_nunique(spark, d):
    return P.nunique(_tx(spark, d))


def p6_null_counts_dirty(spark, d):
    return P.null_counts(_dirty(spark, d))


def p7a_distinct_values(spark, d):
    return P.distinct_values(_tx(spark, d), k=50)


def p7b_countries(spark, d):
    return P.distinct_values(_tx(spark, d), [COUNTRY], k=None)


def p8_boxplot_stats(spark, d):
    return P.boxplot_stats(_tx(spark, d), [QUANTITY, UNIT_PRICE, TOTAL_PRICE])


def p9_key_uniqueness(spark, d):
    return P.key_uniqueness(_scored(spark, d), CUSTOMER)


def p10_duplicate_count_dirty(spark, d):
    return P.duplicate_count(_dirty(spark, d))


def p10_duplicates_by_fingerprint(spark, d):
    return repeated_rows(_dirty(spark, d))


def c7_dedupe_by_fingerprint(spark, d):
    return distinct_rows(materialize_table(_dirty(spark, d), "dirty"))


def p12_describe_cleaned(spark, d):
    return _describe_rounded(P.describe(C.clean(_dirty(spark, d)), [QUANTITY, UNIT_PRICE, CUSTOMER, TOTAL_PRICE]))


def c1_drop_missing_dirty(spark, d):
    return C.drop_missing(_dirty(spark, d))


def c2_drop_missing_customer_dirty(spark, d):
    return C.drop_missing(_dirty(spark, d), [CUSTOMER])


def c3_coerce_numeric_dirty(spark, d):
    return C.coerce_numeric(_dirty(spark, d))


def c4_positive_only_dirty(spark, d):
    return C.positive_only(C.coerce_numeric(_dirty(spark, d)))


def c5_to_int_dirty(spark, d):
    return _dirty_c1_c5(spark, d)


def c6_total_price_dirty(spark, d):
    return C.with_total_price(_dirty_c1_c5(spark, d))


def c7_dedupe_dirty(spark, d):
    return C.dedupe(C.with_total_price(_dirty_c1_c5(spark, d)))


def c8_iqr_quantity(spark, d):
    return C.remove_outliers_iqr(_tx(spark, d), QUANTITY)


def c8_iqr_bounds_total_price(spark, d):
    return C.iqr_bounds(_tx(spark, d), TOTAL_PRICE)


def c9_iqr_cascade(spark, d):
    return C.iqr_cascade(_tx(spark, d))


def c10_iqr_cascade_rfm(spark, d):
    return C.iqr_cascade(_scored(spark, d), C.RFM_OUTLIER_COLUMNS)


def c10_iqr_cascade_rfm_csv(spark, d):
    """C10 as the reference runs it: on the customer table read from CSV."""
    path = derived_path(spark, "c10-rfm-csv")
    S.write_rfm_csv(_scored(spark, d), path)
    return C.iqr_cascade(S.read_rfm(spark, path), C.RFM_OUTLIER_COLUMNS)


def c11_clean_outliers_first(spark, d):
    return C.clean(_dirty(spark, d), order="outliers_first")


def c12_clean_dedupe_first(spark, d):
    return C.clean(_dirty(spark, d), order="dedupe_first")


def e1_customers(spark, d):
    return CU.customers(_tx(spark, d))


def e2_products(spark, d):
    return PR.products(_tx(spark, d))


def e3_transactions(spark, d):
    return CU.transactions(_tx(spark, d))


def r1_last_purchase(spark, d):
    return R.last_purchase(_tx(spark, d))


def r2_reference_date(spark, d):
    return R.reference_date(_tx(spark, d))


def r6_rfm(spark, d):
    return R.rfm(_tx(spark, d))


def r3_recency_clock(spark, d):
    return R.rfm(TD.clock_lines(spark, d)).select(CUSTOMER, RECENCY)


def r7_strict_monetary(spark, d):
    return R.quantile_score(R.rfm(_tx(spark, d)), MONETARY, M_SCORE, duplicates="raise").select(
        CUSTOMER, M_SCORE)


def _scores_of(src):
    def f(spark, d):
        return R.score_rfm(R.rfm(src(spark, d))).select(CUSTOMER, R_SCORE, F_SCORE, M_SCORE)
    return f


def r9_rfm_score(spark, d):
    return _scored(spark, d).select(CUSTOMER, RFM_SCORE)


def r10_segments(spark, d):
    return _scored(spark, d).select(CUSTOMER, RFM_SCORE, SEGMENT)


def _counts_of(src):
    def f(spark, d):
        return R.segment_counts(R.rfm_segmented(src(spark, d)))
    return f


def r11_segment_counts_events(spark, d):
    return R.segment_counts(R.rfm_segmented(TD.event_lines(spark, d)))


def r11_segment_counts_cleaned(spark, d):
    return R.segment_counts(R.rfm_segmented(C.clean(_dirty(spark, d))))


def pr3_product_performance(spark, d):
    return PR.product_performance(_tx(spark, d))


def pr4_top_quantity(spark, d):
    return PR.top_products(PR.product_performance(_tx(spark, d)), "TotalQuantitySold", 10)


def pr4_top_quantity_n20(spark, d):
    return PR.top_products(PR.product_performance(_tx(spark, d)), "TotalQuantitySold", 20)


def pr5_top_revenue(spark, d):
    return PR.top_products(PR.product_performance(_tx(spark, d)), "TotalRevenue", 10)


def pr6_dual_top(spark, d):
    return PR.dual_top_products(PR.product_performance(_tx(spark, d)), 10)


def pr7_dual_top_by_revenue(spark, d):
    return PR.dual_top_products(PR.product_performance(_tx(spark, d)), 10, order_by="TotalRevenue")


def pr6_dual_top_n5(spark, d):
    return PR.dual_top_products(PR.product_performance(_tx(spark, d)), 5)


def pr6_dual_top_n20(spark, d):
    return PR.dual_top_products(PR.product_performance(_tx(spark, d)), 20)


def pr8_dual_top_summary(spark, d):
    return PR.dual_top_summary(PR.product_performance(_tx(spark, d)), 10)


def ch1_churn_threshold(spark, d):
    return CU.churn_threshold(_tx(spark, d))


def ch2_churned_customers(spark, d):
    return CU.churned_customers(_tx(spark, d))


def ch3_churn_flag(spark, d):
    # the flag comes out of the RFM aggregate: the lines are read once
    return R.rfm(_tx(spark, d), churn_days=90).select(CUSTOMER, CHURN)


def ch3_churn_flag_joined(spark, d):
    """The flag as a join, for a customer table that exists already."""
    tx = _tx(spark, d)
    return CU.churn_flag(R.rfm(tx), tx).select(CUSTOMER, CHURN)


def ch4_churn_count(spark, d):
    return CU.churn_count(_analysis(spark, d))


def ch4_churn_count_events(spark, d):
    return CU.churn_count(R.rfm(TD.event_lines(spark, d), churn_days=EVENT_CHURN_DAYS))


def _vector_columns(df, label):
    """The assembled vector, taken apart again: what the models are given."""
    parts = M.features(df).withColumn("_v", vector_to_array("features"))
    kinds = dict(df.dtypes)
    return parts.select(CUSTOMER, *[F.col("_v")[i].cast(kinds[c]).alias(c) for i, c in enumerate(MODEL_FEATURES)], label)


def ch5_features(spark, d):
    return _vector_columns(_analysis(spark, d), CHURN)


def ch6_split(spark, d):
    return M.exact_split(_analysis(spark, d)).select(CUSTOMER, M.IS_TEST)


def _churn_model_predictions(spark, d, **options):
    parts = M.exact_split(_analysis(spark, d))
    train, test = parts.where(~F.col(M.IS_TEST)), parts.where(F.col(M.IS_TEST))
    return M.predict(M.train_churn(train, **options), test, label=CHURN, score="score")


def ch8_churn_predictions(spark, d):
    """Every test customer with its label, the forest's prediction and its probability of churn (the trees are not SQL)."""
    return _churn_model_predictions(spark, d)


def _model_metrics(pred):
    return _round_all(M.binary_metrics(pred).crossJoin(F.broadcast(M.roc_auc(pred).withColumnRenamed("roc_auc", "roc_auc_score"))))


def ch9_13_metrics_model(spark, d):
    """The forest's metrics on the leaking feature set (Recency decides Churn), of its predictions and of its probabilities."""
    return _model_metrics(materialize(_churn_model_predictions(spark, d)))


def ch9_13_metrics_leak_free(spark, d):
    """The same without Recency and the scores made of it."""
    return _model_metrics(materialize(_churn_model_predictions(spark, d, cols=[FREQUENCY, MONETARY, F_SCORE, M_SCORE], max_depth=10, min_rows_per_leaf=20)))


def ch13_auc_frequency(spark, d):
    """Area under the curve of a score with many ties: few invoices point to churn."""
    s = _analysis(spark, d).select(CHURN, (F.lit(1.0) / F.col(FREQUENCY)).alias("score"))
    return M.roc_auc(s).select(F.round("roc_auc", 9).alias("roc_auc"))


def ch13_auc_monetary(spark, d):
    s = _analysis(spark, d).select(CHURN, (-F.col(MONETARY)).alias("score"))
    return M.roc_auc(s).select(F.round("roc_auc", 9).alias("roc_auc"))


def ch9_13_metrics_rule(spark, d):
    test = M.exact_split(_analysis(spark, d)).where(F.col(M.IS_TEST))
    pred = test.select(CHURN, (F.col(R_SCORE) <= 2).cast("int").alias("prediction"))
    return _round_all(M.binary_metrics(pred))


def cl1_clv(spark, d):
    return CU.with_clv(R.rfm(_tx(spark, d))).select(CUSTOMER, CLV)


def cl2_customer_country(spark, d):
    return CU.customer_country(_tx(spark, d))


def cl3_with_country(spark, d):
    tx = _tx(spark, d)
    return CU.with_country(CU.with_clv(R.rfm_segmented(tx)), tx)


def cl4_features(spark, d):
    return _vector_columns(_analysis(spark, d), CLV)


def _line_fit_parts(spark, d):
    parts = M.exact_split(_analysis(spark, d))
    return parts.where(~F.col(M.IS_TEST)), parts.where(F.col(M.IS_TEST))


def cl6_line_fit(spark, d):
    train, _ = _line_fit_parts(spark, d)
    return _round_all(M.fit_line(train, FREQUENCY))


def cl8_10_metrics_line(spark, d):
    train, test = _line_fit_parts(spark, d)
    fit = M.fit_line(train, FREQUENCY)
    pred = test.crossJoin(F.broadcast(fit)).select(
        CLV, (F.col("intercept") + F.col("slope") * F.col(FREQUENCY)).alias("prediction"))
    m = M.regression_metrics(pred)
    # money-scale errors are shown to the cent, as the reference displays them
    return m.select(F.round("mae", 2).alias("mae"), F.round("mse", 2).alias("mse"),
                    round_stat(F.col("r2")).alias("r2"))


LEAK_FREE_CLV = [RECENCY, FREQUENCY, R_SCORE, F_SCORE]


def _clv_model_predictions(spark, d, cols=MODEL_FEATURES):
    train, test = _line_fit_parts(spark, d)
    return M.predict(M.train_clv(train, cols), test, label=CLV)


def _clv_predictions(cols):
    def f(spark, d):
        return _clv_model_predictions(spark, d, cols).withColumn("prediction", F.round("prediction", 2))
    return f


def _clv_metrics(cols):
    def f(spark, d):
        m = M.regression_metrics(_clv_model_predictions(spark, d, cols))
        return m.select(F.round("mae", 2).alias("mae"), F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"))
    return f


def sg1_top_segment(spark, d):
    return R.top_segment(_scored(spark, d))


def sg2_in_segment(spark, d):
    return SG.in_segment(_scored(spark, d))


def sg2_in_segment_named(spark, d):
    return SG.in_segment(_scored(spark, d), CHOSEN_SEGMENT)


def sg3_segment_profile(spark, d):
    return _describe_rounded(SG.segment_profile(_scored(spark, d)))


def sg3_segment_profile_named(spark, d):
    return _describe_rounded(SG.segment_profile(_scored(spark, d), CHOSEN_SEGMENT))


def sg4_tx_with_segment(spark, d):
    tx = _tx(spark, d)
    return SG.tx_with_segment(tx, R.rfm_segmented(tx))


def sg5_segment_top_products(spark, d):
    tx = _tx(spark, d)
    return SG.segment_top_products(tx, R.rfm_segmented(tx), 10)


def sg5_top_segment_products(spark, d):
    tx = _tx(spark, d)
    return SG.segment_top_products(tx, R.rfm_segmented(tx), 10, largest=True)


def sg5_named_segment_products(spark, d):
    tx = _tx(spark, d)
    return SG.segment_top_products(tx, R.rfm_segmented(tx), 10, seg=CHOSEN_SEGMENT)


def sg6_segment_countries(spark, d):
    tx = _tx(spark, d)
    return SG.segment_countries(tx, R.rfm_segmented(tx))


def sg6_named_segment_countries(spark, d):
    tx = _tx(spark, d)
    return SG.segment_countries(tx, R.rfm_segmented(tx), seg=CHOSEN_SEGMENT)


# the second table's profiles: the customer (RFM) table

def p2_rfm_column_info(spark, d):
    return P.column_info(_scored(spark, d))


def p3_rfm_describe(spark, d):
    return _describe_rounded(P.describe(_scored(spark, d)))


def p5_rfm_nunique(spark, d):
    return P.nunique(_scored(spark, d))


def p6_rfm_null_counts(spark, d):
    return P.null_counts(R.rfm_segmented(TD.coarse_lines(spark, d, 1)))


def p7b_segments(spark, d):
    return P.distinct_values(_scored(spark, d), [SEGMENT], k=None)


def p8_rfm_boxplot_stats(spark, d):
    return P.boxplot_stats(_scored(spark, d), C.RFM_OUTLIER_COLUMNS)


def p10_rfm_duplicate_count(spark, d):
    return P.duplicate_count(_scored(spark, d))


def a1_run_analysis(spark, d):
    """The whole analysis from dirty raw lines in one call; the small reports, as (report, item, value)."""
    r = run_analysis(_dirty(spark, d))

    def rows(name, item, value):
        return r[name].select(F.lit(name).alias("report"), item.cast("string").alias("item"), F.col(value).cast("bigint").alias("value"))

    parts = [rows("raw_shape", F.lit("rows"), "rows"), rows("raw_missing", F.col("column"), "missing"), rows("clean_shape", F.lit("rows"), "rows"),
             rows("clean_describe", F.col("column"), "count"), rows("clean_duplicates", F.lit("rows"), "duplicates"),
             rows("segment_counts", F.col(SEGMENT), "count"), rows("churned", F.lit("customers"), "churned"),
             rows("dual_top_summary", F.concat_ws("/", "quantity_leader", "revenue_leader"), "n_common")]
    return reduce(DataFrame.unionByName, parts)


def a1_run_analysis_reports(spark, d):
    """The profile, drill-down, product and customer reports of the same call, as (report, item, value)."""
    r = run_analysis(_dirty(spark, d))

    def rows(name, item, value):
        return r[name].select(F.lit(name).alias("report"), item.cast("string").alias("item"), F.floor(value).cast("bigint").alias("value"))

    counted = {n: r[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("report"), F.lit(i).alias("item"), "n")
               for n, i in (("drilldown_customers", "customers"), ("product_performance", "products"))}
    per_country = r["customers"].groupBy(COUNTRY).agg(F.count(F.lit(1)).alias("n")).select(F.lit("customers").alias("report"), COUNTRY, "n")
    parts = [rows("segment_profile", F.concat_ws("/", SEGMENT, "column"), F.col("count")), counted["drilldown_customers"],
             rows("drilldown_top_products", F.col(DESCRIPTION), F.col("count")), rows("drilldown_countries", F.col(COUNTRY), F.col("count")),
             counted["product_performance"], rows("top_quantity", F.col(STOCK), F.col(TOTAL_QUANTITY)), rows("top_revenue", F.col(STOCK), F.col(TOTAL_REVENUE)),
             rows("dual_top", F.col(STOCK), F.col(TOTAL_QUANTITY)), per_country]
    return reduce(DataFrame.union, parts)


def _describe_rounded(df: DataFrame) -> DataFrame:
    """Means and deviations to 6 decimals, for display and comparison."""
    return df.withColumns({"mean": round_stat(F.col("mean")), "std": round_stat(F.col("std"))})


def _round_all(df: DataFrame) -> DataFrame:
    return df.select(*[round_stat(F.col(c)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "s1_transactions": s1_transactions,
        "s1_rescued_lines": s1_rescued_lines,
        "s1_rejected_lines": s1_rejected_lines,
        "s2_rfm_csv": s2_rfm_csv,
        "p1_shape": p1_shape,
        "p2_column_info": p2_column_info,
        "p3_describe": p3_describe,
        "p3b_describe_datetime": p3b_describe_datetime,
        "p3b_describe_datetime_clock": p3b_describe_datetime_clock,
        "p4_preview": p4_preview,
        "p4_head": p4_head,
        "p5_nunique": p5_nunique,
        "p6_null_counts_dirty": p6_null_counts_dirty,
        "p7a_distinct_values": p7a_distinct_values,
        "p7a_first_seen_values": p7a_first_seen_values,
        "p7a_first_seen_all": p7a_first_seen_all,
        "p7b_countries": p7b_countries,
        "p8_boxplot_stats": p8_boxplot_stats,
        "p8_boxplot_fliers": p8_boxplot_fliers,
        "p8_rfm_boxplot_fliers": p8_rfm_boxplot_fliers,
        "p9_key_uniqueness": p9_key_uniqueness,
        "p10_duplicate_count_dirty": p10_duplicate_count_dirty,
        "p10_duplicates_by_fingerprint": p10_duplicates_by_fingerprint,
        "p12_describe_cleaned": p12_describe_cleaned,
        "c1_drop_missing_dirty": c1_drop_missing_dirty,
        "c2_drop_missing_customer_dirty": c2_drop_missing_customer_dirty,
        "c3_coerce_numeric_dirty": c3_coerce_numeric_dirty,
        "c4_positive_only_dirty": c4_positive_only_dirty,
        "c5_to_int_dirty": c5_to_int_dirty,
        "c6_total_price_dirty": c6_total_price_dirty,
        "c7_dedupe_dirty": c7_dedupe_dirty,
        "c7_dedupe_by_fingerprint": c7_dedupe_by_fingerprint,
        "c8_iqr_quantity": c8_iqr_quantity,
        "c8_iqr_bounds_total_price": c8_iqr_bounds_total_price,
        "c9_iqr_cascade": c9_iqr_cascade,
        "c10_iqr_cascade_rfm": c10_iqr_cascade_rfm,
        "c10_iqr_cascade_rfm_csv": c10_iqr_cascade_rfm_csv,
        "c11_clean_outliers_first": c11_clean_outliers_first,
        "c12_clean_dedupe_first": c12_clean_dedupe_first,
        "e1_customers": e1_customers,
        "e2_products": e2_products,
        "e3_transactions": e3_transactions,
        "r1_last_purchase": r1_last_purchase,
        "r2_reference_date": r2_reference_date,
        "r3_recency_clock": r3_recency_clock,
        "r6_rfm": r6_rfm,
        "r7_strict_monetary": r7_strict_monetary,
        "r8_scores": _scores_of(_tx),
        "r8_scores_const": _scores_of(_coarse("const")),
        "r8_scores_coarse3": _scores_of(_coarse("coarse3")),
        "r9_rfm_score": r9_rfm_score,
        "r10_segments": r10_segments,
        "r11_segment_counts": _counts_of(_tx),
        "r11_segment_counts_coarse2": _counts_of(_coarse("coarse2")),
        "r11_segment_counts_coarse3": _counts_of(_coarse("coarse3")),
        "r11_segment_counts_coarse6": _counts_of(_coarse("coarse6")),
        "r11_segment_counts_clock": _counts_of(TD.clock_lines),
        "r11_segment_counts_events": r11_segment_counts_events,
        "r11_segment_counts_cleaned": r11_segment_counts_cleaned,
        "pr3_product_performance": pr3_product_performance,
        "pr4_top_quantity": pr4_top_quantity,
        "pr4_top_quantity_n20": pr4_top_quantity_n20,
        "pr5_top_revenue": pr5_top_revenue,
        "pr6_dual_top": pr6_dual_top,
        "pr7_dual_top_by_revenue": pr7_dual_top_by_revenue,
        "pr6_dual_top_n5": pr6_dual_top_n5,
        "pr6_dual_top_n20": pr6_dual_top_n20,
        "pr8_dual_top_summary": pr8_dual_top_summary,
        "ch1_churn_threshold": ch1_churn_threshold,
        "ch2_churned_customers": ch2_churned_customers,
        "ch3_churn_flag": ch3_churn_flag,
        "ch3_churn_flag_joined": ch3_churn_flag_joined,
        "ch4_churn_count": ch4_churn_count,
        "ch4_churn_count_events": ch4_churn_count_events,
        "ch5_features": ch5_features,
        "ch6_split": ch6_split,
        "ch8_churn_predictions": ch8_churn_predictions,
        "ch9_13_metrics_model": ch9_13_metrics_model,
        "ch9_13_metrics_leak_free": ch9_13_metrics_leak_free,
        "ch9_13_metrics_rule": ch9_13_metrics_rule,
        "ch13_auc_frequency": ch13_auc_frequency,
        "ch13_auc_monetary": ch13_auc_monetary,
        "cl1_clv": cl1_clv,
        "cl2_customer_country": cl2_customer_country,
        "cl3_with_country": cl3_with_country,
        "cl4_features": cl4_features,
        "cl6_line_fit": cl6_line_fit,
        "cl7_clv_predictions": _clv_predictions(MODEL_FEATURES),
        "cl7_clv_predictions_leak_free": _clv_predictions(LEAK_FREE_CLV),
        "cl8_10_metrics_line": cl8_10_metrics_line,
        "cl8_10_metrics_model": _clv_metrics(MODEL_FEATURES),
        "cl8_10_metrics_model_leak_free": _clv_metrics(LEAK_FREE_CLV),
        "sg1_top_segment": sg1_top_segment,
        "sg2_in_segment": sg2_in_segment,
        "sg3_segment_profile": sg3_segment_profile,
        "sg4_tx_with_segment": sg4_tx_with_segment,
        "sg5_segment_top_products": sg5_segment_top_products,
        "sg5_top_segment_products": sg5_top_segment_products,
        "sg6_segment_countries": sg6_segment_countries,
        "sg2_in_segment_named": sg2_in_segment_named,
        "sg3_segment_profile_named": sg3_segment_profile_named,
        "sg5_named_segment_products": sg5_named_segment_products,
        "sg6_named_segment_countries": sg6_named_segment_countries,
        "p2_rfm_column_info": p2_rfm_column_info,
        "p3_rfm_describe": p3_rfm_describe,
        "p5_rfm_nunique": p5_rfm_nunique,
        "p6_rfm_null_counts": p6_rfm_null_counts,
        "p7b_segments": p7b_segments,
        "p8_rfm_boxplot_stats": p8_rfm_boxplot_stats,
        "p10_rfm_duplicate_count": p10_rfm_duplicate_count,
        "a1_run_analysis": a1_run_analysis,
        "a1_run_analysis_reports": a1_run_analysis_reports,
    }
    # chart datasets (V1-V4) are the tables behind each chart
    q["v1_segment_distribution"] = q["r11_segment_counts"]
    q["v2_top_quantity_chart"] = q["pr4_top_quantity"]
    q["v2_top_revenue_chart"] = q["pr5_top_revenue"]
    q["v3_segment_country_chart"] = q["sg6_segment_countries"]
    q["v4_boxplots"] = q["p8_boxplot_stats"]
    return q
