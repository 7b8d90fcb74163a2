"""The one-call analysis agrees with the individual operators."""

from tillwise.operators import cleaning as C
from tillwise.operators import rfm as R
from tillwise.plans.analysis import run_analysis
from tillwise.sources.testdata import dirty_lines

from conftest import SF_SMALL


def test_run_analysis_reports(spark):
    raw = dirty_lines(spark, SF_SMALL)
    rep = run_analysis(raw, fit_models=True)
    clean = C.clean(raw)
    assert rep["clean_shape"].first()["rows"] == clean.count()
    want = {r["Segment"]: r["count"] for r in R.segment_counts(R.rfm_segmented(clean)).collect()}
    got = {r["Segment"]: r["count"] for r in rep["segment_counts"].collect()}
    assert got == want
    largest = max(want.items(), key=lambda kv: (kv[1], [-ord(ch) for ch in kv[0]]))[0]
    assert {r["Segment"] for r in rep["drilldown_customers"].collect()} == {largest}
    assert rep["customers"].count() == sum(want.values())
    for k in ["churn_metrics", "clv_metrics", "dual_top_summary", "segment_profile", "top_revenue"]:
        assert rep[k].count() >= 1


def test_reports_read_written_lines(spark):
    """Copies and fences are found once, not once a report."""
    plan = run_analysis(dirty_lines(spark, SF_SMALL))["clean_shape"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Filter" not in plan
