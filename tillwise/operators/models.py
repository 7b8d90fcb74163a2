"""Churn classification (Spark ML) and lifetime-value regression (CH5-CH13, CL4-CL10).

The split goes by a hash of the customer id and the seed, so it does not depend on
partitioning or task order (a retried task draws the same rows) and any SQL
engine with md5 can reproduce it. Metrics are one aggregate each; the area under the
curve of a score also takes running totals along the scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.least_squares import LinearFit, least_squares
from tillwise.functions.prefix import running_totals
from tillwise.functions.scalars import attach_scalars
from tillwise.functions.selection import rank_cut
from tillwise.schema import CHURN, CLV, CUSTOMER, MODEL_FEATURES

IS_TEST = "is_test"


def split_threshold(test_fraction: float) -> str:
    """The 32-hex-digit md5 cut below which a row goes to the test part."""
    if not 0.0 < test_fraction < 1.0:
        raise ValueError("test_fraction must lie in (0, 1)")
    return format(int(Fraction(str(test_fraction)) * (16 ** 32)), "032x")


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def hash_split(df: DataFrame, key: str = CUSTOMER, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """A split of about ``test_fraction`` that looks at one row at a time (for streams, or rows that come later): test rows
    have md5(key ':' seed) below a fixed cut."""
    return df.withColumn(IS_TEST, _digest(key, seed) < F.lit(split_threshold(test_fraction)))


def exact_split(df: DataFrame, key: str = CUSTOMER, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """CH6 / CL5: mark exactly ceil(``test_fraction`` * n) rows as test: those of the least (md5(key ':' seed), key). The cut is
    found by counting hash prefixes (``functions.selection``) and travels as a one-row frame. Rows of one key stay on
    one side, so the number is exact for unique keys; a NULL key counts as the empty text. Runs the selection when called."""
    split_threshold(test_fraction)  # a fraction between 0 and 1
    h, k = _digest(key, seed), F.coalesce(F.col(key).cast("string"), F.lit(""))
    cut = rank_cut(df, h, k, test_fraction)
    marked = attach_scalars(df, cut.select(F.col("cut_digest").alias("_cut_h"), F.col("cut_key").alias("_cut_k")))
    below = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & (k <= F.col("_cut_k")))
    return marked.withColumn(IS_TEST, F.coalesce(below, F.lit(False))).drop("_cut_h", "_cut_k")


def features(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, out: str = "features") -> DataFrame:
    """CH5 / CL4: the feature vector column over ``cols``. No row is dropped: a row with a missing feature has a
    NULL vector."""
    known = _complete(cols)
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="_vector", handleInvalid="error").transform(filled)
    return vectors.withColumn(out, F.when(known, F.col("_vector"))).drop("_vector", *[f"_f_{c}" for c in cols])


def _complete(cols: Sequence[str]):
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def _training(train: DataFrame, cols: Sequence[str], label: str, max_rows: int) -> DataFrame:
    """Rows with all features and a label, at most ``max_rows`` of them (by hash of the row, so the same rows
    each time). Rows left out for a missing value are an error unless the caller filters them: none is skipped unseen."""
    bad = F.count_if(~(_complete(cols) & F.col(label).isNotNull()))
    seen = train.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} of {seen['n']} training rows miss a feature or the label; "
                         "filter them first (complete_rows) if that is meant")
    if seen["n"] > max_rows:
        return train.orderBy(F.xxhash64(*cols, label)).limit(max_rows)
    return train


def complete_rows(df: DataFrame, cols: Sequence[str] = MODEL_FEATURES, label: str | None = None) -> DataFrame:
    """The rows with all features (and a label), said out loud."""
    return df.where(_complete(cols) & F.col(label).isNotNull() if label else _complete(cols))


#: Labelled rows a forest is fitted on (the trees live on the driver, and grow with these rows).
MAX_TRAINING_ROWS = 2_000_000


def train_churn(train: DataFrame, cols: Sequence[str] = MODEL_FEATURES, label: str = CHURN,
                num_trees: int = 100, max_depth: int = 30, seed: int = 42, min_rows_per_leaf: int = 1,
                max_rows: int = MAX_TRAINING_ROWS) -> PipelineModel:
    """CH7: random forest (100 trees, unbounded-like depth 30, sqrt features, gini). Its size on the driver is
    bounded by ``max_rows`` training rows and ``min_rows_per_leaf``."""
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="error")
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                impurity="gini", seed=seed, minInstancesPerNode=min_rows_per_leaf)
    return Pipeline(stages=[assembler, rf]).fit(_training(train, cols, label, max_rows))


def train_clv(train: DataFrame, cols: Sequence[str] = MODEL_FEATURES, label: str = CLV) -> LinearFit:
    """CL6: ordinary least squares (no regularisation, intercept fitted) on all rows. Features may depend on each other, as
    RFM_Score does on the three scores: the coefficients are then those of least norm."""
    return least_squares(train, cols, label)


def predict(model: PipelineModel | LinearFit, df: DataFrame, keep: Sequence[str] = (CUSTOMER,),
            label: str | None = None, score: str | None = None) -> DataFrame:
    """CH8 / CL7: id, label and prediction for each row; NULL prediction where a feature is missing. ``score`` names a column
    for the probability of class 1 (of a classifier)."""
    inputs = list(model.cols) if isinstance(model, LinearFit) else model.stages[0].getInputCols()
    known = _complete(inputs)
    if isinstance(model, LinearFit):
        return df.select(*keep, *([label] if label else []), F.when(known, model.value()).alias("prediction"))
    held = {f"_held_{c}": F.col(c) for c in {*keep, *([label] if label else [])}}
    filled = df.withColumns(held).withColumn("_known", known).withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in inputs})
    out = model.transform(filled)
    return out.select(*[F.col(f"_held_{c}").alias(c) for c in keep], *([F.col(f"_held_{label}").alias(label)] if label else []),
                      F.when(F.col("_known"), F.col("prediction")).alias("prediction"),
                      *([F.when(F.col("_known"), vector_to_array("probability")[1]).alias(score)] if score else []))


def roc_auc(pred: DataFrame, label: str = CHURN, score: str = "score") -> DataFrame:
    """CH13 on a score: one row (``roc_auc``), the share of (positive, negative) pairs that the score orders rightly, ties at half;
    NULL if the labels hold one class only. Equal scores fold first, and each score meets the number of negatives
    below it by running totals, so no task sorts all scores. Rows without a label or score are an error."""
    y, s = F.col(label).cast("int"), F.col(score).cast("double")
    bad = F.raise_error(F.lit("a row without a label of 0 or 1, or without a score"))
    rows = pred.select(F.when(y.isin(0, 1) & s.isNotNull() & ~F.isnan(s), s).otherwise(bad).alias("s"),
                       (y == 1).cast("long").alias("pos"), (y == 0).cast("long").alias("neg"))
    at = running_totals(rows, "s", ["pos", "neg"])
    big = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  counts of pairs pass the range of a long
    twice = F.sum((big("pos") * (2 * big("neg_before") + big("neg"))).cast("decimal(38,0)"))
    pairs = F.max("pos_all").cast("double") * F.max("neg_all").cast("double")
    return at.agg(F.try_divide(twice.cast("double"), 2 * pairs).alias("roc_auc"))


def binary_metrics(pred: DataFrame, label: str = CHURN, prediction: str = "prediction") -> DataFrame:
    """CH9-CH13 of hard predictions in one aggregate: accuracy, precision, recall, F1 (class 1; 0
    when undefined) and ROC AUC of hard 0/1 predictions = (TPR + TNR) / 2
    (NULL when the labels hold one class only)."""
    y = F.col(label).cast("int")
    p = F.col(prediction).cast("int")
    c = pred.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    tpr = F.try_divide(tp, tp + fn)
    tnr = F.try_divide(tn, tn + fp)
    return c.select(
        F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        ((tpr + tnr) / 2).alias("roc_auc"))


def regression_metrics(pred: DataFrame, label: str = CLV, prediction: str = "prediction") -> DataFrame:
    """CL8-CL10: MAE, MSE and R2 = 1 - SSE / SST in one aggregate (R2 NULL when SST = 0)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    c = pred.agg(F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
                 F.sum((y - p) * (y - p)).alias("_sse"),
                 (F.var_pop(y) * F.count(y)).alias("_sst"))
    return c.select("mae", "mse", (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"))


def fit_line(train: DataFrame, x: str, y: str = CLV) -> DataFrame:
    """One-feature least squares as one aggregate: slope, intercept, R2 on the training rows."""
    return train.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                     F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                     F.regr_r2(F.col(y).cast("double"), F.col(x).cast("double")).alias("r2_train"))
