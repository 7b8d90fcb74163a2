"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

*Features.* Statistics of the whole text (:mod:`tillwise.llm.stats`), scaled by the training rows' mean and
deviation. D cosines of random projections approximate a Gaussian kernel over them.

*Fit.* Each partition of the training rows sends one row, its part of the normal equations (D * D
numbers); the sum is solved with a ridge. *Calibration.* The raw scores of the training rows are counted
in ``BINS`` bins by Spark; pool-adjacent-violators makes the shares of good rows monotone, and scores are
interpolated between the blocks' centres, so the order of raw scores is kept inside a block's reach.

Scale. One pass over the texts writes the statistics (numbers, about 3 % of the text) to the shared folder; fitting and
scoring read those. Training uses the labelled documents outside the held-out fold, bounded by
``max_labels`` (those with the least hash of the id beyond it). At most ``PARTS`` partial sums reach the
driver. Scoring needs no shuffle.

Defined cases. Null or empty text: all statistics 0, scored like any other. Null id: scored, never held
out, never a training row. Repeated labels of an id count with their mean. No labels at all: every score
is 0.5. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm import stats
from tillwise.llm.shipping import shipped

MAX_LABELS = 1_000_000
DIMENSIONS, PARTS, BINS, RIDGE, SEED = 200, 16, 2000, 1e-3, 20240611
LOW, HIGH = -0.5, 1.5  # raw scores outside fall into the end bins


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray = None
    values: np.ndarray = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of width sqrt(number of statistics), the scaled statistics and a constant."""
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], DIMENSIONS)) / np.sqrt(x.shape[1])
    return np.hstack([np.cos(z @ w + rng.uniform(0, 2 * np.pi, DIMENSIONS)) * np.sqrt(2 / DIMENSIONS), z / 8, np.ones((len(z), 1))])


def _normal_equations(batches: Iterator[pd.DataFrame], mean: np.ndarray, scale: np.ndarray) -> Iterator[pd.DataFrame]:
    a = b = None
    for p in batches:
        z = _fourier(np.vstack(p["x"].to_numpy()), mean, scale) if len(p) else np.zeros((0, 1))
        if len(z):
            y = p["y"].to_numpy(float)
            a, b = (z.T @ z, z.T @ y) if a is None else (a + z.T @ z, b + z.T @ y)
    if a is not None:
        yield pd.DataFrame({"a": [a.ravel()], "b": [b]})


def _raw_rows(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for p in batches:
        raw = model.raw(np.vstack(p["x"].to_numpy())) if len(p) else np.zeros(0)
        yield pd.DataFrame({"y": p["y"].astype(float), "raw": raw})


def _score_rows(batches: Iterator[pd.DataFrame], model: Model | None) -> Iterator[pd.DataFrame]:
    for p in batches:
        score = np.full(len(p), 0.5) if model is None or not len(p) else model.score(np.vstack(p["x"].to_numpy()))
        yield pd.DataFrame({"did": p["did"], "held_out": p["held_out"], "score": np.clip(score, 0, 1)})


def isotonic(weight: np.ndarray, good: np.ndarray) -> list[tuple[float, float, int, int]]:
    """Pool adjacent violators: (weight, good, first bin, last bin) of blocks with rising shares."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(weight):
        blocks.append([weight[i], good[i], i, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, g, _, last = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += g
            blocks[-1][3] = last
    return [(w, g, int(i), int(j)) for w, g, i, j in blocks]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame) -> Model | None:
    """rows: (y, x array<double>) of the training set."""
    n = len(stats.FEATURES)
    sums = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums["n"]:
        return None
    mean = np.array([sums[f"m{i}"] for i in range(n)])
    scale = np.maximum(np.array([sums[f"s{i}"] for i in range(n)]), 1e-9)
    parts = rows.repartition(PARTS).mapInPandas(partial(_normal_equations, mean=mean, scale=scale), "a array<double>, b array<double>").collect()
    a, b = sum(np.array(p["a"]) for p in parts), sum(np.array(p["b"]) for p in parts)
    a = a.reshape(len(b), len(b))
    model = Model(mean, scale, np.linalg.solve(a + RIDGE * sums["n"] * np.eye(len(b)) / len(b), b))
    bin_ = F.least(F.greatest(F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counted = rows.mapInPandas(partial(_raw_rows, model=model), "y double, raw double").groupBy(bin_.alias("bin")) \
        .agg(F.count("*").alias("n"), F.sum("y").alias("good")).collect()
    weight, good = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        weight[r["bin"]], good[r["bin"]] = r["n"], r["good"]
    blocks = isotonic(weight, good)
    centre = lambda i: LOW + (i + 0.5) * (HIGH - LOW) / BINS
    model.knots = np.array([(centre(i) + centre(j)) / 2 for _, _, i, j in blocks])
    model.values = np.array([g / w for w, g, _, _ in blocks])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   threshold: float = 0.3, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: its id, ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    numbers = shipped(docs).select(F.col(id_col).cast("long").alias("did"), stats.counts(F.col(text_col)).alias("c"))
    table = materialize_table(numbers.select("did", held_out(F.col("did")).alias("held_out"), F.array(*stats.features("c")).alias("x")), "statistics")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("did")) \
        .agg(F.avg(label_col).alias("y")).where(~held_out(F.col("did")))
    total = known.count()
    if total > max_labels:  # by hash, so the same ids each time
        known = known.orderBy(F.xxhash64("did"), "did").limit(max_labels)
    model = fit(materialize_table(table.where("NOT held_out").join(known, "did").select("y", "x"), "training"))
    out = table.mapInPandas(partial(_score_rows, model=model), "did long, held_out boolean, score double")
    return out.select(F.col("did").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
