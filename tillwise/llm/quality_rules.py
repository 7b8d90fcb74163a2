"""Quality rules: a decision list learned by sequential covering, run as ordered Spark conditions.

Rules are conjunctions of thresholds on document statistics, in the manner of IREP and RIPPER: a rule
is *grown* on two thirds of the labelled rows, adding the threshold with the best FOIL gain until it
covers no good document (or no gain is left), then *pruned* on the other third by dropping trailing
conditions while (bad - good) / (bad + good) does not fall. Rows it covers leave the training set;
covering ends when a pruned rule's precision falls under ``min_precision`` or it covers too little.
The list is short, readable (:func:`describe`) and becomes one ``CASE WHEN`` chain over statistics.

Scale. The statistics are one pass over the texts, with no shuffle. Learning uses a bounded sample:
the ``max_labels`` labelled documents with the least hash of the id, or all if there are fewer. Their ids
and labels are broadcast up to ``MAX_BROADCAST`` of them; only their statistics (numbers) reach the driver.

Defined cases. Null or empty text: all counts 0, so the base rule fails it. Documents without a label
only get a verdict. Repeated labels of an id: it is bad if their mean is under one half. No labels,
or of one class only: an empty list, so the base rule decides alone. Empty table: empty result.
Extra columns of the documents are kept as they are; their names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm import stats
from tillwise.llm.shipping import shipped

MAX_LABELS, MAX_BROADCAST = 20_000, 200_000
_S = "__stats"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: np.ndarray) -> np.ndarray:
        v = x[:, stats.FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def expression(self, column: Column) -> Column:
        return column > F.lit(self.threshold) if self.above else column <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.mask(x)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the largest FOIL gain: p * (log2 precision after - log2 precision before)."""
    total_p, total = bad.sum(), len(bad)
    best: tuple[float, Condition | None] = (1e-9, None)
    before = np.log2(total_p / total)
    for j, name in enumerate(stats.FEATURES):
        order = np.argsort(x[:, j], kind="stable")
        v, b = x[order, j], bad[order]
        edge = np.flatnonzero(v[1:] > v[:-1])
        if not len(edge):
            continue
        p = np.cumsum(b)[edge]
        n = edge + 1
        for above, pp, nn in ((False, p, n), (True, total_p - p, total - n)):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1) / nn) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float((v[edge[i]] + v[edge[i] + 1]) / 2)))
    return best


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    m = _covered(rule, x)
    p, n = int(bad[m].sum()), int((~bad[m]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9,
                min_cover: int = 3) -> list[Rule]:
    """Ordered rules for the bad rows. Rows are features in the order of FEATURES; ties take the first feature and threshold."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    grow = np.arange(len(bad)) % 3 != 2
    while len(rules) < max_rules and bad[left & grow].any():
        gx, gb = x[left & grow], bad[left & grow]
        rule: Rule = ()
        inside = np.ones(len(gb), bool)
        while len(rule) < max_conditions and not gb[inside].all():
            _, c = _best_condition(gx[inside], gb[inside])
            if c is None:
                break
            rule += (c,)
            inside = _covered(rule, gx)
        if not rule:
            break
        px, pb = x[left & ~grow], bad[left & ~grow]
        scores = [_worth(rule[:k], px, pb) for k in range(1, len(rule) + 1)]
        rule = rule[:1 + int(np.argmax(scores))]
        hit = _covered(rule, x) & left
        if hit.sum() < min_cover or bad[hit].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labels: int) -> DataFrame:
    """(id, y, features) of the bounded sample; y: mean label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("did")) \
        .agg(F.avg(label_col).alias("y")).orderBy(F.xxhash64("did"), "did").limit(max_labels)
    if max_labels <= MAX_BROADCAST:  # (id, label) pairs, bounded by the limit: the texts need no shuffle to meet them
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("did"), F.col(text_col).alias("text")).join(known, "did") \
        .select("did", "y", stats.counts("text").alias(_S))
    return rows.select("did", "y", *stats.features(_S))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              max_labels: int = MAX_LABELS, **how) -> list[Rule]:
    """Learns the list from the bounded sample of labelled documents (label 1: good)."""
    rows = training_rows(shipped(docs), labels, id_col, text_col, label_col, max_labels).toPandas()
    rows = rows.sort_values(["did", *stats.FEATURES])
    bad = rows["y"].to_numpy(float) < 0.5
    if not len(rows) or bad.all() or not bad.any():
        return []
    order = np.random.default_rng(0).permutation(len(rows))
    return learn_rules(rows[list(stats.FEATURES)].to_numpy(float)[order], bad[order], **how)


def describe(rules: list[Rule]) -> str:
    return "\n".join("drop if " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in r) for r in rules) + "\nelse keep"


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents with a struct column ``__quality``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    rule (number of the first rule that fits, from 1) and kept."""
    by_name = dict(zip(stats.FEATURES, stats.features(_S), strict=True))
    chain = F
    for i, r in enumerate(rules):
        fits = F.lit(True)
        for c in r:
            fits = fits & c.expression(by_name[c.feature])
        chain = chain.when(fits, F.lit(i + 1))
    rule = chain.otherwise(None).cast("int") if rules else F.lit(None).cast("int")
    failed = (F.col(f"{_S}.n_words") < 10) | (100 * F.col(f"{_S}.n_repeat_words") > 20 * F.col(f"{_S}.n_words"))
    out = shipped(docs).withColumn(_S, stats.counts(F.col(text_col))).withColumn("__rule", rule)
    return out.withColumn("__quality", F.struct(
        *(F.col(f"{_S}.{c}").alias(c) for c in stats.COUNTS[:5]), failed.alias("base_failed"), F.col("__rule").alias("rule"),
        (~failed & F.col("__rule").isNull()).alias("kept"))).drop(_S, "__rule")


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per document: its id and the fields of ``__quality``."""
    rules = fit_rules(docs, labels, id_col, text_col, max_labels=max_labels)
    return judged(docs.select(id_col, text_col), rules, text_col).select(id_col, "__quality.*")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              max_labels: int = MAX_LABELS) -> DataFrame:
    """The documents that pass, with their own columns."""
    rules = fit_rules(docs, labels, id_col, text_col, max_labels=max_labels)
    return judged(docs, rules, text_col).where("__quality.kept").drop("__quality")
