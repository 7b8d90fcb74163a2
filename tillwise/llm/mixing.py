"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Documents fall into cells (source, language, topic). The cells' token weights are raked: dimension by
dimension, the weights are scaled so that the dimension's marginal meets its target shares, in rounds,
until all marginals fit or ``rounds`` are done. A cell's sampling probability is its raked share of the
token budget over the tokens it has; cells that would need more than they have are taken whole and the
others are calibrated again, so the expected tokens meet the budget. A document is kept if a hash of its
id lies under its cell's probability (Poisson sampling: no shuffle, the same documents each time).

Targets of a dimension are shares by value, or a power: shares proportional to tokens ** power (1 keeps
the mix, 0 makes values equal). Values without a share get the mean of the given shares; shares are made
to sum to one over the values that occur.

Scale. One pass aggregates documents to cells (map-side combined, so a hot source costs nothing more);
raking works on the cells, whose number follows the distinct values and not the documents. Each
round's cells are written to the shared folder. The one join with the documents brings in the cells'
probabilities; Spark broadcasts them if they are measured small, and splits a hot cell otherwise.

Defined cases. Null dimension values are a value of their own. Null or empty text: 1 token. Null id:
sampled by the hash of an empty id. Repeated rows: sampled alike. Zero budget or an empty table: nothing
is kept. Extra columns of the documents are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table

#: Shares of the topics; the others' targets are powers of their tokens.
TOPICS = {"short": 0.10, "medium": 0.35, "long": 0.40, "table": 0.05, "marked": 0.05, "licence": 0.05}
TARGETS = {"source": 0.7, "lang": 0.5, "topic": TOPICS}
RATE, ROUNDS, CAPPINGS, SEED = 0.5, 10, 5, "mix1"


def tokens(text: Column) -> Column:
    """An estimate by length: one token for each started four bytes, at least one."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("long")


def topic(text: Column) -> Column:
    size = F.coalesce(F.octet_length(text), F.lit(0))
    has = [F.coalesce(text.contains(s), F.lit(False)) for s in ("licensed under", " | ", "***", "$$$", "###")]
    return F.when(has[0], "licence").when(has[1], "table").when(has[2] | has[3] | has[4], "marked") \
        .when(size < 1000, "short").when(size < 4000, "medium").otherwise("long")


def _value(c: Column) -> Column:
    """Null-safe: a null and any text are different keys."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def target_shares(cells: DataFrame, dim: str, target: float | dict[str, float]) -> DataFrame:
    """(dim, goal): shares that sum to one over the values that occur."""
    each = cells.groupBy(dim).agg(F.sum("w").alias("t"))
    if isinstance(target, dict):
        mean = sum(target.values()) / len(target) if target else 1.0
        size = reduce(lambda c, kv: c.when(F.col(dim) == f"={kv[0]}", F.lit(float(kv[1]))), target.items(), F).otherwise(F.lit(mean)) if target else F.lit(1.0)
    else:
        size = F.pow(F.col("t").cast("double"), F.lit(float(target)))
    each = each.select(dim, size.alias("g"))
    total = each.agg(F.sum("g")).first()[0]
    return each.select(dim, (F.col("g") / F.lit(total)).alias("goal"))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, tolerance: float = 1e-12) -> DataFrame:
    """cells with a column x: raked shares, which sum to one. Cells need columns of the dimensions and w (tokens)."""
    total = cells.agg(F.sum("w")).first()[0]
    if not total:
        return cells.withColumn("x", F.lit(0.0))
    cells = cells.withColumn("x", F.col("w") / F.lit(float(total)))
    for d, t in targets.items():
        cells = cells.join(target_shares(cells, d, t).withColumnRenamed("goal", f"goal_{d}"), d)
    cells = materialize_table(cells, "cells-goals")
    goals = [f"goal_{d}" for d in targets]
    for _ in range(rounds):
        off = F.lit(0.0)
        for d in targets:
            have = F.sum("x").over(Window.partitionBy(d))  # cells of one value: no join brings the factor back
            cells = cells.withColumn("f", F.when(have > 0, F.col(f"goal_{d}") / have).otherwise(F.lit(0.0)))
            cells = cells.withColumns({"x": F.col("x") * F.col("f"), f"off_{d}": F.abs(F.col("f") - 1)}).drop("f")
            off = F.greatest(off, F.col(f"off_{d}"))
        cells = materialize_table(cells.withColumn("off", off).drop(*(f"off_{d}" for d in targets)), "raked")
        worst = cells.agg(F.max("off")).first()[0]
        cells = cells.drop("off")
        if worst < tolerance:
            break
    return cells.drop(*goals)


def probabilities(cells: DataFrame, budget: float) -> DataFrame:
    """cells with p: k * x * budget / w, at most 1, with k such that the expected tokens are the budget if there are as many."""
    k = 1.0
    for _ in range(CAPPINGS):
        want = F.lit(k * budget) * F.col("x")
        full = want >= F.col("w")
        s = cells.agg(F.sum(F.when(full, F.col("w"))).alias("full"), F.sum(F.when(~full, F.col("x"))).alias("free")).first()
        if not s["free"] or budget <= (s["full"] or 0):
            break
        k = (budget - (s["full"] or 0)) / (s["free"] * budget)
    return cells.withColumn("p", F.when(F.col("w") > 0, F.least(F.lit(1.0), F.lit(k * budget) * F.col("x") / F.col("w"))).otherwise(F.lit(0.0)))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: 52 bits of md5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None,
            targets: dict[str, float | dict[str, float]] | None = None, rate: float = RATE, weight: Column | None = None,
            rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The documents with a struct ``__mix``: tokens, topic and other dimensions' keys, share (raked share of the cell),
    probability, kept."""
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col))}
    targets = targets or TARGETS
    keyed = docs.withColumn("__mix", F.struct(
        (tokens(F.col(text_col)) if weight is None else weight).alias("w"), *(_value(c).alias(d) for d, c in dims.items())))
    cells = materialize_table(keyed.groupBy(*(F.col(f"__mix.{d}").alias(d) for d in dims)).agg(F.sum("__mix.w").alias("w")), "cells")
    total = cells.agg(F.sum("w")).first()[0] or 0
    cells = probabilities(rake(cells, targets, rounds), rate * total)
    found = cells.select(F.struct(*dims).alias("__cell"), F.struct("x", "p").alias("__cell_value"))
    out = keyed.join(found, F.struct(*(F.col(f"__mix.{d}").alias(d) for d in dims)) == F.col("__cell"), "left").drop("__cell")
    p = F.coalesce(F.col("__cell_value.p"), F.lit(0.0))
    return out.withColumn("__mix", F.struct(
        F.col("__mix.w").alias("tokens"), *(F.col(f"__mix.{d}").alias(d) for d in dims), F.col("__cell_value.x").alias("share"),
        p.alias("probability"), (draw(F.col(id_col), seed) < p).alias("kept"))).drop("__cell_value")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its id, tokens, topic, share of its cell, probability (both to 9 places) and kept."""
    return sampled(docs, id_col, text_col, **how).select(
        id_col, "__mix.tokens", F.col("__mix.topic").alias("topic"), F.round("__mix.share", 9).alias("cell_share"),
        F.round("__mix.probability", 9).alias("probability"), "__mix.kept")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The sampled documents, with their own columns."""
    return sampled(docs, id_col, text_col, **how).where("__mix.kept").drop("__mix")


def oracle_sql(rounds: int = ROUNDS, rate: float = RATE, targets=None, seed: str = SEED) -> str:
    """The rows of :func:`mixing_plan` in DuckDB's SQL, the rounds written out."""
    targets = targets or TARGETS
    parts = ["""d AS (SELECT doc_id, greatest(ceil(coalesce(strlen(text), 0) / 4), 1)::BIGINT AS tokens,
  CASE WHEN contains(text, 'licensed under') THEN '=licence' WHEN contains(text, ' | ') THEN '=table'
       WHEN contains(text, '***') OR contains(text, '$$$') OR contains(text, '###') THEN '=marked'
       WHEN coalesce(strlen(text), 0) < 1000 THEN '=short' WHEN coalesce(strlen(text), 0) < 4000 THEN '=medium' ELSE '=long' END AS topic,
  coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS lang FROM documents)""",
             "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS w FROM d GROUP BY ALL)"]
    for dim, t in targets.items():
        if isinstance(t, dict):
            size = "CASE " + " ".join(f"WHEN {dim} = '={k}' THEN {v!r}::DOUBLE" for k, v in t.items()) + f" ELSE {sum(t.values()) / len(t)!r}::DOUBLE END"
        else:
            size = f"pow(sum(w), {t!r}::DOUBLE)"
        parts.append(f"g_{dim} AS MATERIALIZED (SELECT {dim}, g / sum(g) OVER () AS goal FROM (SELECT {dim}, {size} AS g FROM c GROUP BY {dim}))")
    last = "x0"
    parts.append("x0 AS MATERIALIZED (SELECT *, w / sum(w) OVER () AS x FROM c)")
    for i in range(rounds):
        for dim in targets:
            name = f"x{i}_{dim}"
            parts.append(f"{name} AS MATERIALIZED (SELECT a.* REPLACE (a.x * g.goal / sum(a.x) OVER (PARTITION BY a.{dim}) AS x) FROM {last} a JOIN g_{dim} g USING ({dim}))")
            last = name
    parts.append(f"k0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS k, {rate!r} * sum(w) AS budget FROM c)")
    for i in range(CAPPINGS):
        parts.append(f"""k{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(free, 0) = 0 OR budget <= coalesce(f, 0) THEN k ELSE (budget - coalesce(f, 0)) / (free * budget) END AS k, budget
  FROM (SELECT any_value(k) AS k, any_value(budget) AS budget, sum(w) FILTER (k * budget * x >= w) AS f, sum(x) FILTER (k * budget * x < w) AS free FROM {last}, k{i}))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, tokens, topic, round(x, 9) AS cell_share, round(p, 9) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p AS kept
FROM (SELECT d.*, x, least(1.0, k * budget * x / w) AS p FROM d JOIN {last} USING (source, lang, topic), k{CAPPINGS})"""
