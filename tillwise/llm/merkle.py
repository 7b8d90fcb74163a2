"""Merkle dataset manifest: a tree of digests over the rows of each group, with nested-interval labels.

*Tree.* A row's leaf is the SHA-256 of its fields. Leaves of a group (a source) ascend by id; three
consecutive nodes of a level become one node of the next, the last run may be shorter, until one node is
left. The group roots, ordered by group, form a tree of their own in the same way.

*Labels.* Each node carries the interval ``[lo, hi)`` of leaf ranks that it covers. Three levels form a
bucket: 27 items of its lowest level and all nodes above them, at most 40 small rows. A leaf meets its
ancestors by a join on (group, bucket) and by containment of its interval in theirs; the parent's interval
minus the node's own holds the siblings, those below it on the left and those above on the right. The top
node of a bucket is an item of the next bucket up, so a join per three levels reaches the root, and what
a bucket says about its ancestors is worked out once for its 27 items.

*Scale.* Texts are read once, by the digest. Ranks come from a range sort over (group, id): rows get their
place in their partition, and a table of one row for each (group, partition) turns it into the rank in the
group; a group with a third of all rows is spread like any other. No key of a later shuffle has more than
27 rows. Every table that is read twice is written to the shared folder. The driver learns one number, the
size of the largest group.

Defined cases. A null field is ``-`` in the leaf, so null and the empty text differ. Null groups are one
group, ordered first; null ids are ordered first in their group. Rows with the same id are ordered by leaf,
equal rows stand side by side. A group of one row has its leaf as its root. Texts of any length are digested
whole. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table

ARITY, BAND = 3, 3
BUCKET = ARITY ** BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def field_code(c: Column) -> Column:
    """A field as it enters the leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The leaf of a row (lowercase hex)."""
    return F.sha2(F.concat(*[field_code(c) for c in fields.values()]), 256)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on keys that may be null; the keys are kept once."""
    a, b = left.alias("l"), right.alias("r")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return a.join(b, cond).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (from 0, by ``order``, nulls first) and ``leaves`` (their number) in each group ``grp``."""
    keys = [F.asc_nulls_first(c) for c in ("grp", *order)]
    # equal rows are told apart by the place they were read at, else one partition would get them all
    told = rows.withColumn("_read", F.monotonically_increasing_id())
    placed = told.repartitionByRange(*keys, "_read").sortWithinPartitions(*keys).drop("_read").withColumn("_at", F.monotonically_increasing_id())
    placed = materialize_table(placed, "merkle-ranks").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")  # a row for each partition that holds some of the group
    runs = runs.select("grp", "_part", "_first", F.sum("_n").over(group).alias("leaves"),
                       F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return _same(placed, runs, ["grp", "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")) \
        .drop("_at", "_part", "_first", "_before")


def _runs_joined(digests: str) -> Column:
    """One level up: the digests of runs of three, the last run may be shorter."""
    count = F.ceil(F.size(digests) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.array_join(F.slice(F.col(digests), i * ARITY + 1, ARITY), ""), 256))


def _buckets(items: DataFrame, base: int) -> DataFrame:
    """The nodes of each bucket of the three levels from ``base`` on: grp, bucket, leaves, top (the digest of its highest
    node) and nodes (level, lo, hi, digest; by level, then lo)."""
    width = ARITY ** base
    count = F.ceil(F.col("leaves") / width)  # items that the group has on the lowest level
    level = F.when(count <= 1, 0).when(count <= ARITY, 1).when(count <= ARITY ** 2, 2).otherwise(BAND)
    by = items.groupBy("grp", F.floor(F.col("rank") / BUCKET).alias("bucket")).agg(
        F.max("leaves").alias("leaves"), F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("at"))
    by = by.select("grp", "bucket", "leaves", level.alias("levels"), F.col("at.digest").alias("d0"))
    none = F.array().cast("array<string>")
    for j in range(1, BAND + 1):
        by = by.withColumn(f"d{j}", F.when(F.col("levels") >= j, _runs_joined(f"d{j - 1}")).otherwise(none))

    def labelled(j: int) -> Column:
        span = width * ARITY ** j
        lo = lambda i: (F.col("bucket") * (BUCKET // ARITY ** j) + i) * span
        return F.transform(F.col(f"d{j}"), lambda d, i: F.struct(
            F.lit(j).alias("level"), lo(i).alias("lo"), F.least(lo(i) + span, F.col("leaves")).alias("hi"), d.alias("digest")))

    top = F.element_at(F.col("d0"), 1)
    for j in range(1, BAND + 1):
        top = F.when(F.col("levels") >= j, F.element_at(F.col(f"d{j}"), 1)).otherwise(top)
    return by.select("grp", "bucket", "leaves", top.alias("top"), F.concat(*[labelled(j) for j in range(BAND + 1)]).alias("nodes"))


def _siblings() -> Column:
    """For each level below the item's highest ancestor in ``nodes``: the digests before and after it in the parent's interval."""
    nodes, anc = F.col("nodes"), F.col("ancestors")

    def digests(keep) -> Column:
        return F.array_join(F.transform(F.filter(nodes, keep), lambda x: x["digest"]), "")

    def step(own: Column, i: Column) -> Column:
        parent = F.get(anc, i + 1)
        inside = lambda x: (x["level"] == own["level"]) & (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"])
        return F.struct(digests(lambda x: inside(x) & (x["hi"] <= own["lo"])).alias("before"),
                        digests(lambda x: inside(x) & (x["lo"] >= own["hi"])).alias("after"))

    return F.transform(F.slice(anc, 1, F.size(anc) - 1), step)


def with_proofs(items: DataFrame, above: callable) -> DataFrame:
    """``items`` (grp, rank, leaves, digest, more) with what proves them: ``steps`` from the leaf to the root, the group's
    ``subroot``, and the columns that ``above`` gives. ``above`` takes (grp, subroot) and adds ``steps`` and more."""
    biggest = items.agg(F.max("leaves")).first()[0] or 1
    tiers, tier, base = [], items, 0
    while base == 0 or ARITY ** base < biggest:
        nodes = materialize_table(_buckets(tier.select("grp", "rank", "leaves", "digest"), base), "merkle-nodes")
        tiers.append((tier, nodes, base))
        tier = nodes.select("grp", F.col("bucket").alias("rank"), "leaves", F.col("top").alias("digest"))
        base += BAND
    known = above(tier.select("grp", F.col("digest").alias("subroot"))).withColumn("rank", F.lit(0).cast("long"))
    for tier, nodes, base in reversed(tiers):
        width = ARITY ** base
        bucket = _same(nodes.select("grp", F.col("bucket").alias("rank"), "nodes"), known.withColumnRenamed("steps", "upper"), ["grp", "rank"]) \
            .withColumnRenamed("rank", "bucket")
        lo = F.col("rank") * width
        found = _same(tier.withColumn("bucket", F.floor(F.col("rank") / BUCKET)), bucket, ["grp", "bucket"])
        found = found.withColumn("ancestors", F.filter("nodes", lambda x: (x["lo"] <= lo) & (x["hi"] >= F.least(lo + width, F.col("leaves")))))
        found = found.withColumn("steps", F.concat(_siblings(), F.col("upper")))
        if base:
            found = found.drop("leaves", "digest")  # the tier's own
        known = found.drop("bucket", "nodes", "ancestors", "upper")
        if base:
            known = materialize_table(known, "merkle-proofs")
    return known


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, group: str = "source", order: str = "doc_id", fields: Sequence[str] = FIELDS,
             check: dict[str, Column] | None = None, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The manifest: ``keep``, grp, rank, leaf, checked (the leaf of the row as ``check`` has its fields; default: the same),
    steps (the proof), subroot and root."""
    cols = {f: F.col(f) for f in fields}
    leaves = rows.select(*[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)], F.col(group).cast("string").alias("grp"), F.col(order).alias("ord"),
                         leaf_digest(cols).alias("digest"), leaf_digest(cols | (check or {})).alias("checked"))
    leaves = ranked(materialize_table(leaves, "merkle-leaves"), ["ord", "digest"])

    def up(subroots: DataFrame) -> DataFrame:
        """The tree over the groups, which are many or few: the same operator, with one group."""
        tops = materialize_table(subroots, "merkle-subroots")
        items = ranked(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("digest")), ["of"])
        proved = with_proofs(items, lambda top: top.withColumn("steps", F.array().cast(_STEPS)))
        return proved.select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), F.col("subroot").alias("root"), "steps")

    out = with_proofs(leaves, up)
    return out.select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "grp", "rank", F.col("digest").alias("leaf"), "checked", "steps", "subroot", "root")


def merkle_report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` and the check of each proof against rows of which some were tampered with: line breaks
    are deleted from the texts of the documents whose id has an even crc32."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = manifest(docs, check={"text": tampered})
    folded = fold(F.col("checked"), F.col("steps"))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB SQL of an unsigned crc32 of the decimal text of {}.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

_CODE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_CODE.format(c) for c in (*FIELDS[:-1], text)) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE tampered AS (
  SELECT *, CASE WHEN {CRC32.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf('changed')} AS checked FROM tampered)),
tree AS (
  SELECT source, 0 AS lvl, pos AS i, leaf AS h FROM leaves
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM tree)
  WHERE c > 1 GROUP BY source, lvl, i // 3),
heights AS (SELECT source, max(lvl) AS height FROM tree GROUP BY source),
subroots AS (
  SELECT t.source, t.h AS subroot, row_number() OVER (ORDER BY t.source NULLS FIRST) - 1 AS pos
  FROM tree t JOIN heights g ON t.source IS NOT DISTINCT FROM g.source AND t.lvl = g.height),
upper AS (
  SELECT 0 AS lvl, pos AS i, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY lvl, i // 3),
top AS (SELECT lvl AS height, h AS root FROM upper ORDER BY lvl DESC LIMIT 1),
places AS (
  SELECT l.source, l.pos AS leaf_pos, g.lvl, l.pos // CAST(pow(3, g.lvl) AS BIGINT) AS i
  FROM leaves l JOIN (SELECT DISTINCT source, lvl FROM tree) g ON l.source IS NOT DISTINCT FROM g.source
  JOIN heights e ON e.source IS NOT DISTINCT FROM l.source AND g.lvl < e.height),
near AS (
  SELECT p.source, p.leaf_pos, p.lvl, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < p.i) AS b, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > p.i) AS a
  FROM places p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.lvl = p.lvl AND t.i // 3 = p.i // 3 GROUP BY p.source, p.leaf_pos, p.lvl, p.i),
far AS (
  SELECT s.source, u.lvl, string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.pos // CAST(pow(3, u.lvl) AS BIGINT)) AS b,
    string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.pos // CAST(pow(3, u.lvl) AS BIGINT)) AS a
  FROM subroots s, upper u, top WHERE u.lvl < top.height AND u.i // 3 = s.pos // CAST(pow(3, u.lvl + 1) AS BIGINT) GROUP BY s.source, u.lvl),
steps AS (
  SELECT source, leaf_pos, lvl, coalesce(b, '') AS b, coalesce(a, '') AS a FROM near
  UNION ALL
  SELECT l.source, l.pos, e.height + f.lvl, coalesce(f.b, ''), coalesce(f.a, '') FROM leaves l JOIN heights e ON e.source IS NOT DISTINCT FROM l.source
  JOIN far f ON f.source IS NOT DISTINCT FROM l.source),
listed AS (SELECT source, leaf_pos, list(struct_pack(b := b, a := a) ORDER BY lvl) AS path, string_agg(b || a, '' ORDER BY lvl) AS sibs FROM steps GROUP BY source, leaf_pos),
folded AS (
  SELECT source, pos, checked AS acc, 0 AS k FROM leaves
  UNION ALL
  SELECT f.source, f.pos, sha256(p.path[f.k + 1].b || f.acc || p.path[f.k + 1].a), f.k + 1
  FROM folded f JOIN listed p ON p.source IS NOT DISTINCT FROM f.source AND p.leaf_pos = f.pos WHERE f.k < len(p.path)),
ends AS (SELECT source, pos, arg_max(acc, k) AS acc FROM folded GROUP BY source, pos)
SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(coalesce(p.sibs, '')) AS proof_sha256, e.acc AS folded_root, e.acc = top.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN top
LEFT JOIN listed p ON p.source IS NOT DISTINCT FROM l.source AND p.leaf_pos = l.pos
JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos"""
