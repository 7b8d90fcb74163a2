"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Turns are sorted by a range shuffle, so a conversation with a third of all rows lies in many tasks. Duplicates are the
turns behind the first one of their (conversation, role, digest of the text): a count that folds before it shuffles. Each
run of at most 256 consecutive turns of a conversation becomes a string of letters, and bidirectional Dijkstra
(``edit_lattice``) gives its table of cheapest edits between grammar states; most conversations are one run. The tables
of a longer conversation are joined in order, which takes a few string operations for 256 turns.

A last pass reads audit and turns in order as a stream and applies the edits. A digest of a whole conversation has to be fed
from its first byte to its last by one task, but that task holds a batch of turns and the audit (one letter a turn, as in
the result), never the conversation.

Defined cases. Null role or text: one space (so a null text is blank, a null role is neither of the three). Null turn: sorted
first, no part of ``gaps``. Null conv_id: one conversation. Turns of the same number: by role, then by digest of the text. Very
long texts pass as they are. A conversation without any turn left: zeros, empty audit, digest of the empty text. An empty table
gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.edit_lattice import AFTER, ENDS, START, USER, edit_table, joined
from tillwise.llm.merkle import CRC32
from tillwise.llm.shipping import shipped
from tillwise.llm.turns import in_order

RUN_BITS = 8  # 256 turns
BLANK, DUPLICATE, CUT = 1, 2, 3
_WORDY = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def spaced(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage by crc32(conv_id:turn) % 20: 0 drops the turn, 1 empties it, 2 takes its ``[.!?]``, 3 repeats it, 4 says it is
    the user's."""
    lot = F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20
    text = spaced(F.col("text"))
    out = rows.select("conv_id", "turn", spaced(F.col("role")).alias("role"), text.alias("text"), lot.alias("lot")).where(F.col("lot") != 0)
    out = out.withColumn("text", F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", F.explode(copies)).drop("col")


def _faults(turns: DataFrame) -> DataFrame:
    """conv_id, pos, fault (0, or the first one) and letter (see ``edit_lattice``) of each turn."""
    flags = turns.select("conv_id", "pos", "role", "digest", (~F.col("text").rlike(_WORDY)).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("cut"))
    firsts = flags.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    flags = flags.join(firsts, "pos", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    flags = flags.select("conv_id", "pos", fault.alias("fault"), letter.alias("letter"))
    letter = F.when(F.col("fault").isin(BLANK, DUPLICATE), "x").when(F.col("fault") == CUT, F.upper("letter")).otherwise(F.col("letter"))
    return flags.withColumn("letter", letter)


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, runs = b.column("conv_id"), b.column("run")
        tables = [[dict(zip(("entry", "exit", "cost", "audit"), x, strict=True)) for x in edit_table(*row)]
                  for row in zip(b.column("codes").to_pylist(), b.column("first").to_pylist(), b.column("last").to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([ids, runs, pa.array(tables, kind)], ["conv_id", "run", "edits"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables in the order of (conversation, run) to (conv_id, cost, audit)."""
    now, labels, out = None, None, []

    def end():
        out.append((now, *min(labels[g] for g in ENDS if g in labels)))

    for b in batches:
        for conv, edits in zip(b.column("conv_id").to_pylist(), b.column("edits").to_pylist(), strict=True):
            if labels is None or conv != now:
                if labels is not None:
                    end()
                now, labels = conv, {START: (0, "")}
            labels = joined(labels, [(e["entry"], e["exit"], e["cost"], e["audit"]) for e in edits])
        if len(out) >= 4096:
            yield _batch(out, _AUDITS)
            out = []
    if labels is not None:
        end()
        yield _batch(out, _AUDITS)


_AUDITS = [("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_REPORT = [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
           ("audit", pa.string()), ("repaired_sha256", pa.string())]
_EDITS_DDL = "conv_id long, run long, edits array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def _ddl(kinds: list[tuple]) -> str:
    return ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds)


class _Repair:
    """Applies an audit to the turns of one conversation as they come."""

    def __init__(self, conv: int | None):
        self.conv, self.cost, self.audit, self.at = conv, 0, "", 0
        self.state, self.sha, self.empty = START, hashlib.sha256(), True
        self.faults = [0, 0, 0, 0]
        self.illegal, self.last = 0, None
        self.turns, self.low, self.high = 0, None, None

    def _emit(self, role: str, text: str) -> None:
        self.sha.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty, self.state = False, AFTER[self.state][role[:1]]

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._emit(self._due(), "")
            self.at += 1

    def _due(self) -> str:
        return "assistant" if self.state == USER else "user"

    def turn(self, number: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if number is not None and number != self.high:
            self.turns, self.high = self.turns + 1, number
            self.low = number if self.low is None else self.low
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._emit(role if edit == "K" else self._due(), text)

    def row(self) -> tuple:
        self._inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.audit, self.sha.hexdigest()


def _repaired(batches: Iterable[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows by (conversation, pos) to a report for each conversation: pos -1 has the cost and the audit, if there is any; of
    the two rows of a turn, the first one has its fault."""
    now, out, known = None, [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            for conv, pos, turn, role, text, fault, cost, audit in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Repair(conv)
                if fault is not None:
                    known = fault
                elif pos >= 0:
                    now.turn(turn, role, text, known)
                elif audit is not None:
                    now.cost, now.audit = cost, audit
        if len(out) >= 4096:
            yield _batch(out, _REPORT)
            out = []
    if now is not None:
        out.append(now.row())
        yield _batch(out, _REPORT)


def repair(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """Report of each conversation in ``everyone`` (conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its ``turns`` (conv_id, turn, role, text)."""
    turns = materialize_table(in_order(shipped(turns)).withColumn("pos", F.monotonically_increasing_id()), "repair-turns")
    faults = materialize_table(_faults(turns), "repair-faults")

    runs = faults.groupBy("conv_id", F.shiftright("pos", RUN_BITS).alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "letter"))).alias("at"))
    runs = runs.select("conv_id", "run", F.array_join(F.col("at.letter"), "").alias("codes"))
    whole = faults.groupBy(F.col("conv_id").alias("of")).agg(F.shiftright(F.min("pos"), RUN_BITS).alias("lo"), F.shiftright(F.max("pos"), RUN_BITS).alias("hi"))
    runs = runs.join(whole, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "run", "codes", (F.col("run") == F.col("lo")).alias("first"), (F.col("run") == F.col("hi")).alias("last"))
    audits = runs.mapInArrow(_tables, _EDITS_DDL).repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(_joined, _ddl(_AUDITS))

    there = everyone.select(F.col("conv_id").cast("long")).distinct().withColumn("pos", F.lit(-2).cast("long"))
    heads = audits.withColumn("pos", F.lit(-1).cast("long"))
    marks = faults.select(F.col("conv_id").cast("long").alias("conv_id"), "pos", "fault")
    body = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "pos", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = there  # one stream: texts are shuffled to their conversation once, and no join carries them
    for more in (heads, marks, body):
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.select("conv_id", "pos", "turn", "role", "text", "fault", "cost", "audit")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.asc_nulls_last("fault"))
    return rows.mapInArrow(_repaired, _ddl(_REPORT))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, then repairs them."""
    return repair(damaged(conversations), conversations)


_LOT = CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")


def _sql_step(state: str, cost: str, letter: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || {letter})"


def _sql_least(*labels: str) -> str:
    return f"list_min([{', '.join(labels)}])"


_FAR = "struct_pack(c := 1000000000::BIGINT, a := '')"
ORACLE_SQL = f"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_LOT} % 20 AS lot FROM conversations),
kept AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM lots WHERE lot <> 0),
turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM kept),
flags AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, left(role, 1) AS ini, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) AS prev FROM turns),
faults AS (
  SELECT *, CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN cut THEN 3 ELSE 0 END AS fault,
    CASE WHEN blank OR again THEN NULL WHEN ini = 'u' THEN 0 ELSE 1 END + CASE WHEN cut THEN 5 ELSE 0 END AS cu, CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS lu,
    CASE WHEN blank OR again THEN NULL WHEN ini = 'a' THEN 0 ELSE 1 END + CASE WHEN cut THEN 5 ELSE 0 END AS ca, CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END AS la,
    CASE WHEN ini = 's' AND NOT blank AND NOT again THEN CASE WHEN cut THEN 5 ELSE 0 END END AS cs FROM flags),
best AS (
  SELECT conv_id, 0::BIGINT AS k, struct_pack(c := 0::BIGINT, a := '') AS s0, {_FAR} AS s1, struct_pack(c := 5::BIGINT, a := 'I') AS s2, struct_pack(c := 10::BIGINT, a := 'II') AS s3
  FROM (SELECT DISTINCT conv_id FROM turns)
  UNION ALL
  SELECT conv_id, k, s0, s1, s2, {_sql_least('s3', _sql_step('s2', '5', "'I'"))} FROM (
    SELECT conv_id, k, s0, s1, {_sql_least('s2', *[_sql_step(s, '5', "'I'") for s in ('s0', 's1', 's3')])} AS s2, s3 FROM (
      SELECT b.conv_id, b.k + 1 AS k, {_sql_step('s0', '2', "'D'")} AS s0,
        {_sql_least(_sql_step('s1', '2', "'D'"), f"CASE WHEN f.cs IS NULL THEN {_FAR} ELSE {_sql_step('s0', 'f.cs', chr(39) + 'K' + chr(39))} END")} AS s1,
        {_sql_least(_sql_step('s2', '2', "'D'"), *[f"CASE WHEN f.cu IS NULL THEN {_FAR} ELSE {_sql_step(s, 'f.cu', 'f.lu')} END" for s in ('s0', 's1', 's3')])} AS s2,
        {_sql_least(_sql_step('s3', '2', "'D'"), f"CASE WHEN f.ca IS NULL THEN {_FAR} ELSE {_sql_step('s2', 'f.ca', 'f.la')} END")} AS s3
      FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.k + 1))),
audits AS (SELECT conv_id, arg_max({_sql_least('s0', 's3')}, k) AS s FROM best GROUP BY conv_id),
letters AS (SELECT conv_id, p, substr(s.a, p, 1) AS l FROM (SELECT conv_id, s, unnest(range(1, length(s.a) + 1)) AS p FROM audits)),
placed AS (
  SELECT *, sum((l <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS r, sum((l <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS e FROM letters),
emitted AS (
  SELECT p.conv_id, p.e, p.l, CASE WHEN p.l <> 'I' THEN f.role END AS role, CASE WHEN p.l <> 'I' THEN f.text ELSE '' END AS text FROM placed p
  LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.r WHERE p.l <> 'D'),
led AS (SELECT *, max((e = 1 AND l = 'K' AND role LIKE 's%')::INT) OVER (PARTITION BY conv_id) AS led FROM emitted),
hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY e)) AS repaired FROM led GROUP BY conv_id),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank, CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, coalesce(a.s.c, 0) AS cost, coalesce(a.s.a, '') AS audit, coalesce(h.repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id"""
