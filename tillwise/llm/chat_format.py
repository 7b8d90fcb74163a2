"""Chat formatting with a grammar round trip.

*Template.* ``<<SYS>>text<</SYS>>`` for the system, ``[INST] text [/INST]`` for the user, ``<s>text</s>`` for the assistant, and
``[TURN]name\\ntext[/TURN]`` for any other role (its name percent-encoded), one after the other.

*Grammar.* A deterministic parser cuts the rendered text at the control strings; a turn is an opening one, a body without
any, and the closing one that belongs to it. In a body, a control string with one or more backslashes behind its first character
stands for the one with a backslash less.

*Round trip.* Turns are rendered as they are and parsed again. Where a recovered turn differs from its source, its text is
escaped (a backslash more behind the first character of whatever looks like a control string, escaped or not) and the whole
is rendered and parsed again, until it is identical.

*Output.* Rows of (conv_id, part, seq, whole, text, mask): a stretch of a conversation, and the spans of its characters that take part
in the loss, the assistant's bodies. Turns are range-sorted, so a conversation of any size is spread over tasks; a stretch ends after
``STRETCH_TURNS`` turns or ``STRETCH_CHARS`` characters, so memory follows the longest turn. ``whole`` marks a stretch
that is known to be a conversation of its own; only others are shuffled to be digested in order. Digests of a conversation
that spans tasks take one task that reads its parsed stretches as a stream.

Defined cases. Null or empty text: an empty body. Null role: the empty name, as another role. Null turn: sorted first. Null conv_id: one
conversation. Turns of the same number: by role, then by digest of the text. Very long texts pass as they are. An empty table gives
only what the caller adds to it. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.shipping import shipped
from tillwise.llm.turns import in_order

STRETCH_TURNS, STRETCH_CHARS = 256, 1 << 20
#: Opening and closing marks by role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[/TURN]")
CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[TURN]", "[/TURN]")
_TOKEN = re.compile("|".join(re.escape(c) for c in CONTROL))
_HEAD = "|".join(rf"{re.escape(head)}(?=\\{{0}}(?:{'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == head)}))" for head in "<[")
_PLAIN = re.compile(f"({_HEAD.format('*')})")
_ESCAPED = re.compile(rf"({_HEAD.format('+')})\\")

Turn = tuple[str, str]


class FormatError(ValueError):
    """The text is no sentence of the grammar."""


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{OTHER[0]}{quote(role, safe='')}\n", OTHER[1])


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end of the body) of each turn."""
    at = 0
    tokens = _TOKEN.finditer(text)
    for token in tokens:
        end = next(tokens, None)
        if token.start() != at or end is None:
            raise FormatError(f"no turn at {at}")
        if token[0] == OTHER[0]:
            start = text.find("\n", token.end(), end.start()) + 1
            role, close = unquote(text[token.end():start - 1]), OTHER[1]
            if not start or role in MARKS:
                raise FormatError(f"no role at {at}")
        else:
            role = next((r for r, (o, _) in MARKS.items() if o.rstrip() == token[0]), None)
            if role is None:
                raise FormatError(f"no turn at {at}")
            start, close = at + len(MARKS[role][0]), MARKS[role][1]
        stop = end.end() - len(close)
        if stop < start or text[stop:end.end()] != close or not text.startswith(_marks(role)[0], at):
            raise FormatError(f"turn at {at} is not closed")
        yield role, start, stop
        at = end.end()
    if at != len(text):
        raise FormatError(f"text behind the last turn at {at}")


def recovered(text: str) -> list[Turn] | None:
    """The turns that the text stands for; None if it is no sentence of the grammar."""
    try:
        return [(role, unescape(text[lo:hi])) for role, lo, hi in parse(text)]
    except FormatError:
        return None


def render(turns: list[Turn]) -> str:
    """The formatted text from which a parser gets exactly ``turns``."""
    def one(turn: Turn, escaped: bool) -> str:
        before, after = _marks(turn[0])
        return before + (escape(turn[1]) if escaped else turn[1]) + after

    pieces = [one(t, False) for t in turns]
    if recovered(text := "".join(pieces)) == turns:
        return text
    pieces = [p if recovered(p) == [t] else one(t, True) for p, t in zip(pieces, turns, strict=True)]
    if recovered(text := "".join(pieces)) == turns:
        return text
    if recovered(text := "".join(one(t, True) for t in turns)) == turns:
        return text
    raise FormatError("the turns cannot be told apart")


_MASK = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_STRETCH = [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("text", pa.string()), ("mask", _MASK)]
_STRETCH_DDL = "conv_id long, part long, seq long, whole boolean, text string, mask array<struct<start:long,end:long>>"
_PARSED = [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string()), ("chars", pa.int64())]
_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])


def _ddl(kinds: list[tuple]) -> str:
    return ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in kinds)


def _rows(batches: Iterable[pa.RecordBatch], step: int = 64) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield from zip(*[c.to_pylist() for c in b.slice(lo, step).columns], strict=True)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition to stretches. The first and the last conversation may go on in another partition."""
    part = TaskContext.get().partitionId()
    conv, turns, chars, seq, first, held = None, [], 0, 0, True, []

    def flush(whole: bool) -> None:
        nonlocal turns, chars, seq
        text = render(turns)
        mask = [{"start": lo, "end": hi} for role, lo, hi in parse(text) if role == "assistant"]
        held.append((conv, part, seq, whole, text, mask))
        turns, chars, seq = [], 0, seq + 1

    for now, role, text in _rows(batches):
        if turns and now != conv:
            flush(whole=not first and seq == 0)
            first, seq = False, 0
        elif len(turns) >= STRETCH_TURNS or chars >= STRETCH_CHARS:
            flush(whole=False)
        conv = now
        turns.append((role, text))
        chars += len(text)
        if len(held) >= 256 or sum(len(h[4]) for h in held[-4:]) >= STRETCH_CHARS:
            yield _batch(held, _STRETCH)
            held.clear()
    if turns:
        flush(whole=False)
    yield _batch(held, _STRETCH)


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the parser and the mask find in each stretch."""
    out, size = [], 0
    for conv, part, seq, text, mask in _rows(batches):
        found = recovered(text)
        if found is None:
            raise FormatError(f"stretch {seq} of part {part} does not parse")
        turns = "".join(f"{role}\n{body}\n" for role, body in found)
        loss = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
        out.append((conv, part, seq, len(found), turns, loss, len(text)))
        size += len(text)
        if size >= STRETCH_CHARS or len(out) >= 1024:
            yield _batch(out, _PARSED)
            out, size = [], 0
    yield _batch(out, _PARSED)


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parsed stretches in the order of (conversation, part, seq) to a row for each conversation."""
    now, out = None, []

    def end() -> None:
        conv, n, turns, chars, loss, formatted = now
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for conv, _, _, n, turns, loss, chars in _rows(batches):
        if now is None or conv != now[0]:
            if now is not None:
                end()
            now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        now[1] += n
        now[2].update(turns.encode())
        now[3] += len(loss)
        now[4].update(loss.encode())
        now[5] += chars
        if len(out) >= 4096:
            yield _batch(out, _DIGEST)
            out = []
    if now is not None:
        end()
    yield _batch(out, _DIGEST)


def format_chats(turns: DataFrame) -> DataFrame:
    """The formatted output, written to the shared folder: conv_id, part, seq, whole, text, mask."""
    rows = shipped(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize_table(in_order(rows).select("conv_id", "role", "text").mapInArrow(_stretches, _STRETCH_DDL), "chats")


def read_chats(chats: DataFrame) -> DataFrame:
    """What a reader finds in the output, by conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def parsed(rows: DataFrame) -> DataFrame:
        return shipped(rows).select("conv_id", "part", "seq", "text", "mask").mapInArrow(_parsed, _ddl(_PARSED))

    alone = parsed(chats.where("whole")).select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                                                F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
    spread = parsed(chats.where("NOT whole")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digested, _ddl(_DIGEST))
    return alone.unionByName(spread)


def chat_report(conversations: DataFrame) -> DataFrame:
    """All conversations, and one whose texts are made of control strings (-7), formatted and read back."""
    odd = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_chats(format_chats(rows.unionByName(odd)))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
formatted AS (
  SELECT *, sha256(text) AS digest, CASE role WHEN 'system' THEN '<<SYS>>' WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '<s>' ELSE '[TURN]' || url_encode(role) || chr(10) END
    || regexp_replace(regexp_replace(text, '<(\\*)(<SYS>>|</SYS>>|s>|/s>)', '<\\\1\2', 'g'), '\[(\\*)(INST\]|/INST\]|TURN\]|/TURN\])', '[\\\1\2', 'g')
    || CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE '[/TURN]' END AS out FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, digest)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, digest) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(out)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id"""
