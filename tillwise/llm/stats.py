"""Statistics of whole texts, for the quality operators: one numpy pass over each Arrow batch.

Counts are over words (see :mod:`tillwise.llm.words`), code points and lines (split at ``\\n``). A null or
empty text has zero for every count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.llm.words import _BASE, _BYTE, _WORD, Words, _powers, chunks, gram_hashes, mix
from tillwise.llm.workers import kept, trim

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
          "n_letters", "n_upper", "n_digits", "n_stops", "n_bangs", "n_commas", "n_pipes", "n_long_words",
          "n_short_words", "n_symbol_words", "n_upper_words", "n_chars")
#: What the classifiers look at: shares and logarithms of the counts.
FEATURES = ("log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "words_per_line",
            "distinct_share", "letter_share", "upper_share", "digit_share", "stop_rate", "bang_rate", "comma_rate",
            "pipe_rate", "long_word_share", "short_word_share", "symbol_word_share", "upper_word_share")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_DIGIT = _table(b"0123456789")
_STOP, _BANG, _COMMA, _PIPE = _table(b"."), _table(b"!"), _table(b",;:"), _table(b"|")
_HEAD = np.array([(i & 0xC0) != 0x80 for i in range(256)])  # first byte of a code point


def _dup_lines(w: Words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and lines with a word."""
    docs = len(w.offs) - 1
    if not len(w.start):
        return np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    n = len(w.buf)
    at = np.flatnonzero(w.buf == 10)
    full = w.offs[1:] > w.offs[:-1]
    start = np.unique(np.concatenate((w.offs[:-1][full], at + 1)))
    start = start[start < n]
    doc = np.searchsorted(w.offs, start, "right") - 1
    stop = np.minimum(np.append(at, n)[np.searchsorted(at, start)], w.offs[doc + 1])
    first = np.searchsorted(w.start, start)
    some = (first < np.searchsorted(w.start, stop)) & (stop > start)
    start, stop, doc = start[some], stop[some], doc[some]
    power, inverse = _powers(_BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[w.buf] * power[:n], out=total[1:])
    h = mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    lines = np.bincount(doc, minlength=docs)
    dup = np.zeros(docs, np.int64)
    ends = np.concatenate(([0], np.cumsum(lines)))
    for d in np.flatnonzero(lines > 1):
        s = np.sort(h[ends[d]:ends[d + 1]])
        dup[d] = np.count_nonzero(s[1:] == s[:-1])
    return dup, lines


def _repeats(h: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    """Per document: words inside windows of ``size`` words that are found twice or more in it."""
    grams = gram_hashes(h, size)
    out = np.zeros(len(first) - 1, np.int64)
    for d in np.flatnonzero(np.diff(first) > size):
        g = grams[first[d]:first[d + 1] - size + 1]
        s = np.sort(g)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(g, twice))
            delta = np.zeros(len(g) + size + 1, np.int64)
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + size, -1)
            out[d] = np.count_nonzero(np.cumsum(delta) > 0)
    return out


def count_rows(texts: pa.Array) -> np.ndarray:
    """A row of COUNTS for each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for lo, hi, w in chunks(texts):
        rows, offs, first = out[lo:hi], w.offs, w.first

        def per_doc(flag: np.ndarray, edges: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(flag)))[edges])

        h = w.hashes()
        head = _HEAD[w.buf] & _WORD[w.buf]
        ends = np.concatenate(([0], np.cumsum(head)))
        chars = ends[w.end] - ends[w.start]
        symbols, upper, letters = _SYMBOL[w.buf], _UPPER[w.buf], _LETTER[w.buf]
        in_word = [np.concatenate(([0], np.cumsum(x))) for x in (symbols, upper, letters)]
        in_word = [c[w.end] - c[w.start] for c in in_word]
        rows[:, 0] = w.counts
        rows[:, 1] = np.diff(ends[offs])
        rows[:, 2] = per_doc(symbols, offs)
        rows[:, 3], rows[:, 5] = _dup_lines(w, w.counts)
        rows[:, 4] = _repeats(h, first)
        for d in np.flatnonzero(w.counts):
            s = np.sort(h[first[d]:first[d + 1]])
            rows[d, 6] = 1 + np.count_nonzero(s[1:] != s[:-1])
        for i, flag in ((7, letters), (8, upper), (9, _DIGIT[w.buf]), (10, _STOP[w.buf]), (11, _BANG[w.buf]), (12, _COMMA[w.buf]), (13, _PIPE[w.buf])):
            rows[:, i] = per_doc(flag, offs)
        for i, flag in ((14, chars >= 12), (15, chars <= 2), (16, in_word[0] > 0), (17, (in_word[1] > 1) & (in_word[1] == in_word[2]))):
            rows[:, i] = per_doc(flag, first)
        rows[:, 18] = per_doc(_HEAD[w.buf], offs)
    return out


def _counts_udf(texts: pa.Array) -> pa.Array:
    kept("stats")
    rows = count_rows(texts)
    trim()
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], list(COUNTS))


def counts(text: Column | str) -> Column:
    """A struct of COUNTS for a text column (an Arrow function; evaluated once, hence not deterministic to the optimizer)."""
    schema = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    return F.arrow_udf(_counts_udf, schema).asNondeterministic()(text)


def features(c: str) -> list[Column]:
    """FEATURES as expressions over the struct column named c."""
    def x(name: str) -> Column:
        return F.col(f"{c}.{name}").cast("double")

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(x(a), x(b)), F.lit(0.0))

    pairs = [("word_chars", "n_words"), ("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"),
             ("n_words", "n_lines"), ("n_distinct_words", "n_words"), ("n_letters", "word_chars"), ("n_upper", "n_letters"),
             ("n_digits", "word_chars"), ("n_stops", "n_words"), ("n_bangs", "n_words"), ("n_commas", "n_words"), ("n_pipes", "n_words"),
             ("n_long_words", "n_words"), ("n_short_words", "n_words"), ("n_symbol_words", "n_words"), ("n_upper_words", "n_words")]
    return [e.alias(n) for e, n in zip([F.log1p(x("n_words")), *(share(*p) for p in pairs)], FEATURES, strict=True)]
