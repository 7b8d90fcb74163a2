"""Words and word-sequence hashes of whole Arrow batches, vectorised with numpy.

A *word* is a maximal run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return. Texts are handled as UTF-8 bytes; those separators never occur inside a multi-byte
character. A batch is worked in chunks of whole documents (about ``CHUNK_BYTES``; a longer document
is a chunk of its own), so memory follows the longest document, not the batch.

Null texts count as empty texts everywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_U = np.uint64
_SPACES = (9, 10, 11, 12, 13, 32)
_WORD = np.ones(256, bool)
_WORD[list(_SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept and grown as needed)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * CHUNK_BYTES:  # tables for a giant document are not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


class Words:
    """Words of consecutive documents. ``start``/``end``: byte positions of each word in ``buf``;
    ``first[d]:first[d + 1]``: the words of document d."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf, self.offs = (_LOWER[buf] if lower else buf), offs
        n = len(buf)
        word = _WORD[buf]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            full = offs[1:] > offs[:-1]
            before[offs[:-1][full]] = False
            after[offs[1:][full] - 1] = False
        self.is_word = word
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        n = len(self.buf)
        power, inverse = _powers(_BASE, n + 1)
        total = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[self.buf] * power[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))


def gram_hashes(h: np.ndarray, n: int, base: int = _GRAM) -> np.ndarray:
    """Hash of each run of n consecutive entries of h (document borders are the caller's business)."""
    if len(h) < n:
        return np.zeros(0, _U)
    power, inverse = _powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` entries, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have:]) if width > have else x


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document borders in them) for consecutive rows of a string array."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1), n)
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def chunks(texts: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for consecutive rows of a string array."""
    for lo, hi, buf, offs in byte_chunks(texts, limit):
        yield lo, hi, Words(buf, offs, lower)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 hashes as the signed longs that Spark has."""
    return x.view(np.int64)
