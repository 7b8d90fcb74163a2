"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised (lower case, runs of white space and ASCII punctuation as one
blank; bytes of UTF-8 are the characters). An item is cut into *patterns*: overlapping windows of
``window`` bytes, half a window apart, or the whole item if it is shorter. A document is contaminated if

- a pattern of length m aligns with a part of it with at most e = ``edit_rate`` * m edits, or
- it covers ``share`` of an item, wherever the quote is cut and whatever is replaced in between: an item's byte
  is covered if it lies in a q-gram that the document holds too, where at least ``RUN`` such q-grams lie within
  nearby diagonals (so common phrases of a few words do not add up). Of items under ``min_item`` / ``share``
  bytes, ``min_item`` bytes must be covered, or ``SHORT_SHARE`` of the item if that is less; or
- it holds an item of less than ``min_item`` bytes as a whole, between word borders.

*Filter.* Such a part shares at least m + 1 - q * (e + 1) q-grams with the pattern, all of them within e
diagonals. Diagonals are covered by overlapping bands (each twice as wide as the largest e, half a band
apart), so one band holds all of them. Shared q-grams are counted for (document, pattern, band) and
only bands that reach the bound go on. No alignment within the budget is lost. *Verification.* Banded
semi-global edit distance over those bands, for all of a batch at once. The covered share is a union of the
places of the shared q-grams; short items are looked up by hashes of the texts between word borders, and compared.

Scale. The patterns' index travels to the tasks and has a fixed bound: the benchmark is worked in blocks
of at most ``BLOCK_BYTES``, each one pass over the documents. Documents are not shuffled. Several blocks
meet by an aggregate on the row; one block needs none.

Defined cases. Null or empty texts: clean. Items without a letter or digit match nothing; null items are ignored;
repeated items are found alike. ``edits`` is the least number over an item's patterns, for an item found by its
covered share alone the number of its bytes that are not covered, and 0 for short items. Null or repeated ids:
each row is judged on its own text. Empty benchmark: all clean. Empty table: empty result. In
:func:`mark`, columns of the documents are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.shipping import shipped
from tillwise.llm.words import _BYTE, _GRAM, _powers, byte_chunks, gram_hashes, mix
from tillwise.llm.workers import kept, trim

Q, EDIT_RATE, WINDOW, MIN_ITEM = 10, 0.07, 160, 50
SHARE, SHORT_SHARE, RUN = 0.6, 0.85, 8
BLOCK_BYTES = 16 << 20

_MAP = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _MAP[_c] = _c
for _c in range(65, 91):
    _MAP[_c] = _c + 32


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and document borders in them. Upper case is folded for ASCII and Latin-1 letters."""
    x = _MAP[buf]
    if len(x) > 1:
        accent = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
        x[1:][accent] += 32
    keep = x != 32
    keep[1:] |= x[:-1] != 32  # the first blank of a run
    heads = offs[:-1][offs[1:] > offs[:-1]]
    keep[heads] = x[heads] != 32
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


@dataclass
class Index:
    """Patterns of a block of items, and their q-grams sorted by hash."""
    text: np.ndarray      # pattern bytes, one after the other
    start: np.ndarray     # of each pattern, with the end
    item: np.ndarray
    edits: np.ndarray
    bound: np.ndarray     # least number of shared q-grams
    grams: np.ndarray
    pattern: np.ndarray   # of each gram
    place: np.ndarray
    bitmap: np.ndarray
    own: np.ndarray       # whether no earlier pattern of the item holds the gram of that place
    q: int
    band: int
    row: np.ndarray       # of each pattern: its item's row here, and where it starts in the item
    offset: np.ndarray
    ids: np.ndarray       # of each row: item, bytes, and bytes that must be covered
    size: np.ndarray
    need: np.ndarray
    short: dict[int, tuple[np.ndarray, list[tuple[int, bytes]]]]  # by length: sorted hashes, and (item, text) of each


def build_index(items: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE, window: int = WINDOW, min_item: int = MIN_ITEM,
                share: float = SHARE) -> Index:
    texts, owners, offset, rows, ids, size = [], [], [], [], [], []
    short: dict[int, list[tuple[int, bytes]]] = {}
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        x, _ = normalised(raw, np.array([0, len(raw)]))
        x = x[:-1] if len(x) and x[-1] == 32 else x
        if len(x) < min_item:
            if len(x):
                short.setdefault(len(x), []).append((item, x.tobytes()))
            continue
        at = list(range(0, max(len(x) - window, 0) + 1, window // 2))
        if at[-1] + window < len(x):
            at.append(len(x) - window)
        texts += [x[i:i + window] for i in at]
        owners += [item] * len(at)
        offset += at
        rows += [len(ids)] * len(at)
        ids.append(item)
        size.append(len(x))
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    edits = (edit_rate * sizes).astype(np.int64)
    bound = np.maximum(sizes + 1 - q * (edits + 1), 1)
    g = gram_hashes(_BYTE[text], q)
    pattern = np.repeat(np.arange(len(sizes)), sizes)[:len(g)]
    ok = np.flatnonzero(np.arange(len(g)) + q <= start[pattern + 1]) if len(g) else np.zeros(0, np.int64)
    g, pattern, place = g[ok], pattern[ok], ok - start[pattern[ok]]
    first, row = np.array(offset, np.int64), np.array(rows, np.int64)
    upto = np.zeros(len(first), np.int64)  # how far the pattern before reaches into a pattern
    upto[1:] = np.where(row[1:] == row[:-1], first[:-1] + sizes[:-1] - first[1:], 0)
    own = place + q > upto[pattern]
    length = np.array(size, np.int64)
    need = np.ceil(np.maximum(share * length, np.minimum(SHORT_SHARE * length, min_item))).astype(np.int64)
    lookup = {}
    for n, found in short.items():
        h = np.concatenate([gram_hashes(_BYTE[np.frombuffer(t, np.uint8)], n) for _, t in found])
        by = np.argsort(h, kind="stable")
        lookup[n] = h[by], [found[i] for i in by.tolist()]
    order = np.argsort(g, kind="stable")
    bits = max(16, int(len(g)).bit_length() + 5)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[g >> np.uint64(64 - bits)] = True
    return Index(text, start, np.array(owners, np.int64), edits, bound, g[order], pattern[order], place[order], bitmap, own[order], q,
                 int(edits.max(initial=0)) + 1, row, first, np.array(ids, np.int64), length, need, lookup)


def _align(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, diagonal: np.ndarray, pattern: np.ndarray, ix: Index) -> np.ndarray:
    """Least edits of each pattern against its document x[lo:hi] inside diagonals [diagonal, diagonal + 2 * band)."""
    out = np.full(len(pattern), 1 << 30, np.int64)
    sizes = np.diff(ix.start)[pattern]
    width = 2 * ix.band
    j = np.arange(width)
    for a in range(0, len(pattern), 4096):
        part = slice(a, a + 4096)
        p, m, first = pattern[part], sizes[part], (lo[part] + diagonal[part])[:, None]
        l, h = lo[part][:, None], hi[part][:, None]
        d = np.zeros((len(p), width), np.int32)
        best = out[part]
        for i in range(int(m.max(initial=0))):
            at = first + i + j
            inside = (at >= l) & (at < h)
            c = x[np.clip(at, 0, len(x) - 1)]
            own = ix.text[np.minimum(ix.start[p] + i, len(ix.text) - 1)][:, None]
            step = d + ((c != own) | ~inside)
            step[:, :-1] = np.minimum(step[:, :-1], d[:, 1:] + 1)
            d = np.minimum.accumulate(step - j, axis=1) + j
            done = m == i + 1
            best[done] = d[done].min(axis=1)
    return out


def _shared(x: np.ndarray, ends: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, entry of the index) of each pair of equal q-grams."""
    none = (np.zeros(0, np.int64),) * 3
    g = gram_hashes(_BYTE[x], ix.q)
    if not len(g) or not len(ix.grams):
        return none
    at = np.flatnonzero(ix.bitmap[g >> np.uint64(64 - int(len(ix.bitmap) - 1).bit_length())])
    first = np.searchsorted(ix.grams, g[at], "left")
    count = np.searchsorted(ix.grams, g[at], "right") - first
    doc = np.searchsorted(ends, at, "right") - 1
    ok = (count > 0) & (at + ix.q <= ends[doc + 1])
    at, first, count, doc = at[ok], first[ok], count[ok], doc[ok]
    if not len(at):
        return none
    entry = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    d = np.repeat(doc, count)
    return d, np.repeat(at, count) - ends[d], entry


def _least(d: np.ndarray, item: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least edits for each document and item."""
    order = np.lexsort((edits, item, d))
    d, item, edits = d[order], item[order], edits[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
    return d[new], item[new], edits[new]


def _aligned(x: np.ndarray, ends: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, edits) of the patterns that align."""
    d, at, entry = pairs
    if not len(d):
        return pairs
    p = ix.pattern[entry]
    diagonal = at - ix.place[entry]
    base = int(diagonal.min()) // ix.band * ix.band
    band = (diagonal - base) // ix.band
    spread = int(band.max()) + 2
    key = (d * len(ix.item) + p) * spread + band + 1
    key, shared = np.unique(np.concatenate((key, key - 1)), return_counts=True)  # band b covers b and b + 1
    band, both = key % spread - 1, key // spread
    d, p = both // len(ix.item), both % len(ix.item)
    keep = shared >= ix.bound[p]
    band, d, p = band[keep], d[keep], p[keep]
    if not len(d):
        return (d,) * 3
    edits = _align(x, ends[d], ends[d + 1], base + band * ix.band, p, ix)
    found = edits <= ix.edits[p]
    return d[found], ix.item[p[found]], edits[found]


def _quoted(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, bytes not covered) of the items of which enough is covered."""
    d, at, entry = (a[ix.own[pairs[2]]] for a in pairs)
    if not len(d):
        return pairs if not len(pairs[0]) else (d,) * 3
    p = ix.pattern[entry]
    row, place = ix.row[p], ix.offset[p] + ix.place[entry]
    both = d * len(ix.ids) + row
    diagonal = at - place
    band = (diagonal - int(diagonal.min())) // ix.band
    key = both * (int(band.max()) + 2) + band + 1
    _, inverse, shared = np.unique(np.concatenate((key, key - 1)), return_inverse=True, return_counts=True)
    run = (shared >= RUN)[inverse]
    keep = run[:len(key)] | run[len(key):]
    both, place = both[keep], place[keep]
    if not len(both):
        return (both,) * 3
    order = np.lexsort((place, both))
    both, place = both[order], place[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    step = np.full(len(both), ix.q, np.int64)
    step[1:] = np.where(new[1:], ix.q, np.minimum(place[1:] - place[:-1], ix.q))
    heads = np.flatnonzero(new)
    covered, both = np.add.reduceat(step, heads), both[heads]
    d, row = both // len(ix.ids), both % len(ix.ids)
    found = covered >= ix.need[row]
    d, row = d[found], row[found]
    return d, ix.ids[row], ix.size[row] - covered[found]


def _whole(x: np.ndarray, ends: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, 0) of the short items between word borders."""
    out: list[tuple[int, int]] = []
    if ix.short and len(x):
        power, inverse = _powers(_GRAM, len(x) + 1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_BYTE[x] * power[:len(x)], out=total[1:])
        border = np.zeros(len(x) + 1, bool)  # of the text before a place
        border[ends] = True
        border[:-1] |= x == 32
        start = np.flatnonzero(x != 32)
        before = np.concatenate(([True], x[:-1] == 32))
        before[ends[:-1][ends[:-1] < len(x)]] = True
        start = start[before[start]]
        stop = ends[np.searchsorted(ends, start, "right")]
        for n, (hashes, items) in ix.short.items():
            s = start[start + n <= stop]
            s = s[border[s + n]]
            h = mix((total[s + n] - total[s]) * inverse[s])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                text, doc = x[s[i]:s[i] + n].tobytes(), int(np.searchsorted(ends, s[i], "right")) - 1
                out += [(doc, item) for item, t in items[lo[i]:hi[i]] if t == text]
    d, item = np.array(out, np.int64).reshape(-1, 2).T
    return d, item, np.zeros(len(d), np.int64)


def matches(buf: np.ndarray, offs: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, edits) of every pattern that aligns, the least edits for each document and item."""
    x, ends = normalised(buf, offs)
    return _least(*_aligned(x, ends, _shared(x, ends, ix), ix))


def found_items(buf: np.ndarray, offs: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, edits) of every item found: by a pattern, by the covered share, or whole."""
    x, ends = normalised(buf, offs)
    pairs = _shared(x, ends, ix)
    ways = _aligned(x, ends, pairs, ix), _quoted(pairs, ix), _whole(x, ends, ix)
    return _least(*(np.concatenate(c) for c in zip(*ways, strict=True)))


def _found(ix: Index):
    def run(texts: pa.Array) -> pa.Array:
        kept("decontaminate")
        lists: list[list[dict]] = []
        for lo, hi, buf, offs in byte_chunks(texts):
            part: list[list[dict]] = [[] for _ in range(hi - lo)]
            for d, item, edits in zip(*(a.tolist() for a in found_items(buf, offs, ix)), strict=True):
                part[d].append({"item_id": item, "edits": edits})
            lists += part
        trim()
        return pa.array(lists, pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())])))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_BYTES; one block is in the driver's memory at a time where it is used."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for b in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in rows.orderBy("item", "text").collect()]


def found_column(text: Column, ix: Index) -> Column:
    kind = "array<struct<item_id:bigint,edits:bigint>>"
    return F.arrow_udf(_found(ix), kind).asNondeterministic()(text)


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **how) -> DataFrame:
    """The documents with a column ``__found``: item ids and least edits of the items found (empty: clean)."""
    out, names = shipped(docs), []
    for b, items in enumerate(_blocks(benchmark, item_col, item_text_col)):
        names.append(f"__found{b}")
        out = out.withColumn(names[-1], found_column(F.col(text_col), build_index(items, **how)))
    return out.withColumn("__found", F.flatten(F.array(*names))).drop(*names)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its id, ``contaminated``, ``item_ids`` (ascending) and ``edits`` (least for each item)."""
    found = mark(docs.select(id_col, text_col), benchmark, text_col, **how)
    ranked = F.array_sort("__found")
    return found.select(id_col, (F.size("__found") > 0).alias("contaminated"), ranked["item_id"].alias("item_ids"), ranked["edits"].alias("edits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The clean documents, with their own columns."""
    return mark(docs, benchmark, text_col, **how).where(F.size("__found") == 0).drop("__found")
