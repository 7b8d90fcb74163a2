"""Substring dedup by prefix-partitioned suffix trees over words.

A passage of ``min_words`` words that starts at two places or more of the corpus is removed wherever
it stands. Its suffix (the passage read from its first word) belongs to the subtree of its prefix;
corpus-wide, the subtrees are built group by group, each group small enough for one task's memory:

0. *Classes of equal texts.* Texts are counted by their digest. Every passage of a text that occurs twice stands at two
   places, so its documents lose all their words (if they have ``min_words``), and one of them alone goes on, for the passages
   that other texts share with it. Copies, of a text or of a whole row, cost a digest each from here on.
1. *Sparse prefixes.* Of the ``min_words - ANCHOR + 1`` prefixes of ANCHOR words that lie inside a
   passage, the one with the least hash is its anchor: equal passages have equal anchors at equal
   places, and neighbouring passages share one, so the words sent are about three times the text of
   the *candidates* and not ``min_words`` times the corpus.
2. *Prefix counts* over all documents. A prefix seen once heads a subtree with a single leaf, which
   has no inner node: its passages are done. This drops most of a corpus before any text moves.
3. *Variable-length prefixes.* Prefixes seen up to ``group_limit`` times are groups: their text
   slices meet in one task. A more frequent prefix is extended to the passage's full length; such a
   group is one node, so counting it (with map-side combining) replaces the tree, at any skew. Runs of
   passages that are equal as a whole are counted first, so copies of a hot passage are one row; those
   of one chunk of documents travel as one row with their places, and the marked runs of a chunk meet again
   and leave as one row a document.
4. *Subtrees.* In each group the suffixes are sorted word by word; neighbours that agree on at least
   ``min_words`` words hang under one deep inner node. Deep inner nodes with two leaves or more are
   the repeats; in each document, runs of them join to maximal repeated spans.
5. *Cutting.* The marked words of each document are dropped; the words kept are joined by one space.

Shuffles: the texts' digests; the (document, anchor prefix) pairs, about 7 % of the words at 16 bytes each, twice; the
texts once by document (the join with candidates and the final cut reuse that exchange); the
candidates' slices once. Nothing is collected; the digests of repeated texts are broadcast while they are counted to be
at most ``MAX_BROADCAST``, else they are joined by a shuffle.

Defined cases. Null text: no words, empty result text. Fewer than ``min_words`` words: nothing is
removed. Null or repeated ids: rows are told apart by id and text; identical rows are two occurrences
of all they hold, so each loses its long passages. Empty table: empty result. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.shipping import shipped
from tillwise.llm.words import Words, chunks, gram_hashes, mix, signed, sliding_min

ANCHOR = 8
#: Occurrences of a prefix up to which its suffixes are one in-memory group.
GROUP_LIMIT = 2000
#: Digests of repeated texts that are broadcast at most (about 100 MB).
MAX_BROADCAST = 500_000
_NO_ID = -(1 << 63)
_LOW = np.uint64((1 << 32) - 1)


def _runs(w: Words, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of ``length`` words with one anchor: document, first window's word
    (in the chunk), number of windows, hash of the anchor prefix."""
    h = w.hashes()
    if len(h) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = gram_hashes(h, anchor)
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, length - anchor + 1) & _LOW).astype(np.int64)
    doc = w.doc_of_word()
    p = np.flatnonzero(np.arange(len(at)) + length <= w.first[doc[:len(at)] + 1])
    if not len(p):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    a = at[p]
    head = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(p) != 1))))
    n = np.diff(np.append(head, len(p)))
    return doc[p[head]], p[head], n, grams[a[head]]


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid = b.column("rid").to_numpy()
        for lo, _, w in chunks(b.column("text")):
            doc, _, _, key = _runs(w, length, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(rid[lo + doc]), pa.array(signed(key))], ["rid", "key"])


def _member(doc: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """For each (row, key): whether the row's list holds the key."""
    offs = lists.offsets.to_numpy()
    values = lists.values.to_numpy()[offs[0]:offs[-1]]
    rows = np.repeat(np.arange(len(lists)), np.diff(offs))
    have = np.rec.fromarrays([rows, values]).view([("r", np.int64), ("k", np.int64)])
    want = np.rec.fromarrays([doc, key]).view([("r", np.int64), ("k", np.int64)])
    order = np.lexsort((have["k"], have["r"]))
    r, k = have["r"][order], have["k"][order]
    # position of each wanted pair: both arrays are sorted by row, so search keys inside each row's span
    out = np.zeros(len(doc), bool)
    lo, hi = np.searchsorted(r, want["r"], "left"), np.searchsorted(r, want["r"], "right")
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = k[np.minimum(mid, max(len(k) - 1, 0))] if len(k) else np.zeros(len(mid), np.int64)
        out |= open_ & (at == want["k"])
        less = open_ & (at < want["k"])
        lo = np.where(less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return out


def _slices(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The words under each run of windows whose anchor prefix is a group."""
    for b in batches:
        rid, did = b.column("rid").to_numpy(), b.column("did").to_numpy()
        for lo, hi, w in chunks(b.column("text")):
            doc, p, n, key = _runs(w, length, anchor)
            keep = _member(doc, signed(key), b.column("light").slice(lo, hi - lo))
            doc, p, n, key = doc[keep], p[keep], n[keep], signed(key)[keep]
            raw = w.buf.tobytes()
            text = [raw[s:e] for s, e in zip(w.start[p].tolist(), w.end[p + n + length - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(rid[lo + doc]), pa.array(did[lo + doc]),
                 pa.array((p - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary())],
                ["key", "rid", "did", "start", "n", "slice"])


def _frequent_runs(batches: Iterator[pa.RecordBatch], length: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """The runs of windows under a very frequent anchor: a 128-bit fingerprint of the run, one of each of its windows, and the
    places where it occurs. Equal runs of a chunk are one row; ``chunk`` is the same for all rows of one."""
    kind = pa.struct([("f1", pa.int64()), ("f2", pa.int64())])
    for b in batches:
        rid, did = b.column("rid").to_numpy(), b.column("did").to_numpy()
        for lo, hi, w in chunks(b.column("text"), limit=1 << 19):
            doc, p, n, key = _runs(w, length, anchor)
            keep = _member(doc, signed(key), b.column("heavy").slice(lo, hi - lo))
            doc, p, n, key = doc[keep], p[keep], n[keep], key[keep]
            if not len(p):
                continue
            h = w.hashes()
            heads = np.concatenate(([0], np.cumsum(n)))
            at = np.repeat(p - heads[:-1], n) + np.arange(heads[-1])
            f1, f2 = (gram_hashes(h, length, base)[at] for base in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
            place = (np.arange(heads[-1]) - np.repeat(heads[:-1], n)).astype(np.uint64) + np.uint64(1)
            r1, r2 = (mix(np.add.reduceat(mix(f + mix(place)), heads[:-1]) + n.astype(np.uint64)) for f in (f1, f2))
            windows = pa.StructArray.from_arrays([pa.array(signed(f1)), pa.array(signed(f2))], fields=list(kind))
            windows = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), windows)
            order = np.lexsort((r2, r1))
            new = np.flatnonzero(np.concatenate(([True], (np.diff(r1[order]) != 0) | (np.diff(r2[order]) != 0))))
            one = order[new]
            places = pa.StructArray.from_arrays([pa.array(rid[lo + doc[order]]), pa.array(did[lo + doc[order]]),
                                                 pa.array((p - w.first[doc])[order].astype(np.int32))], ["rid", "did", "start"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(r1[one])), pa.array(signed(r2[one])), pa.array(n[one].astype(np.int32)), windows.take(pa.array(one)),
                 pa.array(np.full(len(one), rid[lo])), pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), places)],
                ["r1", "r2", "n", "windows", "chunk", "places"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marked runs of whole chunks, as one row a document."""
    for b in batches:
        for i in range(b.num_rows):
            runs = b.column("runs").slice(i, 1).flatten()
            places = runs.field("places")
            mask = runs.field("mask").to_numpy()[pc.list_parent_indices(places).to_numpy()]
            rid, did, start = (places.flatten().field(c).to_numpy() for c in ("rid", "did", "start"))
            order = np.lexsort((start, rid))
            heads = np.flatnonzero(np.concatenate(([True], np.diff(rid[order]) != 0)))
            marks = pa.StructArray.from_arrays([pa.array(x[order]) for x in (did, start, mask)], ["did", "start", "mask"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid[order][heads]), pa.ListArray.from_arrays(pa.array(np.append(heads, len(order)).astype(np.int32)), marks)], ["rid", "marks"])


def _deep_nodes(t: pa.Table, length: int) -> pa.RecordBatch:
    """Suffixes of whole groups, sorted word by word; marks the windows below a deep inner node."""
    slices = t.column("slice").combine_chunks()
    offs = np.frombuffer(slices.buffers()[1], np.int32)[slices.offset:slices.offset + len(slices) + 1].astype(np.int64)
    data = np.frombuffer(slices.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    w = Words(data, offs - offs[0])
    _, ids = np.unique(w.hashes(), return_inverse=True)
    n = t.column("n").to_numpy()
    _, group = np.unique(t.column("key").to_numpy(), return_inverse=True)
    heads = np.concatenate(([0], np.cumsum(n)[:-1]))
    inside = np.arange(n.sum()) - np.repeat(heads, n)
    at = np.repeat(w.first[:-1], n) + inside
    suffix = np.empty((len(at), length + 1), ">u4")
    suffix[:, 0] = np.repeat(group, n)
    for j in range(length):
        suffix[:, j + 1] = ids[at + j]
    flat = suffix.view(f"V{4 * (length + 1)}").ravel()
    order = np.argsort(flat, kind="stable")
    deep = flat[order[1:]] == flat[order[:-1]]  # neighbours whose common prefix reaches min_words
    marked = np.zeros(len(at), np.int64)
    marked[order[1:][deep]] = 1
    marked[order[:-1][deep]] = 1
    mask = np.bitwise_or.reduceat(marked << inside, heads)
    some = np.flatnonzero(mask)
    keep = t.take(pa.array(some)).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [keep.column(c).combine_chunks() for c in ("rid", "did", "start")] + [pa.array(mask[some])],
        ["rid", "did", "start", "mask"])


def _subtrees(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole groups at a time from rows sorted by prefix; the last group waits for the next batch."""
    held = None
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = pa.Table.from_batches([b.slice(lo, 4096)])
            held = part if held is None else pa.concat_tables([held, part])
            key = held.column("key").to_numpy()
            cut = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if cut:
                yield _deep_nodes(held.slice(0, cut).combine_chunks(), length)
                held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield _deep_nodes(held.combine_chunks(), length)


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        did = b.column("did").to_numpy()
        marks = b.column("marks")
        for lo, hi, w in chunks(b.column("text")):
            part = marks.slice(lo, hi - lo)
            flat, parents = part.flatten(), pc.list_parent_indices(part).to_numpy()
            own, start, mask = (flat.field(i).to_numpy() for i in range(3))
            ok = own == did[lo + parents] if len(own) else np.zeros(0, bool)
            start, mask, parents = start[ok], mask[ok], parents[ok]
            row, bit = np.nonzero((mask[:, None] >> np.arange(62)) & 1) if len(mask) else (start, start)
            at = w.first[parents[row]] + start[row] + bit
            delta = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + length, -1)
            gone = np.cumsum(delta)[:-1] > 0
            # the kept words' bytes, and one separator after each but a document's last
            doc = w.doc_of_word()
            kept = np.flatnonzero(~gone)
            byte = np.zeros(len(w.buf) + 1, np.int8)
            byte[w.start[kept]] += 1
            byte[w.end[kept]] -= 1
            mask_b = np.cumsum(byte[:-1], dtype=np.int8).astype(bool)
            more = np.flatnonzero(doc[kept[1:]] == doc[kept[:-1]])
            buf = w.buf.copy()
            buf[w.end[kept[more]]] = 32
            mask_b[w.end[kept[more]]] = True
            out = buf[mask_b].tobytes()
            ends = np.concatenate(([0], np.cumsum(mask_b)))[w.offs]
            texts = [out[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            total = np.concatenate(([0], np.cumsum(gone)))
            cols = [b.column("did").slice(lo, hi - lo), pa.array(w.counts), pa.array(np.diff(total[w.first])),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["did", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8))))
                edge[w.first[:-1][w.counts > 0]] = gone[w.first[:-1][w.counts > 0]]
                s = np.flatnonzero(edge == 1)
                after = np.concatenate((gone[1:] & (doc[1:] == doc[:-1]), [False])) if len(gone) else gone
                e = np.flatnonzero(gone & ~after) + 1
                spans = [[] for _ in range(hi - lo)]
                for d, x, y in zip(doc[s].tolist(), (s - w.first[doc[s]]).tolist(), (e - w.first[doc[s]]).tolist(), strict=True):
                    spans[d].append({"start": x, "end": y})
                cols += [pa.array(texts, pa.binary()).cast(pa.string()),
                         pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35,
                     group_limit: int = GROUP_LIMIT, with_text: bool = True) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_removed``, ``kept_sha256`` and, by default,
    ``kept_text`` and ``removed`` (maximal repeated spans, as word positions)."""
    anchor = min(ANCHOR, min_words)
    if min_words - anchor + 1 > 62:
        anchor = min_words - 61  # the windows of one anchor are bits of a long
    every = shipped(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("class", F.sha2("text", 256))
    copied = materialize_table(every.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first")).where("n > 1").drop("n"), "copied-texts")
    every = every.join(F.broadcast(copied) if copied.count() <= MAX_BROADCAST else copied, "class", "left")
    alone = every.where("first IS NULL").select("did", "text").withColumn("rid", F.xxhash64("did", "text"))
    firsts = every.where("did = first").dropDuplicates(["did", "class"]).select("did", "text").withColumn("rid", F.xxhash64("did", "text"))
    firsts = materialize_table(firsts, "copied-firsts")  # one text a class, read by every pass below
    base = alone.unionByName(firsts)
    anchors = base.mapInArrow(partial(_anchor_rows, length=min_words, anchor=anchor), "rid long, key long")
    prefixes = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1") \
        .select("key", (F.col("n") > group_limit).alias("frequent"))
    found = anchors.join(prefixes, "key").groupBy("rid").agg(
        F.collect_set(F.when(~F.col("frequent"), F.col("key"))).alias("light"),
        F.collect_set(F.when(F.col("frequent"), F.col("key"))).alias("heavy"))
    candidates = base.join(found, "rid")
    trees = candidates.where(F.size("light") > 0) \
        .mapInArrow(partial(_slices, length=min_words, anchor=anchor),
                    "key long, rid long, did long, start int, n int, slice binary") \
        .repartition("key").sortWithinPartitions("key") \
        .mapInArrow(partial(_subtrees, length=min_words), "rid long, did long, start int, mask long")
    runs = candidates.where(F.size("heavy") > 0) \
        .mapInArrow(partial(_frequent_runs, length=min_words, anchor=anchor),
                    "r1 long, r2 long, n int, windows array<struct<f1:bigint,f2:bigint>>, chunk long, places array<struct<rid:bigint,did:bigint,start:int>>")
    # a run that occurs twice is all repeated; of one that occurs once, each window may occur in another run
    distinct = runs.groupBy("r1", "r2").agg(F.sum(F.size("places")).alias("c"), F.any_value("n").alias("n"), F.any_value("windows").alias("windows"))
    nodes = distinct.select("c", F.inline("windows")).groupBy("f1", "f2").agg(F.sum("c").alias("c")).where("c > 1").drop("c")
    single = distinct.where("c = 1").select("r1", "r2", F.posexplode("windows").alias("at", "f")) \
        .select("r1", "r2", "at", "f.f1", "f.f2").join(nodes, ["f1", "f2"]) \
        .groupBy("r1", "r2").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"))
    twice = distinct.where("c > 1").select("r1", "r2", (F.expr("shiftleft(1L, n)") - 1).alias("mask"))
    kind = "array<struct<did:bigint,start:int,mask:bigint>>"
    deep = runs.select("r1", "r2", "chunk", "places").join(single.unionByName(twice), ["r1", "r2"]) \
        .groupBy("chunk").agg(F.collect_list(F.struct("places", "mask")).alias("runs")).mapInArrow(_by_document, f"rid long, marks {kind}")
    marks = trees.select("rid", F.array(F.struct("did", "start", "mask")).alias("marks")).unionByName(deep) \
        .groupBy("rid").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    no_marks: Column = F.array().cast(kind)
    schema = "did long, n_words long, n_removed long, kept_sha256 string"
    if with_text:
        schema += ", kept_text string, removed array<struct<start:int,end:int>>"
    cut = alone.join(marks, "rid", "left").withColumn("marks", F.coalesce("marks", no_marks)) \
        .mapInArrow(partial(_cut, length=min_words, with_text=with_text), schema)
    copies = every.where("first IS NOT NULL").select(F.lit(0).cast("long").alias("rid"), "did", "text", no_marks.alias("marks")) \
        .mapInArrow(partial(_cut, length=min_words, with_text=with_text), schema)
    gone = F.col("n_words") >= min_words
    copies = copies.withColumns({"n_removed": F.when(gone, F.col("n_words")).otherwise(0),
                                 "kept_sha256": F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256"))})
    if with_text:
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
        copies = copies.withColumns({"kept_text": F.when(gone, "").otherwise(F.col("kept_text")), "removed": F.when(gone, whole).otherwise(F.col("removed"))})
    cut = cut.unionByName(copies)
    return cut.select(F.when(F.col("did") != _NO_ID, F.col("did")).alias(id_col), *cut.columns[1:])
