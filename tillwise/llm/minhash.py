"""MinHash near-dedup: circulant signatures, banding, exact Jaccard verification, components.

*Signatures.* A document's set is its distinct word 5-shingles (64-bit hashes). Two permutations of a
circular universe of 2**32 places give every coordinate: sigma places a shingle on the circle, pi is
read at that place shifted by k, and coordinate k is the least pi over the set (C-MinHash). 30 bands of
6 coordinates miss a pair at similarity 0.85 with probability (1 - 0.85**6)**30 < 1e-6.

*Classes.* Documents with equal sets (128-bit fingerprint) are one class from the start, with partial
aggregation, so thousands of exact copies cost one row each and no pairs.

*Candidates without pairs of a group.* Rows of a band bucket are compared with the bucket's hub, the
member whose buckets are the fullest in sum (the original among its near copies): as many pairs as
rows. What is not linked to its hub may still link to another member. Small buckets (``small_bucket``)
compare such members with all members. In larger buckets a member is compared only where the link is
still possible: a shingle that no other candidate holds cannot be shared, so the overlap of two sets
is at most the smaller number of *shared* shingles. Moreover, inside the hub's set two members share at most
what the one with less of it has (known from the comparison with the hub), and outside at most the smaller
number of their shared shingles there: near copies that lost different parts of an original are told apart
without a comparison. 100 * overlap >= 85 * union must be reachable with the two sizes, and for each member
with the smallest set of its bucket. These bounds are exact: they drop no pair that could be a link.

*Links* are confirmed on the full sets, in the JVM (``array_intersect``); components come from the links.

Shuffles: 30 band rows of 20 bytes per class, the texts of candidate documents once, and the
candidates' sets once for each pair kept. Tables read more than once are written to the shared folder.

Defined cases. Null or empty text, or no words: empty set, linked with nothing, kept. Fewer words than
a shingle: the whole sequence is the one shingle. Null id: the row is kept, has no component and links
with nothing. Rows that share an id are one node. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.components import connected_components
from tillwise.llm.shipping import shipped
from tillwise.llm.words import Words, chunks, gram_hashes, mix, signed
from tillwise.llm.workers import kept, trim

SHINGLE = 5
BANDS, ROWS = 30, 6
#: Rows of a bucket up to which members not linked to the hub meet all members.
SMALL_BUCKET = 16
_NONE = np.zeros(0, np.uint64)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (document, hash), and the number of each document."""
    h, counts, n_docs = w.hashes(), w.counts, len(w.offs) - 1
    grams = gram_hashes(h, size)
    doc = w.doc_of_word()
    whole = np.flatnonzero(np.arange(len(grams)) + size <= w.first[doc[:len(grams)] + 1])
    parts, owners = [grams[whole]], [doc[whole]]
    for m in range(1, size):  # short documents: the whole sequence
        short = np.flatnonzero(counts == m)
        if len(short):
            parts.append(mix(gram_hashes(h, m)[w.first[short]] + np.uint64(m)))
            owners.append(short)
    s, d = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    ends = np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n_docs))))
    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        s[x:y].sort()
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], np.bincount(d[new], minlength=n_docs)


def _pi(place: np.ndarray, t: np.ndarray) -> None:
    """The second permutation of the 2**32 places, in place (murmur's 32-bit finaliser)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(place, np.uint32(shift), out=t)
        np.bitwise_xor(place, t, out=place)
        if factor:
            np.multiply(place, np.uint32(factor), out=place)


def signatures(s: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of consecutive non-empty sets: one row a set."""
    sigma = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    heads = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = np.empty((len(sizes), coordinates), np.uint32)
    v, t = np.empty_like(sigma), np.empty_like(sigma)
    for k in range(coordinates):
        np.add(sigma, np.uint32(k), out=v)
        _pi(v, t)
        out[:, k] = np.minimum.reduceat(v, heads)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            x = mix(x + sig[:, b * rows + r])
        key[:, b] = x
    return key


def _signature_rows(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    kept("minhash")
    for b in batches:
        for lo, hi, w in chunks(b.column("text"), lower=True, limit=1 << 19):
            s, sizes = shingle_sets(w, shingle)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            raw = memoryview(s).cast("B") if len(s) else b""
            prints = [xxhash.xxh3_128_intdigest(raw[8 * x:8 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            fp = np.array([(x >> 64, x & ((1 << 64) - 1)) for x in prints], np.uint64).reshape(-1, 2)
            full = sizes > 0
            keys = band_keys(signatures(s, sizes[full], bands * rows), bands, rows) if full.any() else np.zeros((0, bands), np.uint64)
            offs = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("did").slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(signed(fp[:, 0].copy())),
                 pa.array(signed(fp[:, 1].copy())), pa.ListArray.from_arrays(pa.array(offs), pa.array(signed(keys.ravel())))],
                ["did", "n", "f1", "f2", "bands"])
        trim()


def _set_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, w in chunks(b.column("text"), lower=True):
            s, sizes = shingle_sets(w, shingle)
            offs = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("did").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offs), pa.array(signed(s)))], ["did", "s"])
        trim()


def _reachable(a: Column | str, b: Column | str, overlap: Column, percent: int) -> Column:
    """Whether that overlap of sets of sizes a and b is percent / 100 of their union or more."""
    return 100 * overlap >= percent * (F.col(a) + F.col(b) - overlap) if isinstance(a, str) else 100 * overlap >= percent * (a + b - overlap)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with the overlap of their full sets (``both``) and whether it makes a link. Pairs are spread by b first, so a hub's set travels to the pairs' tasks
    through a join whose skewed side is split."""
    x = sets.select(F.col("did").alias("b"), F.col("s").alias("sb"))
    y = sets.select(F.col("did").alias("a"), F.col("s").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    # both are shuffle joins at any size: sets are long, and their total grows with the candidates
    return pairs.hint("merge").join(x, "b").hint("merge").join(y, "a")\
        .select("a", "b", both.alias("both"), _reachable(F.size("sa"), F.size("sb"), both, percent).alias("link"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
                    small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` (the least id reachable over links
    100 * intersection >= percent * union), ``kept`` (whether that is its own id) and ``class_id`` (the least id
    with the same set)."""
    base = shipped(docs).select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text"))
    sig = materialize_table(base.mapInArrow(partial(_signature_rows, shingle=shingle, bands=bands, rows=rows),
                                            "did long, n long, f1 long, f2 long, bands array<long>"), "signatures")
    known = sig.where("n > 0 AND did IS NOT NULL")
    classes = known.groupBy("f1", "f2").agg(F.min("did").alias("class_id"), F.count_distinct("did").alias("copies"))
    member = known.select("did", "f1", "f2").join(classes, ["f1", "f2"]).select("did", "class_id").distinct()
    heads = known.join(classes, ["f1", "f2"]).where("did = class_id").select("did", "n", F.explode(F.array_distinct("bands")).alias("bucket")) \
        .distinct()
    count = heads.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialize_table(heads.join(count, "bucket"), "buckets")
    central = buckets.groupBy("did").agg(F.sum("c").alias("centre"))
    ranked = buckets.join(central, "did")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("centre", -F.col("did"), "n")).alias("h")) \
        .select("bucket", (-F.col("h.col2")).alias("hub"), F.col("h.n").alias("hub_n"))
    fit = _reachable("n", "hub_n", F.least("n", "hub_n"), percent)
    hubbed = materialize_table(buckets.join(hubs, "bucket"), "hubs")
    pairs = hubbed.where((F.col("did") != F.col("hub")) & fit).select(F.col("hub").alias("a"), F.col("did").alias("b")).distinct()
    wanted = buckets.select("did").distinct()
    sets = materialize_table(base.hint("merge").join(wanted, "did", "left_semi").mapInArrow(partial(_set_rows, shingle=shingle), "did long, s array<long>")
                             .dropDuplicates(["did"]), "sets")
    compared = materialize_table(_compared(pairs, sets, percent), "compared")
    links = compared.where("link").select("a", "b")
    component = connected_components(links)
    # members that are not in their hub's component yet
    of = component.select(F.col("node").alias("did"), F.col("component").alias("dc"))
    of_hub = component.select(F.col("node").alias("hub"), F.col("component").alias("hc"))
    with_hub = compared.select(F.col("a").alias("hub"), F.col("b").alias("did"), "both")
    placed = hubbed.join(of, "did", "left").join(of_hub, "hub", "left").join(with_hub, ["hub", "did"], "left") \
        .select("bucket", "did", "n", "c", "hub", "both", F.coalesce("dc", "did").alias("dc"), F.coalesce("hc", "hub").alias("hc"))
    placed = materialize_table(placed, "placed")
    apart = placed.where("dc != hc")
    if not apart.isEmpty():
        open_ = apart.groupBy("bucket").agg(F.count("*").alias("left"))
        rest = placed.join(open_.drop("left"), "bucket", "left_semi")
        large = rest.where(F.col("c") > small_bucket).select("did").distinct()
        grams = sets.join(large, "did", "left_semi").select("did", F.explode("s").alias("g"))
        common = grams.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").drop("m")
        shared = grams.join(common, "g").groupBy("did").agg(F.count("*").alias("shared"))
        rest = rest.join(shared, "did", "left").withColumn(
            "most", F.when(F.col("c") > small_bucket, F.coalesce("shared", F.lit(0))).otherwise(F.col("n")))
        # a set whose shared part is under percent of itself links with nothing, nor one whose shared part is too small for a
        # union with the smallest other set of its bucket
        least = rest.where(100 * F.col("most") >= percent * F.col("n")).groupBy("bucket").agg(F.min("n").alias("least"))
        alive = rest.join(least, "bucket").where((100 * F.col("most") >= percent * F.col("n"))
                                                 & (100 * F.col("most") >= percent * (F.col("n") + F.greatest("least", "most") - F.col("most"))))
        # inside the hub's set two members share at most what the one that has less of it has; outside, their other shared part
        alive = materialize_table(alive.withColumn("inside", F.coalesce("both", F.lit(0))).withColumn("outside", F.col("most") - F.col("inside"))
                                  .withColumn("inside", F.when(F.col("both").isNull(), F.col("most")).otherwise(F.col("inside"))), "alive")
        y = alive.where("dc != hc").select("bucket", F.col("did").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("inside").alias("ib"),
                                           F.col("outside").alias("ob"), F.col("dc").alias("cb"))
        x = alive.where("did != hub").select("bucket", F.col("did").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("inside").alias("ia"),
                                             F.col("outside").alias("oa"), F.col("dc").alias("ca"), (F.col("dc") != F.col("hc")).alias("too"))
        possible = _reachable("na", "nb", F.least(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), F.least("ia", "ib") + F.least("oa", "ob")), percent)
        # a pair is compared in the first bucket that its two members share
        codes = known.select("did", "bands").join(alive.select("did").distinct(), "did", "left_semi").dropDuplicates(["did"])
        x = x.join(codes.select(F.col("did").alias("a"), F.col("bands").alias("ka")), "a")
        y = y.join(codes.select(F.col("did").alias("b"), F.col("bands").alias("kb")), "b")
        here = F.array_position("ka", F.col("bucket")).cast("int") - 1
        earlier = F.exists(F.zip_with(F.slice("ka", F.lit(1), here), F.slice("kb", F.lit(1), here), lambda p, q: p == q), lambda e: e)
        more = x.join(y, "bucket").where((F.col("ca") != F.col("cb")) & possible & (~F.col("too") | (F.col("a") < F.col("b"))) & ~earlier) \
            .select("a", "b").distinct()
        late = materialize_table(_compared(more, sets, percent).where("link").select("a", "b"), "late_links")
        if not late.isEmpty():
            component = connected_components(links.unionByName(late))
    ids = member.join(component, member["class_id"] == component["node"], "left") \
        .select("did", "class_id", F.coalesce("component", "class_id").alias("component_id")) \
        .groupBy("did").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = sig.select("did", F.col("n").alias("n_shingles")).join(ids, "did", "left")
    alone = F.coalesce("component_id", "did")
    return out.select(F.col("did").alias(id_col), "n_shingles", alone.alias("component_id"),
                      F.coalesce(F.col("did") == alone, F.lit(True)).alias("kept"), F.coalesce("class_id", "did").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay (the least id of each component, rows without a set, rows without an id), with their own columns."""
    gone = near_duplicates(docs, id_col, text_col, **how).where(~F.col("kept")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
