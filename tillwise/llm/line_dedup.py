"""Line dedup: segment-partition edit join, in DataFrame operations only.

Lines (split at ``\\n``, trimmed of blanks, tabs and carriage returns) that are equal, or within one
edit if they have ``min_chars`` characters or more, are one class, links taken transitively. Of each
class, the first occurrence (by document id, then line number) is kept; the other occurrences go.

*Segments.* A line of length L is cut into threshold + 1 = 2 segments; an edit spoils one of them at
most. The index holds hash(L, which segment, its text). Lines of length L meet over equal entries; a
line of length L + 1 probes L's entries with the substrings that can correspond: its own front and its own
end of the segments' lengths (the multi-match-aware selection for one edit).

*Hot segments.* Where more than ``bucket`` lines share an entry, all pairs would grow with its square.
Those lines are entered again, exactly: the edit lies in one window of 8 characters, so two linked lines
agree on the text before and behind some window; entries are hashes of a line without one window (and,
as a probe of lines one shorter, without a window of 9). Entries that are still hot are divided again
with windows of one character. There, lines of one entry differ in that character only: each pair is a
link of the result, none is only a candidate.

*Verification.* Candidates must agree before and behind one of 16 parts (the same argument once more); the
texts of that part must then pass a banded bit-parallel edit distance: three diagonals as three bits,
one step for each character, as an ``aggregate`` expression.

Scale. Occurrences are reduced to distinct lines by 64-bit hashes (map-side combined): a line that a
third of the documents hold is one row. Only hashes are shuffled up to the verification; the texts of
lines with a shared entry come in by one join. Two different lines with equal 64-bit hashes would be
taken as one (probability n * n / 2**65). Components: :mod:`tillwise.llm.components`.

Defined cases. Null or empty text, blank lines: no lines; they are never removed. Null id: sorts first. Rows with equal id are told apart
by a hash of the text; rows equal in both are treated alike. Empty table: empty result. Other columns
are kept by :func:`dedup_lines` and ignored by :func:`line_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table
from tillwise.llm.components import connected_components

MIN_CHARS, BUCKET, COARSE, PARTS = 20, 64, 8, 16
_NO_ID = -(1 << 63)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, rid, no, line): non-blank lines, trimmed."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.col(text_col).alias("text"))
    return base.select("did", F.xxhash64("text").alias("rid"), F.posexplode(split_lines(F.col("text"))).alias("no", "line")).where("line != ''")


def split_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def bounded_distance(a: Column, b: Column) -> Column:
    """Edits between two texts if that is 0 or 1, else 2 or more: Hyyro's banded bit-parallel recurrence for a band of three
    diagonals. ``a`` must not be shorter than ``b``. Bit i of a word stands for row j - 1 + i of column j."""
    return _let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"), F.char_length(a).alias("m"), F.char_length(b).alias("n")),
                lambda s: _banded(s["p"], s["q"], s["m"], s["n"]))


def _banded(p: Column, q: Column, m: Column, n: Column) -> Column:
    zero = F.lit(0).cast("int")

    def step(s: Column, j0: Column) -> Column:
        j = j0 + 1
        c = F.get(q, j0)
        bit = lambda i: F.when(F.get(p, j0 - 1 + i) == c, 1 << i).otherwise(0)
        eq = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
        vp, vn = F.shiftright(s["vp"], 1).bitwiseOR(F.lit(4)), F.shiftright(s["vn"], 1)

        def rest(t: Column) -> Column:
            eq, vp, vn = t["eq"], t["vp"], t["vn"]
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseAND(F.lit(7)).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn)

            def last(u: Column) -> Column:
                d0, vp, vn = u["d0"], u["vp"], u["vn"]
                hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(7)))
                hn = d0.bitwiseAND(vp)
                x, y = F.shiftleft(hp, 1).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(7)), F.shiftleft(hn, 1).bitwiseAND(F.lit(7))
                row = m - j + 1  # bit of the last row
                at = lambda w: F.shiftright(w, row.cast("int")).bitwiseAND(F.lit(1)) if False else F.when(row == 1, F.shiftright(w, 1).bitwiseAND(F.lit(1))).when(row == 0, w.bitwiseAND(F.lit(1))).otherwise(0)
                score = F.when(row >= 2, 1 - F.shiftright(d0, 2)).when(row < 0, F.lit(2)).otherwise(at(hp) - at(hn))
                return F.struct(y.bitwiseOR(d0.bitwiseOR(x).bitwiseXOR(F.lit(7))).alias("vp"), d0.bitwiseAND(x).alias("vn"),
                                (u["score"] + score).cast("int").alias("score"))

            return _let(F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), t["score"].alias("score")), last)

        return _let(F.struct(eq.alias("eq"), vp.alias("vp"), vn.alias("vn"), s["score"].alias("score")), rest)

    start = F.struct(F.lit(4).alias("vp"), zero.alias("vn"), F.least(m, F.lit(1)).alias("score"))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.abs(m - n) > 1, F.lit(2)).when(n == 0, m).otherwise(F.aggregate(steps, start, step)["score"])


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entry(size: Column, kind: Column, *text: Column) -> Column:
    return F.xxhash64(size, kind, *text)


def _halves(line: Column, size: Column) -> list[Column]:
    """Two entries of the line's own length, then two probes of the length below."""
    out = []
    for n in (size, size - 1):
        cut = F.floor(n / 2).cast("int")
        out += [_entry(n, F.lit(-1), F.left(line, cut)), _entry(n, F.lit(-2), F.right(line, n - cut))]
    return out


def _windows(line: Column, size: Column, width: int) -> Column:
    """For each window: the entry without it, and the probe of the length below without one character more."""
    def pair(p: Column) -> Column:
        own, below = F.greatest(size - p - width, F.lit(0)), F.greatest(size - 1 - p - width, F.lit(0))
        return F.array(
            F.struct(_entry(size, p * 64 + width, F.left(line, p), F.right(line, own)).alias("entry"), F.lit(False).alias("probe")),
            F.struct(_entry(size - 1, p * 64 + width, F.left(line, p), F.right(line, below)).alias("entry"), F.lit(True).alias("probe")))

    return F.flatten(F.transform(F.sequence(F.lit(0), size - 1, F.lit(width)), pair))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (h, entry, probe) whose entry another row has too, with the number n of rows; an entry needs an index row."""
    counts = rows.groupBy("entry").agg(F.count("*").alias("n"), F.min("probe").alias("only")).where("n > 1 AND NOT only").drop("only")
    return rows.join(counts, "entry")


def _pairs(shared: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): two index rows, or an index row a and a probe b, of one entry."""
    x = shared.where("NOT probe").select("entry", F.col("h").alias("a"))
    y = shared.select("entry", F.col("h").alias("b"), "probe")
    return x.join(y, "entry").where("(probe AND a != b) OR (NOT probe AND a < b)").select("a", "b")


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of candidates (a, b, la, lb) whose lines are within one edit."""
    m, n = F.char_length("la"), F.char_length("lb")

    def linked(s: Column) -> Column:
        x, y, n = s["x"], s["y"], s["n"]
        # one edit spoils one of PARTS parts: what is before it and behind it is equal, and adds no edits
        c = [F.floor(n * i / PARTS).cast("int") for i in range(PARTS + 1)]
        spoiled = F.coalesce(*(F.when((F.left(x, c[i]) == F.left(y, c[i])) & (F.right(x, n - c[i + 1]) == F.right(y, n - c[i + 1])),
                                      F.struct(c[i].alias("at"), (n - c[i + 1]).alias("behind"))) for i in range(PARTS)))

        def middle(t: Column, p: Column) -> Column:
            return F.substring(t, p["at"] + 1, F.char_length(t) - p["at"] - p["behind"])

        return _let(spoiled, lambda p: p.isNotNull() & (bounded_distance(middle(x, p), middle(y, p)) <= 1))

    # each value is found once a pair: as columns, the optimizer would put their expressions wherever they are named
    longer = F.struct(F.when(m >= n, F.col("la")).otherwise(F.col("lb")).alias("x"), F.when(m >= n, F.col("lb")).otherwise(F.col("la")).alias("y"),
                      F.least(m, n).alias("n"))
    return pairs.where(F.abs(m - n) <= 1).where(_let(longer, linked)).select("a", "b")


def line_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lines, links). lines: h (hash of the line), first (did, rid, no) and copies. links: pairs (a, b) of hashes of
    different lines within one edit."""
    size = F.char_length("line")
    near = size >= min_chars
    cols = [F.when(near, c) for c in _halves(F.col("line"), size)]
    rows = _lines(docs, id_col, text_col).select("did", "rid", "no", F.xxhash64("line").alias("h"),
                                                 *(c.alias(f"e{i}") for i, c in enumerate(cols)))
    lines = materialize_table(rows.groupBy("h").agg(
        F.min(F.struct("did", "rid", "no")).alias("first"), F.count("*").alias("copies"), *(F.min(f"e{i}").alias(f"e{i}") for i in range(4))), "lines")
    entries = lines.where("e0 IS NOT NULL").select("h", F.inline(F.array(*(
        F.struct(F.col(f"e{i}").alias("entry"), F.lit(i > 1).alias("probe")) for i in range(4)))))
    shared = materialize_table(_shared(entries), "shared")
    wanted = shared.select("h").distinct()
    texts = materialize_table(
        _lines(docs, id_col, text_col).withColumn("h", F.xxhash64("line"))
        .join(lines.join(wanted, "h", "left_semi").select("h", F.col("first.did").alias("did"), F.col("first.rid").alias("rid"), F.col("first.no").alias("no")),
              ["h", "did", "rid", "no"]).select("h", "line").dropDuplicates(["h"]), "line_texts")
    candidates = _pairs(shared.where(F.col("n") <= bucket))
    hot = shared.where(F.col("n") > bucket)
    for width in (COARSE, 1):
        if hot.isEmpty():
            break
        again = texts.join(hot.select("h").distinct(), "h", "left_semi")
        hot = materialize_table(_shared(again.select("h", F.inline(_windows(F.col("line"), F.char_length("line"), width)))), f"windows{width}")
        candidates = candidates.unionByName(_pairs(hot if width == 1 else hot.where(F.col("n") <= bucket)))
        hot = hot.where(F.col("n") > bucket)
    a, b = texts.select(F.col("h").alias("a"), F.col("line").alias("la")), texts.select(F.col("h").alias("b"), F.col("line").alias("lb"))
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(a, "a").join(b, "b")
    links = _verified(pairs)
    return lines.select("h", "first", "copies"), materialize_table(links, "line_links")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per distinct line: h, first, copies, links (to different lines) and kept (first occurrence of its class)."""
    lines, links = line_links(docs, id_col, text_col, **how)
    component = connected_components(links)
    degree = links.select(F.col("a").alias("h")).union(links.select("b")).groupBy("h").agg(F.count("*").alias("links"))
    known = lines.join(component.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    heads = known.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("head"))
    return known.join(heads, "component").join(degree, "h", "left") \
        .select("h", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), (F.col("first") == F.col("head")).alias("kept"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its id, n_lines (not blank), n_kept, n_removed, n_first (lines whose exact text starts
    here) and n_links (links of those lines)."""
    classes = line_classes(docs, id_col, text_col, **how)
    per = classes.groupBy(F.col("first.did").alias("did"), F.col("first.rid").alias("rid")).agg(
        F.count_if("kept").alias("n_kept"), F.count("*").alias("n_first"), F.sum("links").alias("n_links"))
    n = F.coalesce(F.size(F.filter(split_lines(F.col(text_col)), lambda x: x != "")), F.lit(0)).cast("long")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text_col).alias("rid"),
                       F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"))
    kept = F.coalesce("n_kept", F.lit(0))
    return base.join(per, ["did", "rid"], "left").select(
        F.when(F.col("did") != _NO_ID, F.col("did")).alias(id_col), "n_lines", kept.alias("n_kept"), (F.col("n_lines") - kept).alias("n_removed"),
        F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with the repeated lines taken out of the text; blank lines and all columns stay."""
    classes = line_classes(docs, id_col, text_col, **how).where("kept")
    per = classes.groupBy(F.col("first.did").alias("__did"), F.col("first.rid").alias("__rid")).agg(F.collect_list("first.no").alias("__nos"))
    out = docs.withColumn("__did", F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))).withColumn("__rid", F.xxhash64(text_col)) \
        .join(per, ["__did", "__rid"], "left")
    nos = F.coalesce("__nos", F.array().cast("array<int>"))
    text = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: (F.btrim(x, F.lit(" \t\r")) == "") | F.array_contains(nos, i)), "\n")
    return out.withColumn(text_col, text).select(*docs.columns)
