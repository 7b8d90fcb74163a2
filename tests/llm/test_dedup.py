"""Substring dedup, MinHash near-dedup and line dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_fixtures as fixtures
from llm_fixtures import docs, empty, prose  # noqa: F401
from tillwise.llm.components import connected_components
from tillwise.llm.line_dedup import PARTS, _verified, bounded_distance, dedup_lines, line_classes, line_links, line_report
from tillwise.llm.minhash import drop_near_duplicates, near_duplicates
from tillwise.llm.substring_dedup import ANCHOR, _by_document, _frequent_runs, _runs, dedup_substrings
from tillwise.llm.words import Words, signed


@pytest.mark.parametrize("group_limit", [1, 2000])
def test_substrings(spark, docs, group_limit):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = dedup_substrings(docs, group_limit=group_limit).collect()
    want = sorted(fixtures.substring_dedup(rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 500
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert len(fixtures.words(r.kept_text)) == r.n_words - r.n_removed


def test_many_equal_rows(spark):
    """Ten thousand copies of a row without an id, and of a text with ids of their own, cost a digest each."""
    rng = random.Random(8)
    long, other = prose(rng, 300, 9000), prose(rng, 200, 9000)
    quote = " ".join(long.split()[100:150])
    rows = [(None, long)] * 10_000 + [(i, other) for i in range(5_000)] + [(10_000, "short text")] * 50 + [(20_000, f"{prose(rng, 40, 9000)} {quote} {prose(rng, 40, 9000)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = dedup_substrings(docs)
    empty = hashlib.sha256(b"").hexdigest()
    got = {(r["doc_id"] if r["doc_id"] is None or r["doc_id"] >= 10_000 else 0, r["n_words"], r["n_removed"], r["kept_sha256"] == empty, r["count"])
           for r in out.withColumn("doc_id", F.when(F.col("doc_id") < 10_000, 0).otherwise(F.col("doc_id"))).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()}
    assert got == {(None, 300, 300, True, 10_000), (0, 200, 200, True, 5_000), (10_000, 2, 0, False, 50), (20_000, 130, 50, False, 1)}
    whole = out.where("doc_id IS NULL").select("kept_text", "removed").distinct().collect()
    assert [(r["kept_text"], [tuple(x) for x in r["removed"]]) for r in whole] == [("", [(0, 300)])]


def test_equal_frequent_runs_are_one_row():
    """Copies that differ by a word send the runs they share once a chunk, with their places."""
    rng = random.Random(2)
    base = prose(rng, 300, 9000).split()
    texts = [" ".join(base[:5 * k] + [f"x{k}"] + base[5 * k + 1:]) for k in range(50)]
    data = [t.encode() for t in texts]
    _, _, n, key = _runs(Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])), 35, ANCHOR)
    ids = pa.array(range(50), pa.int64())
    heavy = pa.array([signed(np.unique(key)).tolist()] * 50, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts), heavy], ["rid", "did", "text", "heavy"])
    got = [r for b in _frequent_runs(iter([batch]), 35, ANCHOR) for r in b.to_pylist()]
    places = [(x["rid"], x["start"], r["n"]) for r in got for x in r["places"]]
    assert len(places) == len(set(places)) == len(n) and sum(x[2] for x in places) == 50 * (300 - 34)
    assert all(len(r["windows"]) == r["n"] for r in got) and len({(r["r1"], r["r2"]) for r in got}) == len(got)
    for r in got:
        assert len({tuple(texts[x["rid"]].split()[x["start"]:x["start"] + r["n"] + 34]) for x in r["places"]}) == 1
    assert len(got) < len(n) / 2


def test_marked_runs_are_not_unfolded(spark):
    """Places of a frequent passage reach their documents as one row a document, not one an occurrence."""
    rng = random.Random(6)
    base = prose(rng, 400, 9000).split()
    rows = [(k, " ".join(base[:4 * k] + [f"x{k}"] + base[4 * k + 1:] + prose(rng, 20, 9000).split())) for k in range(90)]
    out = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), group_limit=5)
    plan = out._jdf.queryExecution().toString()
    assert "inline(places" not in plan and "_by_document(" in plan
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == sorted(fixtures.substring_dedup(rows))
    kind = "array<struct<places:array<struct<rid:bigint,did:bigint,start:int>>,mask:bigint>>"
    chunks = spark.createDataFrame([([([(1, 5, 9), (2, 6, 0), (1, 5, 0)], 3), ([(2, 6, 40)], 1)],), ([([(3, 7, 2)], 7)],)], f"runs {kind}").coalesce(1)
    got = [r for b in _by_document(iter(chunks.toArrow().to_batches())) for r in b.to_pylist()]
    assert [(r["rid"], [(m["did"], m["start"], m["mask"]) for m in r["marks"]]) for r in got] == [
        (1, [(5, 0, 3), (5, 9, 3)]), (2, [(6, 0, 3), (6, 40, 1)]), (3, [(7, 2, 7)])]


def test_substrings_empty(empty):
    assert dedup_substrings(empty).collect() == []


def test_near_duplicates(spark, docs):
    one = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in one.select("doc_id", "text").collect()]
    want = fixtures.near_duplicates(rows)
    got = near_duplicates(docs)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.where("doc_id IS NOT NULL").distinct().collect()) \
        == sorted((i, n, c, c == i) for i, (n, c) in want.items())
    assert got.count() == docs.count()
    assert all(r.kept and r.component_id is None for r in got.where("doc_id IS NULL").collect())
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if c == i} | {None}


def test_near_duplicates_large_bucket(spark):
    """Near copies at all distances in buckets beyond the small ones: the exact way for the rest."""
    rng = random.Random(11)
    base = fixtures.prose(rng, 100, 50_000).split()
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(k % 9):
            i = rng.randrange(len(w))
            w[i:i + 1] = [] if k % 4 == 3 else [f"y{rng.randrange(10 ** 6)}"]
        rows.append((k, " ".join(w)))
        if k % 10 == 0:  # a copy of a far copy
            rows.append((1000 + k, " ".join(w[1:])))
    want = fixtures.near_duplicates(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small_bucket=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 3


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_of_a_family(spark, small):
    """Near copies that lost different parts of an original, of which some gained a passage together: links between members that
    are not linked to the original are found, with the bounds for large buckets and without."""
    rng = random.Random(3)
    base, passages = [f"b{i}" for i in range(300)], [[f"e{k}_{i}" for i in range(30)] for k in range(12)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 6, 7, 8])):
            w[rng.randrange(300)] = f"x{i}_{rng.randrange(10**6)}"
        if rng.random() < 0.5:
            at = rng.choice([20, 120, 220])
            w[at:at + rng.choice([0, 30])] = rng.choice(passages)
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    least = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80, bands=36, rows=5, small_bucket=small).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(enumerate(least))


def test_near_duplicates_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def _line_rows():
    rng = random.Random(7)
    letters = "abcdefgh é"
    lines = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 60))).strip() or "x" for _ in range(60)]
    for line in list(lines):
        for _ in range(3):
            w = list(line)
            for _ in range(rng.choice((1, 1, 1, 2))):
                i = rng.randrange(len(w))
                w[i:i + 1] = rng.choice(([], [rng.choice(letters)], [w[i], rng.choice(letters)]))
            lines.append("".join(w).strip() or "y")
    hot = "the very same beginning of a line, then a number"
    lines += [f"{hot} {i:04d} and its end" for i in range(150)] + [f"{hot[:20]}{i}{hot[20:]} and its end" for i in range(40)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5:i * 5 + 5]) + ("\n\n  \n" if i % 3 else "")) for i in range(len(lines) // 5 + 1)]
    rows += [(90, rows[2][1]), (91, None), (92, ""), (93, " \n\t"), (None, rows[3][1] + "\nlast line of all"), (94, "x" * 3_000), (95, "x" * 3_001)]
    return rows


@pytest.mark.parametrize("bucket", [3, 64])
def test_lines(spark, bucket):
    rows = _line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).repartition(4)
    occurrences = sorted(((-(1 << 63) if d is None else d), no, line.strip(" \t\r")) for d, t in rows for no, line in enumerate((t or "").split("\n")) if line.strip(" \t\r"))
    first = {}
    for d, no, line in occurrences:
        first.setdefault(line, (d, no))
    names = sorted(first)
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = set()
    by_size = {}
    for x in names:
        by_size.setdefault(len(x), []).append(x)
    for x in names:
        for n in (len(x), len(x) + 1):
            for y in by_size.get(n, []):
                if x != y and (y, x) not in near and min(len(x), len(y)) >= 20 and (len(x) < 1000 and edit_one(x, y) or x + "x" == y):
                    near.add((x, y))
    for x, y in near:
        a, b = find(x), find(y)
        if a != b:
            parent[b] = a
    head = {}
    for x in names:
        head[find(x)] = min(head.get(find(x), first[x]), first[x])
    _, links = line_links(df, bucket=bucket)
    assert links.count() == len(near) > 200
    classes = line_classes(df, bucket=bucket)
    got = {(r.did, r.no): (r.copies, r.kept) for r in classes.select("first.did", "first.no", "copies", "kept").collect()}
    copies = {}
    for _, _, line in occurrences:
        copies[line] = copies.get(line, 0) + 1
    assert got == {first[x]: (copies[x], first[x] == head[find(x)]) for x in names}
    report = {r.doc_id: r for r in line_report(df, bucket=bucket).collect()}
    kept = set(head.values())
    for d, t in rows:
        k = -(1 << 63) if d is None else d
        n = sum(1 for x in (t or "").split("\n") if x.strip(" \t\r"))
        assert (report[d].n_lines, report[d].n_kept, report[d].n_removed) == (n, sum(1 for a, _ in kept if a == k), n - sum(1 for a, _ in kept if a == k))
    if bucket == 3:
        cut = dedup_lines(df, bucket=bucket)
        assert cut.columns == df.columns
        for r in cut.collect():
            k = -(1 << 63) if r.doc_id is None else r.doc_id
            t = dict(rows)[r.doc_id]
            want = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(" \t\r") or (k, i) in kept)
            assert r.text == want


def edit_one(x, y):
    if len(x) > len(y):
        x, y = y, x
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + 1:] == y[i + 1:] if len(x) == len(y) else x[i:] == y[i + 1:]


def test_lines_empty(empty):
    assert line_report(empty).collect() == []


def test_bounded_distance(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randrange(2)] = rng.choice(([], ["a"], ["b", "é"]))
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        pairs.append((a, b, min(fixtures.edit_distance(a, b), 2)))
    got = spark.createDataFrame(pairs, "a string, b string, d int").select("a", "b", "d", F.least(bounded_distance(F.col("a"), F.col("b")), F.lit(2)).alias("g"))
    assert got.where("d != g").collect() == []


def test_lines_are_compared_once_a_pair(spark):
    """The part that an edit spoils is looked for once a pair, not wherever its place is named."""
    line = "an old mill by the river grinds corn for a village"
    pairs = [(1, 2, line, line.replace("mill", "mall")), (3, 4, line, line + "s"), (5, 6, line[1:], line), (7, 8, line, line.replace("l", "m")), (9, 10, line, line + "ss")]
    got = _verified(spark.createDataFrame(pairs, "a long, b long, la string, lb string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4), (5, 6)]
    plan = _verified(spark.range(4).selectExpr("id AS a", "id AS b", "CAST(id AS STRING) AS la", "CAST(id AS STRING) AS lb"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(") <= 4 * PARTS + 4
