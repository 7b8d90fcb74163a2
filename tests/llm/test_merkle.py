"""The Merkle manifest against a tree built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF_SMALL
from tillwise.llm.merkle import CRC32, FIELDS, manifest, merkle_report

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, rank long, digest string, steps int, keep_0 int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    steps = []
    for nodes in tree[:-1]:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
        steps.append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        i //= 3
    return steps


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            steps = path(trees[s], i) + path(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for before, after in steps:
                folded = h(before + folded + after)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h("".join(b + a for b, a in steps)), folded, folded == top[-1][0]))
    return out


def report(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(5)
    return [tuple(r) for r in merkle_report(docs).collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


def odd_rows():
    rows = [(i, "hot", "en", i, f"text {i}\nline") for i in range(100)]  # two buckets of levels
    rows += [(i, f"s{i % 4}", None, None, None if i % 3 else "") for i in range(100, 130)]
    rows += [(7, None, "de", 3, "null source"), (None, None, None, None, None), (None, "hot", "en", 1, "a\nb"), (200, "lone", "en", 1, "é\n" * 9)]
    return rows + [(5, "hot", "en", 5, "text 5\nline")] * 40 + [(300, "Z", "fr", 10 ** 6, "w " * 500_000 + "\n")]


def test_tree_of_odd_rows(spark):
    same(report(spark, odd_rows()), brute(odd_rows()))


def test_every_shape_of_a_tree(spark):
    """Groups of many sizes, and enough of them for a tree of groups of more than one bucket."""
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, *[1] * 25]
    same(report(spark, rows := [(i, f"source {k:02d}", "en", i, "a\nb") for k, n in enumerate(sizes) for i in range(n)]), brute(rows))


@pytest.mark.parametrize("n", [1, 28])
def test_one_group(spark, n):
    rows = [(i, "s", "en", i, "a\nb") for i in range(n)]
    same(report(spark, rows), brute(rows))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    same([tuple(r) for r in merkle_report(docs).collect()], brute([tuple(r) for r in docs.select(*FIELDS).collect()]))


def test_ranks_and_proofs_of_a_group(spark):
    out = manifest(spark.createDataFrame(odd_rows(), "doc_id long, source string, lang string, n_chars long, text string"))
    ranks = out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("top")).collect()
    assert all(r["n"] == r["d"] == r["top"] + 1 for r in ranks)


def test_empty_table(spark):
    assert merkle_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crc32_in_sql():
    import duckdb
    got = duckdb.sql(f"SELECT x, {CRC32.format('x')} AS c FROM (VALUES (0), (17), (-7), (1234567890123)) t(x)").fetchall()
    assert all(c == zlib.crc32(str(x).encode()) for x, c in got)
