"""The pipeline's near-dedup stage against brute force, with pairs planted between 0.80 and 0.85."""

import random

import corpus_pipeline
import llm_fixtures as fixtures


def test_stage_drops_pairs_from_080(spark):
    rng = random.Random(21)
    rows, near = [], 0
    for k in range(40):
        base = fixtures.prose(rng, 104, 50_000).split()
        rows.append((2 * k, " ".join(base)))
        for i in range(2 + k % 4):  # 100 shingles, 5 of them spoiled by each word
            base[10 + 20 * i] = f"y{k}_{i}"
        rows.append((2 * k + 1, " ".join(base)))
        a, b = (fixtures.shingles(t) for _, t in rows[-2:])
        near += 80 <= 100 * len(a & b) / len(a | b) < 85
    assert near == 10
    want = fixtures.near_duplicates(rows, percent=80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert {r.doc_id for r in left} == {i for i, (_, c) in want.items() if c == i}
    assert len(left) == sum(c == i for i, (_, c) in fixtures.near_duplicates(rows).items()) - near
