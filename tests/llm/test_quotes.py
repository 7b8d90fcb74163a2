"""Decontamination: quotes cut at arbitrary places, replaced words, short items."""

import random

import llm_fixtures as fixtures
from tillwise.llm.decontaminate import contamination


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_quotes_and_short_items(spark):
    rng = random.Random(13)
    items = {i: " ".join(_words(rng, 200))[:233].strip() for i in range(8)}  # about the median length
    items |= {10 + i: " ".join(_words(rng, 100))[:95].strip() for i in range(8)}
    items |= {20: "the capital of Peru, is it Lima?", 21: "42 plus 17", 22: "?!", 23: "Straße É"}
    docs, want = [], {}

    def add(part, found):
        i = len(docs)
        docs.append((i, f"{fixtures.prose(rng, 60, 3000)} {part} {fixtures.prose(rng, 60, 3000)}"))
        want[i] = found

    for i in range(8):
        long, mid = items[i], items[10 + i]
        for lo in (0, 11, 30, 52):  # 77 % of the item
            add(long[lo:lo + 180], {i})
        add(long[:90], set())  # 39 %
        add(long[60:100], set())
        add(mid[:int(0.92 * len(mid))], {10 + i})
        w = mid.split()
        for k in rng.sample(range(1, len(w) - 1), 2):
            w[k] = "zzzzz"
        runs = [len(r.strip()) for r in " ".join(w).split("zzzzz")]
        add(" ".join(w), {10 + i} if sum(r for r in runs if r >= 12) >= 62 and max(runs) >= 30 else None)
    add("So: the CAPITAL of Peru; is it Lima", {20})
    add("the capital of Peru is it Limax", set())
    add("xthe capital of Peru is it Lima", set())
    add("What is 42 plus 17?", {21})
    add("142 plus 17", set())
    add("?!", set())
    add("straße é", {23})
    docs.append((1000, "42 plus 17"))  # the whole document, and one that ends where the next begins
    docs.append((1001, "42 plus"))
    docs.append((1002, "17 and more"))
    want |= {1000: {21}, 1001: set(), 1002: set()}
    assert sum(w is not None and len(w) for w in want.values()) > 40
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in contamination(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), bench).collect()}
    assert {i: g for i, g in got.items() if want[i] is not None} == {i: w for i, w in want.items() if w is not None}
