"""Language ID: its counts equal plain ones, and the shared folder keeps only the tables that the result reads."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from tillwise import session
from tillwise.llm import language_id

ODD = ["", " ", "A", "éa\x00b\x00 c", "one, (two) ONE two\x1fthree\xa0four \x85", "日本語 日本", "12 -- 3a", "x\U0001F600y x"]


def _rows(rng):
    texts = ODD + [" ".join(rng.choice(["ab", "Abc", "abc,", "d", "12", "zé"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    return [(rng.choice(["en", "de", "日"]), t) for t in texts]


@pytest.mark.parametrize("limit", [1, 100, 1 << 20])
def test_counts_equal_plain_ones(monkeypatch, limit):
    for name in ("TABLE_ROWS", "TEXT_BYTES", "GRAM_BYTES"):
        monkeypatch.setattr(language_id, name, limit)
    rows = _rows(random.Random(4))
    batch = pa.RecordBatch.from_pylist([{"lang": lang, "text": t} for lang, t in rows])
    words, got = Counter(), Counter()
    for lang, t in rows:
        words.update((lang, w) for x in t.split() if (w := language_id.normal(x)) is not None)
    counted = list(language_id._count_words(iter([batch.slice(0, 7), batch.slice(7)])))
    for b in counted:
        for r in b.to_pylist():
            got[r["lang"], r["word"]] += r["n"]
    assert got == words
    grams, got = Counter(), Counter()
    for (lang, w), n in words.items():
        for size in range(1, language_id.LONGEST + 1):
            for g in language_id.grams(w, size):
                grams[lang, g] += n
    for b in language_id._count_grams(iter(counted)):
        for r in b.to_pylist():
            got[r["lang"], r["word"]] += r["n"]
    assert got == grams


@pytest.mark.parametrize("cells", [1, 2_000_000])
def test_head_sums_equal_plain_ones(monkeypatch, cells):
    monkeypatch.setattr(language_id, "SUM_CELLS", cells)
    monkeypatch.setattr(language_id, "TEXT_BYTES", 200)
    vecs = {"ab": [(0, -1.5), (1, -0.25), (-1, 1.0)], "abc": [(1, -2.0), (-1, 1.0)]}
    texts = [t for _, t in _rows(random.Random(6))] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["did", "text"])
    got = [r for b in language_id._head_sums(iter([batch]), language_id.Head(2, list(vecs.items()))) for r in b.to_pylist()]
    assert [r["did"] for r in got] == list(range(len(texts)))
    for r, t in zip(got, texts, strict=True):
        words = [w for x in (t or "").split() if (w := language_id.normal(x)) is not None]
        sums = [0.0] * 3
        for place, d in (c for w in words for c in vecs.get(w, [])):
            sums[place] += d
        assert r["sums"] == sums
        assert {x["word"]: x["c"] for x in r["tail"]} == Counter(w for w in words if w not in vecs)


def test_only_tables_in_use_stay(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefg") * rng.randrange(1, 9) for _ in range(30)), ("en", "de")[i % 2]) for i in range(60)]
    before = len(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    out = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), head_words=3)
    paths = [p.removeprefix("file:") for p in session._WRITTEN[spark.sparkContext.applicationId][before:]]
    assert len(paths) == 4  # sums, the tail's keys and vectors, frequent keys
    assert all(os.path.isdir(p) for p in paths) and out.count() == 60
