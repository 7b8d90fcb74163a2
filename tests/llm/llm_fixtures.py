"""A small corpus with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re

import pytest

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, key long, bucket long, component string"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """(doc_id, text, lang, source, n_chars) and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    passage = prose(rng, 60, 10_000)
    base = prose(rng, 120, 10_000)
    texts = [None, "", "  \t\n ", "one", "two words", "a b c d", "A B C D", "a b c d e", prose(rng, 34), prose(rng, 35)]
    texts += [prose(rng, rng.randrange(20, 200), 10_000) for _ in range(12)]
    texts += [prose(rng, 30, 10_000) + " " + passage + "\n" + prose(rng, 30, 10_000) for _ in range(9)]  # a shared passage
    texts += [base] * 4 + [base.upper()]
    for k in range(14):  # near copies, farther and farther
        w = base.split()
        for i in range(k // 2 + 1):
            w[(k * 17 + i * 29) % len(w)] = f"x{k}{i}"
        texts.append(" ".join(w))
    texts.append(prose(rng, 50, 10_000) + " " + " ".join(["again and again"] * 40))  # repeats itself
    texts.append(prose(rng, 20_000, 3_000))  # very long
    texts.append("\x0b".join(["é", "ÉÉ", "日本語", "naïve"] * 12))
    rows = [(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], len(t or ""), "x", 1, 2, "y") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[31]]  # repeated rows
    rows += [(None, rows[13][1], None, None, 0, "x", 1, 2, "y"), (None, None, "en", "s0", 0, "x", 1, 2, "y")]
    return rows


def substring_dedup(rows, length=35):
    """(id, words, removed, hash) of each row."""
    seen = {}
    lists = [words(t) for _, t in rows]
    for w in lists:
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if seen[tuple(w[p:p + length])] > 1:
                gone[p:p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, size=5):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_duplicates(rows, percent=85):
    """{id: (set size, component)}, for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = words(t)
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    seen = {}
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])] = seen.get(tuple(w[i:i + 5]), 0) + 1
    inside = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
