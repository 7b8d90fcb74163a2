"""Language ID, classifier, decontamination, token output, URL filter, rules, mixing."""

import io
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_fixtures as fixtures
from llm_fixtures import SF_MID, SF_SMALL, docs, empty  # noqa: F401

from tillwise.llm import language_id, mixing, quality_classifier, quality_rules, queries, stats, url_filter
from tillwise.llm.decontaminate import build_index, contamination, drop_contaminated, matches
from tillwise.llm.token_output import Encoder, Reader, Writer, filesystem, read_tokens, tokenizer_path, write_tokens

TEXTS = [r[1] for r in fixtures.corpus()] + ["a\nb\na\n\na b\na", "#*$%&|<>", "x y z " * 30, "Ünï cödé ÀÉ\n\nÜnï cödé ÀÉ"]


def test_counts():
    rows = stats.count_rows(pa.array(TEXTS))
    for t, r in zip(TEXTS, rows, strict=True):
        assert tuple(r[:5]) == fixtures.counts(t), t
        assert r[6] == len(set(fixtures.words(t)))


def test_rules_query(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_verdicts(docs, labels).collect()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == len(text)
    right = 0
    for r in rows:
        c = fixtures.counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
        assert r.kept == (not r.base_failed and r.rule is None)
        right += r.doc_id in truth and r.kept == (truth[r.doc_id] == 1)
    assert right / len(truth) > 0.9


def test_rules_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(stats.FEATURES)))
    bad = ((x[:, 2] > 0.8) & (x[:, 5] <= 0.5)) | (x[:, 9] > 0.95)
    rules = quality_rules.learn_rules(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._covered(r, x)
    assert (hit == bad).mean() > 0.98
    assert "symbol_share >" in quality_rules.describe(rules)


def test_rules_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = sorted(str(r) for r in docs.collect() if (c := fixtures.counts(r.text))[0] >= 10 and 100 * c[4] <= 20 * c[0])
    assert sorted(str(r) for r in kept.collect()) == want
    assert quality_rules.quality_verdicts(empty, labels).collect() == []


def test_classifier(spark, docs, empty):
    d, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.quality_scores(d, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == d.count()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    good = [r.score for r in held if truth[r.doc_id]]
    bad = [r.score for r in held if not truth[r.doc_id]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 3 and auc > 0.95
    # labels of the held-out fold have no part in the scores
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_classifier.quality_scores(d, other).collect()
    assert max(abs(a.score - b.score) for a, b in zip(sorted(rows), sorted(again), strict=True)) < 1e-6
    none = quality_classifier.quality_scores(docs, labels.where("doc_id < 0"))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).collect() == []


def test_isotonic():
    w, g = np.array([2, 0, 2, 4, 1, 3.0]), np.array([1, 0, 0, 3, 0, 3.0])
    blocks = quality_classifier.isotonic(w, g)
    shares = [b[1] / b[0] for b in blocks]
    assert shares == sorted(shares) and sum(b[0] for b in blocks) == w.sum() and sum(b[1] for b in blocks) == g.sum()


def _brute_language(model, text):
    scores = [s for t in (text or "").split() if (s := model.word_scores(t)) is not None]
    if not scores or not model.languages:
        return "und"
    return model.languages[int(np.argmin(np.mean(scores, axis=0)))]


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = language_id.identify_languages(d).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in d.collect()}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    # the model's counts against a plain count, the predictions against a plain mean
    model = language_id.fit_language_model(d.where(~quality_classifier.held_out(F.col("doc_id"))))
    count = {}
    for i, (lang, text) in truth.items():
        if zlib.crc32(str(i).encode()) % 5:
            for t in text.split():
                w = language_id.normal(t)
                if w:
                    count[lang, w] = count.get((lang, w), 0) + 1
    total = {lang: sum(n for (x, _), n in count.items() if x == lang) for lang in model.languages}
    for c, lang in enumerate(model.languages):
        for w in ("the", "de", "la", "und"):
            if count.get((lang, w), 0) > 50:  # surely among the words kept
                assert model.words[w][c] == pytest.approx(-np.log10(count[lang, w] / total[lang]))
    assert all(r.lang_pred == _brute_language(model, truth[r.doc_id][1]) for r in rows[:300])
    odd = {r.doc_id: r for r in language_id.identify_languages(docs).collect() if r.doc_id is not None and r.doc_id < 3}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in range(3))
    assert {r.lang_pred for r in language_id.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify_languages(empty).collect() == []


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(16, 60)))) for i in range(30)]
    items += [(77, None), (78, "too short"), (None, items[0][1]), (79, items[5][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], {}
    for i in range(60):
        text, n = fixtures.prose(rng, 200, 3000), i % 30
        item = items[n][1]
        kind = i // 10
        if kind == 0:
            rows.append((i, text))
            want[i] = set()
            continue
        if kind == 2:
            item = item.upper().replace(" ", ",\n ")
        if kind == 3:  # a few edits
            w = list(item)
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "z"
            item = "".join(w)
        if kind == 4:  # the second half of a long item
            item = item[-260:] if len(item) > 260 else item
        want[i] = {n} | ({79} if n == 5 else set())
        rows.append((i, f"{text} {item} {text[:50]}" if kind != 5 else item))
    rows += [(100, None), (101, ""), (None, items[3][1]), (102, "q" * 400)]
    want |= {100: set(), 101: set(), None: {3}, 102: set()}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    got = contamination(df, bench).collect()
    assert {r.doc_id: set(r.item_ids) for r in got} == want
    assert all(r.contaminated == bool(r.item_ids) and r.item_ids == sorted(r.item_ids) for r in got)
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w}
    assert not any(r.contaminated for r in contamination(docs, bench.where("item_id < 0")).collect())
    assert contamination(empty, bench).collect() == []


def test_alignment_is_exact():
    """Every item within the edit budget of a part of the text is found, none else."""
    rng = random.Random(9)
    item = "".join(rng.choice("abcdef gh") for _ in range(150)).strip()
    ix = build_index([(1, item)])
    pattern = bytes(ix.text[ix.start[0]:ix.start[1]]).decode()
    for trial in range(40):
        w = list(pattern)
        for _ in range(trial // 2):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice(([], ["k"], [w[i], "k"]))
        text = "zz zz " + "".join(w) + " yy yy"
        raw = np.frombuffer(text.encode(), np.uint8)
        _, found, edits = matches(raw, np.array([0, len(raw)]), ix)
        row = [0] * (len(text) + 1)  # least edits of the pattern against any part
        norm = " ".join(text.split())
        row = [0] * (len(norm) + 1)
        for i, x in enumerate(pattern):
            new = [i + 1]
            for j, y in enumerate(norm):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        assert bool(len(found)) == (min(row) <= ix.edits[0])
        if len(found):
            assert edits[0] == min(row)


def test_encoder_equals_whole_texts():
    import tokenizers
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = [t or "" for t in TEXTS] + ["a  b", " a", "a ", "a \n b", "x\u00a0 y", "it's <|endoftext|> we'll", "\t", "é è 日本 語", "1 2  3"]
    got = Encoder(tokenizer_path()).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_on_odd_pieces():
    """Marks, line breaks and other white space between words, contractions, control texts: the ids of whole texts."""
    rng = random.Random(1)
    bits = ["a", "é", "word", "ß", "日本", "1", "2x", "'s", "'", "don't", *",.!?:;", " ", "  ", "\n", "\t", "\u00a0", "<|", "|>", "<|endoftext|>", "_", "-", "“", "𝒳", "\r\n"]
    encoder = Encoder(tokenizer_path())
    for _ in range(1500):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        assert encoder.encode(texts) == encoder.whole(texts)


def test_encoder_on_runs_of_marks():
    """Runs of marks behind letters, long ones, before digits and in several lines; words of one batch that another made known."""
    rng = random.Random(5)
    bits = ["a", "Été", "straße", "日", "7", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'", "###", "|>", "=" * 9, "…", "\u00ad", "\u0301", " ", " ", "\n", "<|endoftext|>"]
    encoder = Encoder(tokenizer_path())
    for _ in range(1500):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(rng.randrange(6))]
        assert encoder.encode(texts) == encoder.whole(texts)


def test_words_of_letters_skip_the_pre_tokenizer():
    """Only a text's first piece needs it: the others go to the tokenizer's model, with the marks behind them counted once."""
    class Counting:
        def __init__(self, inner):
            self.inner, self.model, self.characters = inner, inner.model, 0

        def encode_batch_fast(self, texts, **how):
            self.characters += sum(map(len, texts))
            return self.inner.encode_batch_fast(texts, **how)

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdeéß", k=8)) + rng.choice(["", "", ",", ".", "###", ".\nÜber"]) for _ in range(300)) for _ in range(20)]
    encoder = Encoder(tokenizer_path())
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    got = encoder.encode(texts)
    assert counting.characters < sum(map(len, texts)) // 20
    assert got == encoder.whole(texts)


def test_token_files(spark, docs, empty):
    manifest = write_tokens(docs)
    got = read_tokens(manifest).collect()
    encoder = Encoder(tokenizer_path())
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    bodies = sorted((r.doc_id if r.doc_id is not None else -1, (ids := encoder.encode([r.text or ""])[0] + b"\0\0\0\0") and len(ids) // 4, zlib.crc32(ids)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == bodies
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    r = next(r for r in got if r.doc_id == 20)
    fs, path = filesystem(r.path)
    with fs.open_input_file(path) as f:
        assert zlib.crc32(Reader(f).get(20)[0]) == r.ids_crc32
    assert read_tokens(write_tokens(empty)).collect() == []


def test_seek_table():
    import zstandard
    out = io.BytesIO()
    out.close, close = (lambda: None), out.close
    w = Writer(out)
    bodies = [bytes([i]) * 4 * i for i in range(50)]
    for i, b in enumerate(bodies):
        w.add(i * 3, b)
    w.close()
    raw = out.getvalue()
    r = Reader(io.BytesIO(raw))
    assert [r.frame(i) for i in range(50)] == [(i * 3, b) for i, b in enumerate(bodies)]
    assert r.get(30) == [bodies[10]] and r.get(31) == []
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == sum(12 + len(b) for b in bodies)
    at = int(r.starts[20]) + 14
    broken = Reader(io.BytesIO(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1:]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        broken.frame(20)
    assert broken.frame(19)[1] == bodies[19]


URLS = [None, "", "no scheme", "http://A.Example.NET/en/1", "http://example.net/EN/1", "http://example.net", "http://x.net?q=/", "https://net/",
        "https://example.com/de/2", "https://badexample.com/de/2", "https://w.example.com/fr/2", "http://a.org/fr/x", "http://a.org/frx", "ftp://org/fr/",
        "http://m.Free-Bets.example.com/x", "http://xfree-bets.example.com/", "http://casino.example.com/", "http://a/b://c.net/", "http://a.info/x.EXE",
        "http://a.info/x.exe?y", "http://a.info/robots.txt", "http://free-bets.a.info/robots.txt", "http://www.archive.org", "http://a.info/login?x=1", "http://a.info/a\nb/en/"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("token", F.lit(1)).withColumn("host", F.lit("clash"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = sorted(con.execute(url_filter.ORACLE_SQL).fetchall(), key=str)
    assert sorted(map(tuple, url_filter.filter_urls(pages).collect()), key=str) == want
    assert {w[3] for w in want} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_url_tokens():
    assert url_filter.pattern_rule("block", "||casino.*^").tokens == ("casino",)
    assert url_filter.pattern_rule("block", "banner*ads/x.gif|").tokens == ("x", "gif")
    assert url_filter.host_rule("block", "net").tokens == ()
    assert url_filter.host_rule("block", "a.net/en").tokens == ("a", "net")


def test_mixing(spark, docs, empty):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    want = sorted(con.execute(mixing.oracle_sql()).fetchall(), key=str)
    got = mixing.mixing_plan(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert mixing.mixing_plan(empty).collect() == []
    assert not any(r.kept for r in mixing.mixing_plan(docs, rate=0.0).collect())


def test_mixing_meets_targets(spark):
    cells = [(f"={s}", f"={lang}", 1000 * (s + 1) * (lang + 2)) for s in range(4) for lang in range(3)]
    df = spark.createDataFrame(cells, "source string, lang string, w long")
    raked = mixing.rake(df, {"source": 0.0, "lang": {"0": 0.5, "1": 0.3, "2": 0.2}}, rounds=30).collect()
    for s in range(4):
        assert sum(r.x for r in raked if r.source == f"={s}") == pytest.approx(0.25, abs=1e-9)
    for lang, share in enumerate((0.5, 0.3, 0.2)):
        assert sum(r.x for r in raked if r.lang == f"={lang}") == pytest.approx(share, abs=1e-9)
    p = mixing.probabilities(spark.createDataFrame(raked), 30_000.0).collect()
    assert sum(r.p * r.w for r in p) == pytest.approx(30_000, rel=1e-6) and max(r.p for r in p) <= 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    step = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF_SMALL)
        assert step.columns == d.columns, name
    want = sorted(r.doc_id for r in step.select("doc_id").collect())
    assert sorted(r.doc_id for r in out.collect()) == want and 0 < len(want) < d.count()
    none = d.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF_SMALL) if name != "token output" else stage(spark, none, SF_SMALL)
        assert none.count() == 0


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
