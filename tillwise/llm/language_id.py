"""Language ID by word-first backoff.

For each language the model has the relative frequency of words and of character n-grams (1 to
``LONGEST``, words padded with a blank on both sides). A word that is known in any language scores with
each language's log frequency, ``PENALTY`` where a language lacks it. An unseen word backs off to its
n-grams, longest first: the first length of which a gram is known gives the mean over its known grams.
A document's score for a language is the mean over its words; the least (in -log10) is the prediction,
and ``score`` is the share of the winner in exp(-n * mean), n at most ``EVIDENCE`` words.

Scale. Words are counted over all training documents: each task counts its words in a bounded table and
sends (language, word, count); Spark adds them up. N-grams are counted from the distinct words, weighted
by the counts. Every word and n-gram of every language is kept, in written tables (word or gram, and for
each language that holds it its score's distance from ``PENALTY``) that grow with the input. Only the
``HEAD_WORDS`` most frequent words travel to the tasks: they are summed up in one pass over the texts, a
chunk of about ``TEXT_BYTES`` at a time, looking at its distinct tokens. The other words of a document are looked up by a join of the distinct ones with the
table, and those unknown there by joins of their n-grams, a length at a time; keys that hold a large part
of the rows are joined by broadcast (at most ``HOT`` keys). Tables that the predictions no longer read
are deleted on the way. :func:`fit_language_model` brings the whole
model to the driver, to look at a small one.

Defined cases. Null text, or text without a letter: ``und``, score 0. No training documents: ``und`` for
all. Ties: the language that sorts first. Null id: predicted, not held out, and used for training like
any other row. Repeated rows count as often as they occur. Empty table: empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.materialize import materialize_table, only_kept
from tillwise.llm.quality_classifier import held_out
from tillwise.llm.shipping import shipped
from tillwise.llm.words import byte_chunks

LONGEST, PENALTY, EVIDENCE = 5, 7.0, 8
HEAD_WORDS, HOT = 50_000, 2_000
TABLE_ROWS, SUM_CELLS, TEXT_BYTES, GRAM_BYTES = 400_000, 2_000_000, 1 << 20, 1 << 20


def normal(token: str) -> str | None:
    """The word in a token: lower case, without what is no letter at its ends; None if it has no letter."""
    token = token.lower()
    if token.isalpha():
        return token
    i, j = 0, len(token)
    while i < j and not token[i].isalpha():
        i += 1
    while j > i and not token[j - 1].isalpha():
        j -= 1
    return token[i:j] or None


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each token, what ``str.split`` gives: its row and its place among the distinct tokens; and these. Empty tokens may stand
    at the ends of a text."""
    cut = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = cut.flatten().dictionary_encode()
    return pc.list_parent_indices(cut).to_numpy().astype(np.int64), coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def _flush(tables: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
    for lang, table in tables.items():
        out: dict[str, int] = {}
        for token, n in table.items():
            word = normal(token)
            if word is not None:
                out[word] = out.get(word, 0) + n
        words, counts = pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())
        for i in range(0, len(out), 50_000):
            word = words.slice(i, 50_000)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(word)), word, counts.slice(i, 50_000)], ["lang", "word", "n"])
    tables.clear()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, dict[str, int]] = {}
    for b in batches:
        for lo, hi, _, _ in byte_chunks(b.column("text"), TEXT_BYTES):
            row, place, tokens = _tokens(b.column("text").slice(lo, hi - lo))
            langs = b.column("lang").slice(lo, hi - lo).dictionary_encode()
            spoken = langs.indices.to_numpy()[row]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                counts = np.bincount(place[spoken == k], minlength=len(tokens))
                at = np.flatnonzero(counts)
                table = tables.setdefault(lang, {})
                get = table.get
                for i, n in zip(at.tolist(), counts[at].tolist(), strict=True):
                    table[tokens[i]] = get(tokens[i], 0) + n
            if sum(map(len, tables.values())) > TABLE_ROWS:
                yield from _flush(tables)
    yield from _flush(tables)


def _gram_counts(langs: pa.Array, words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams of words with the sums of their words' counts, a length at a time: a gram's number is that of its first
    characters and its last one."""
    text = "".join([f" {w} " for w in words])
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.repeat(np.cumsum(size), size)
    coded = langs.dictionary_encode()
    lang, names = np.repeat(coded.indices.to_numpy().astype(np.int64), size), coded.dictionary.cast(pa.string())
    n_of = np.repeat(counts, size)
    letters, letter = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
    at, number = np.arange(len(text)), lang
    for n in range(1, LONGEST + 1):
        fits = at + n <= end[at]
        at = at[fits]
        key = number[fits] * len(letters) + letter[at + n - 1]
        if not len(at):
            return
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        heads = np.flatnonzero(new)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        first = at[order[heads]]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(lang[first])), pa.array([text[i:i + n] for i in first.tolist()], pa.string()),
             pa.array(np.add.reduceat(n_of[at[order]], heads))], ["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n_chars = 0

    def counted() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from _gram_counts(t.column("lang").combine_chunks(), t.column("word").to_pylist(), t.column("n").to_numpy())
        held.clear()

    for b in batches:
        for lo, hi, buf, _ in byte_chunks(b.column("word"), GRAM_BYTES):
            held.append(b.slice(lo, hi - lo))
            n_chars += len(buf)
            if n_chars > GRAM_BYTES:
                yield from counted()
                n_chars = 0
    if held:
        yield from counted()


class Model:
    """Scores in -log10 for each language, by word and by n-gram."""

    def __init__(self, languages: list[str], words: list[tuple[str, str, int]], grams_: list[tuple[str, str, int]], totals: dict):
        self.languages = languages
        at = {lang: i for i, lang in enumerate(languages)}
        keys: dict[tuple[int, str], int] = {}
        cells = []
        for kind, rows in ((0, words), (1, grams_)):
            for lang, key, n in rows:
                size = len(key) if kind else 0
                row = keys.setdefault((kind, key), len(keys))
                cells.append((row, at[lang], -np.log10(n / totals[lang, size])))
        table = np.full((len(keys), len(languages)), PENALTY)
        for r, c, v in cells:
            table[r, c] = v
        rows = table.tolist()
        self.words = {k: rows[r] for (kind, k), r in keys.items() if not kind}
        self.grams = {k: rows[r] for (kind, k), r in keys.items() if kind}

    def word_scores(self, token: str) -> list[float] | None:
        """None: a token without a letter."""
        word = normal(token)
        if word is None:
            return None
        row = self.words.get(word)
        if row is not None:
            return row
        get = self.grams.get
        padded = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = [r for i in range(len(padded) - n + 1) if (r := get(padded[i:i + n])) is not None]
            if known:
                return [sum(c) / len(known) for c in zip(*known, strict=True)]
        return [PENALTY] * len(self.languages)


@dataclass
class Tables:
    """The written model. ``words``, ``grams``: key, vec (one (l, d) for each language that holds the key: its place and score -
    PENALTY; and (-1, 1.0), which counts)."""
    languages: list[str]
    totals: dict
    counts: tuple[DataFrame, DataFrame]  # (lang, word, n), of words and of n-grams
    words: DataFrame
    grams: DataFrame


class Head:
    """The most frequent words, for the tasks. The cells of word i, (place, score), are ``starts[i]`` to ``starts[i + 1]``; the last
    place counts words."""

    def __init__(self, languages: int, rows: list[tuple[str, list[tuple[int, float]]]]):
        self.width = languages + 1
        self.words = [word for word, _ in rows]
        self.starts = np.cumsum([0, *(len(vec) for _, vec in rows)])
        self.places = np.array([place for _, vec in rows for place, _ in vec], np.int64) % self.width
        self.scores = np.array([d for _, vec in rows for _, d in vec], float)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _head_sums(batches: Iterator[pa.RecordBatch], head: Head) -> Iterator[pa.RecordBatch]:
    """Of each row: the sums over its head words, and its other words with their counts."""
    known = {word: i for i, word in enumerate(head.words)}  # words are normal, so a token that equals one is that word
    most, step = 4 * len(known), max(SUM_CELLS // head.width, 1)
    for b in batches:
        for lo, hi, _, _ in byte_chunks(b.column("text"), TEXT_BYTES):
            row, place, tokens = _tokens(b.column("text").slice(lo, hi - lo))
            word_of = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
            tail_of = np.full(len(tokens), -1)
            tail: dict[str, int] = {}
            for i in np.flatnonzero(word_of < 0).tolist():
                word = normal(tokens[i])
                if word is None:
                    continue
                if (at := known.get(word)) is not None:
                    word_of[i] = at
                    if len(known) < most:
                        known[tokens[i]] = at  # no word is spelled so, since words are normal
                else:
                    tail_of[i] = tail.setdefault(word, len(tail))
            hit = word_of[place]
            mine, hit = row[hit >= 0], hit[hit >= 0]
            sums = np.zeros((hi - lo) * head.width)
            for i in range(0, len(hit), step):
                first = head.starts[hit[i:i + step]]
                size = head.starts[hit[i:i + step] + 1] - first
                end = np.cumsum(size)
                cell = np.repeat(first - (end - size), size) + np.arange(end[-1])
                sums += np.bincount(np.repeat(mine[i:i + step], size) * head.width + head.places[cell], head.scores[cell], len(sums))
            rest = tail_of[place]
            pair, n = np.unique(row[rest >= 0] * max(len(tail), 1) + rest[rest >= 0], return_counts=True)
            mine, rest = np.divmod(pair, max(len(tail), 1))
            tails = pa.StructArray.from_arrays([pa.array(list(tail), pa.string()).take(pa.array(rest)), pa.array(n.astype(np.int64))], ["word", "c"])
            yield pa.RecordBatch.from_arrays(
                [b.column("did").slice(lo, hi - lo), _lists(np.full(hi - lo, head.width), pa.array(sums)),
                 _lists(np.bincount(mine, minlength=hi - lo), tails)], ["did", "sums", "tail"])


def _decide(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, scores = [], []
        for sums, more in zip(b.column("sums"), b.column("more").to_pylist(), strict=True):
            total = np.array(sums.values.to_numpy(zero_copy_only=False), float)
            for v in more or ():
                total[v["l"]] += v["d"]
            n = round(total[-1])
            if not n or not languages:
                names.append("und")
                scores.append(0.0)
                continue
            mean = PENALTY + total[:-1] / n
            best = int(np.argmin(mean))
            names.append(languages[best])
            scores.append(float(1 / np.exp(-np.log(10) * min(n, EVIDENCE) * (mean - mean[best])).sum()))
        yield pa.RecordBatch.from_arrays([b.column("did"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["did", "lang_pred", "score"])


_TOTALS = pa.schema([("l", pa.int32()), ("lang", pa.string()), ("size", pa.int32()), ("total", pa.int64())])


def _vectors(counts: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """key, vec and n (over all languages). A key has a row for each language at most."""
    score = -F.log10(F.col("n") / F.col("total")) - F.lit(PENALTY)
    return counts.join(F.broadcast(totals), by).groupBy(F.col("word").alias("key")).agg(
        F.collect_list(F.struct("l", score.alias("d"))).alias("vec"), F.sum("n").alias("n")) \
        .select("key", F.array_append("vec", F.struct(F.lit(-1).alias("l"), F.lit(1.0).alias("d"))).alias("vec"), "n")


def language_tables(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Tables:
    """Counts over all rows with a text and a language, as written tables."""
    spark = docs.sparkSession
    rows = shipped(docs).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    schema = "lang string, word string, n long"
    words = materialize_table(rows.mapInArrow(_count_words, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = {(r["lang"], 0): r["total"] for r in words.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(lang for lang, _ in totals)
    counted = words.mapInArrow(_count_grams, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("size", F.length("word"))
    counted = materialize_table(counted, "grams")
    totals |= {(r["lang"], r["size"]): r["total"] for r in counted.groupBy("lang", "size").agg(F.sum("n").alias("total")).collect()}
    at = {lang: i for i, lang in enumerate(languages)}
    sums = spark.createDataFrame(pa.Table.from_pylist([{"l": at[lang], "lang": lang, "size": size, "total": n} for (lang, size), n in totals.items()], _TOTALS))
    return Tables(languages, totals, (words, counted),
                  materialize_table(_vectors(words, sums.where("size = 0").drop("size"), ["lang"]), "word_table"),
                  materialize_table(_vectors(counted, sums, ["lang", "size"]), "gram_table"))


def fit_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The whole model in the driver."""
    t = language_tables(docs, text_col, lang_col)
    words, counted = ([tuple(r) for r in c.select("lang", "word", "n").collect()] for c in t.counts)
    return Model(t.languages, sorted(words), sorted(counted), t.totals)


def _head(tables: Tables, head_words: int) -> Head:
    """The words with the largest counts that at most ``head_words`` words have. The counts of counts are few, so no task ranks words."""
    by = tables.words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(head_words).collect()
    upto, least = 0, None
    for r in by:
        upto += r["words"]
        if upto > head_words:
            break
        least = r["n"]
    rows = [] if least is None else tables.words.where(F.col("n") >= least).select("key", "vec").collect()
    return Head(len(tables.languages), [(r["key"], [(v["l"], v["d"]) for v in r["vec"]]) for r in rows])


def _keys(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Each key and how many rows have it, written."""
    return materialize_table(rows.groupBy("key").agg(F.count("*").alias("rows")), name, path)


def _lookup(rows: DataFrame, keys: DataFrame, table: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows with the vec of their key, inner. Keys with more than 1 / ``hot`` of the rows are joined by broadcast."""
    n = keys.agg(F.sum("rows")).first()[0] or 0
    often = materialize_table(keys.where(F.col("rows") * hot > n).select("key"), "hot_keys")
    table = table.select("key", "vec")
    return rows.join(F.broadcast(table.join(F.broadcast(often), "key", "left_semi")), "key") \
        .unionByName(rows.join(F.broadcast(often), "key", "left_anti").join(table, "key"))


def _piece(text: Column, n: int, at: Column) -> Column:
    return F.substring(text, at, F.lit(n))


def _word_vectors(words: DataFrame, tables: Tables, path: str) -> DataFrame:
    """key, vec of distinct words (key): from the word table, else the mean over the known grams of the longest length that has one."""
    known = words.join(tables.words.select("key", "vec"), "key", "left")
    known = materialize_table(known, "tail_words")
    out, left = known.where("vec IS NOT NULL"), known.where("vec IS NULL").select(F.col("key").alias("word"))
    for n in range(LONGEST, 0, -1):
        if left.isEmpty():
            break
        padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
        places = F.when(F.char_length(padded) >= n, F.sequence(F.lit(1), F.char_length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
        rows = left.select("word", F.explode(F.transform(places, partial(_piece, padded, n))).alias("key"))
        rows = materialize_table(rows, f"tail_grams{n}")
        sums = _lookup(rows, _keys(rows, f"gram_keys{n}"), tables.grams).select("word", F.inline("vec")).groupBy("word", "l").agg(F.sum("d").alias("d"))
        vec = sums.groupBy("word").agg(F.collect_list(F.struct("l", "d")).alias("vec"))
        mean = F.expr("transform(vec, v -> named_struct('l', v.l, 'd', v.d / filter(vec, u -> u.l = -1)[0].d))")
        found = materialize_table(vec.select(F.col("word").alias("key"), mean.alias("vec")), f"tail_known{n}")
        out = out.unionByName(found)
        left = materialize_table(left.join(found, left["word"] == found["key"], "left_anti"), f"tail_left{n}")
    # a word of which nothing is known counts with PENALTY for all
    none = F.array(F.struct(F.lit(-1).alias("l"), F.lit(1.0).alias("d")))
    return materialize_table(out.unionByName(left.select(F.col("word").alias("key"), none.alias("vec"))), "tail_vectors", path)


@dataclass
class Parts:
    """What the predictions are made from, written: ``base`` (row, did, sums, tail), and of the tail's words, ``keys`` (key, rows)
    and ``vectors`` (key, vec)."""
    base: DataFrame
    keys: DataFrame
    vectors: DataFrame


_PARTS = ("head_sums", "tail_keys", "tail_vectors")


def _parts(docs: DataFrame, tables: Tables, paths: list[str], id_col: str, text_col: str, head_words: int = HEAD_WORDS) -> Parts:
    base = shipped(docs).select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text")) \
        .mapInArrow(partial(_head_sums, head=_head(tables, head_words)), "did long, sums array<double>, tail array<struct<word:string,c:long>>")
    base = materialize_table(base.withColumn("row", F.monotonically_increasing_id()), path=paths[0])
    keys = _keys(base.select(F.inline("tail")).select(F.col("word").alias("key")), "tail_keys", paths[1])
    return Parts(base, keys, _word_vectors(keys.select("key"), tables, paths[2]))


def _predictions(parts: Parts, languages: list[str], id_col: str) -> DataFrame:
    tail = parts.base.select("row", F.inline("tail")).select("row", F.col("word").alias("key"), "c")
    sums = _lookup(tail, parts.keys, parts.vectors).select("row", "c", F.inline("vec")).groupBy("row", "l").agg(F.sum(F.col("c") * F.col("d")).alias("d"))
    more = sums.groupBy("row").agg(F.collect_list(F.struct("l", "d")).alias("more"))
    out = parts.base.select("row", "did", "sums").join(more, "row", "left").drop("row") \
        .mapInArrow(partial(_decide, languages=languages), "did long, lang_pred string, score double")
    return out.withColumnRenamed("did", id_col)


def predict_languages(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """One row per document: its id, ``lang_pred`` and ``score``."""
    with only_kept(docs.sparkSession, *_PARTS) as paths:
        parts = _parts(docs, tables, paths, id_col, text_col, head_words)
    return _predictions(parts, tables.languages, id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts all rows; with ``held_out``."""
    with only_kept(docs.sparkSession, *_PARTS) as paths:
        tables = language_tables(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
        parts = _parts(docs, tables, paths, id_col, text_col, **how)
    out = _predictions(parts, tables.languages, id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
