"""Language ID: words and languages beyond any head are used as the training rows hold them."""

import random

import numpy as np
import pytest
from tillwise.llm import language_id


@pytest.mark.parametrize("head_words", [0, 50, 1_000_000])
def test_all_words_and_languages(spark, head_words):
    rng = random.Random(8)
    letters = "abcdefghijklmnoprstuvz"
    rows, words = [], {}
    for k in range(230):  # more languages than 200, the last ones rare
        words[k] = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(12)]
        rows.append((10 * k, " ".join(words[k] * (1 + (230 - k) // 40)), f"l{k:03d}"))
    rows.append((5000, " ".join(f"v{i}x{i * 7919 % 10007}" for i in range(11_000)), "l000"))  # words of count 1, beyond 10,000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tables, model = language_id.language_tables(df), language_id.fit_language_model(df)
    assert len(model.languages) == 230 and len(model.words) > 11_000
    asked = [(k, " ".join(words[k][:3]), f"l{k:03d}") for k in range(230)]
    asked += [(1000 + k, f"{words[k][0]}! {words[k][1][:-1]}q qq {rng.choice(words[7])}", None) for k in range(60)]
    asked += [(2000, "v10999x" + str(10999 * 7919 % 10007), "l000"), (2001, "12 --", "und"), (2002, None, "und"), (2003, "ωω", None)]
    got = {r.doc_id: r for r in language_id.predict_languages(
        spark.createDataFrame(asked, "doc_id long, text string, lang string"), tables, head_words=head_words).collect()}
    for i, text, lang in asked:
        scores = [s for t in (text or "").split() if (s := model.word_scores(t)) is not None]
        want = model.languages[int(np.argmin(np.round(np.mean(scores, axis=0), 9)))] if scores else "und"
        assert got[i].lang_pred == want and lang in (None, want), (i, text)
