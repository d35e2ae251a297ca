"""The language model and its threshold come from every row that teaches, not from the sample that gives the start."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import language_id

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table():
    rng = random.Random(4)
    kinds = {"aa": ["the", "of", "ing", "was"], "bb": ["über", "sch", "nicht", "öl"]}
    rows = [(k, " ".join(rng.choice(kinds[lang]) + rng.choice(["", "x", "averyverylongwordofmany"]) for _ in range(rng.randint(2, 30))), lang, "s", 0) for k in range(300) for lang in [rng.choice(["aa", "bb"])]]
    return rows + [(None, "lost", "aa", "s", 0), (901, None, "aa", "s", 0), (902, "", "bb", "s", 0), (903, "nothing", None, "s", 0), (904, "void", "", "s", 0)] + rows[:7]


def teaching():
    return [(text, lang) for k, text, lang, *_ in table() if k is not None and text and lang and zlib.crc32(str(k).encode()) % 4 != 2]


def pieces(text):
    return [w[a : a + 16] for w in text.split() for a in range(0, len(w), 16)]


def test_every_word_of_every_row_is_counted(spark):
    wanted = Counter((lang, w) for text, lang in teaching() for w in pieces(text))
    assert {(r.l, r.w): r.n for r in language_id.labelled_words(spark.createDataFrame(table(), DOCS)).collect()} == wanted


@pytest.mark.parametrize("tasks", [1, 3])
def test_whole_loss_is_the_sum_over_words(spark, tasks):
    model = language_id.ByteLanguageModel(["aa", "bb", "cc"], hidden=3)
    rows = [("aa", "the", 3), ("aa", "ing", 1), ("bb", "öl", 5), ("bb", "x" * 16, 2)]
    totals = {"aa": 16, "bb": 5 * 4 + 2 * 17}
    words = spark.createDataFrame(rows, "l string, w string, n bigint")
    loss, grads = language_id.whole_loss(words, model, totals, tasks, True)
    assert loss == pytest.approx(language_id.whole_loss(words, model, totals, tasks, False)[0], rel=1e-4)
    if tasks > 1:
        return  # where words meet depends on their tasks
    at = {lang: (" " + " ".join(w for l, w, _ in sorted(rows) if l == lang)).encode() for lang in totals}
    weights = {lang: np.repeat([n for l, _, n in sorted(rows) if l == lang], [len(w.encode()) + 1 for l, w, _ in sorted(rows) if l == lang]) / totals[lang] / 2 for lang in totals}
    wanted, slopes = 0.0, [np.zeros(p.shape) for p in model.parameters()]
    for k, lang in enumerate(("aa", "bb")):
        window, mask = np.full((48, 1), 32, np.uint8), np.zeros((48, 1), np.float32)
        window[: len(at[lang]), 0], mask[: len(at[lang]), 0] = np.frombuffer(at[lang], np.uint8), weights[lang]
        one, g = model.gradients(window, mask, np.full(1, k))
        wanted, slopes = wanted + one, [a + b for a, b in zip(slopes, g)]
    assert loss == pytest.approx(wanted, rel=1e-5)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(grads, slopes))


def test_rows_outside_the_sample_teach(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS", 2)
    docs = spark.createDataFrame(table(), DOCS)
    start, model = language_id.fit(language_id.training_sample(docs)), language_id.fitted(docs)
    words = language_id.labelled_words(docs)
    totals = {lang: sum(len(w.encode()) + 1 for text, l in teaching() if l == lang for w in pieces(text)) for lang in ("aa", "bb")}
    before, after = (language_id.whole_loss(words, m, totals, 1, False)[0] for m in (start, model))
    assert after < before


def test_the_least_score_is_a_quantile_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "ROWS", 2)
    docs = spark.createDataFrame(table(), DOCS)
    scored = language_id.identify(docs, language_id.fitted(docs)).cache()
    own = sorted(r.own for r in scored.filter("own IS NOT NULL").collect())
    assert len(own) == len(teaching())
    assert language_id.least_score(scored) == pytest.approx(0.5 * own[int(0.01 * (len(own) - 1))], abs=2 / language_id.BINS)
    assert language_id.least_score(scored.limit(20)) == 0.0
