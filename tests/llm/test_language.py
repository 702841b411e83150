import math
import zlib
from fractions import Fraction

import numpy as np

from riskframe.llm import language
from riskframe.llm.queries import QUERIES
from llm_helpers import docs, odd_texts, vocabulary


def all_segmentations(word, p, floor):
    """Sum over every way to cut the word, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        piece = word[:n]
        weight = p.get(piece, floor if n == 1 else 0.0)
        total += weight * all_segmentations(word[n:], p, floor) if weight else 0.0
    return total


def test_forward_sums_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", language.MARK, language.MARK + "a"]
    probabilities = np.array([[.2, .1], [.3, .1], [.1, .2], [.1, .3], [.1, .1], [.1, .1], [.1, .1]])
    model = language.Model(["x", "y"], pieces, probabilities)
    words = ["abab", "ba", "aabbx", "a", "zzz"]
    for word, row in zip(words, model.word_scores(words)):
        for k in range(2):
            p = dict(zip(pieces, probabilities[:, k]))
            assert math.isclose(row[k], math.log(all_segmentations(language.MARK + word, p, language.FLOOR)), rel_tol=1e-9)


def test_training_gives_frequent_pieces_weight():
    model = language.train({"x": {"abab": 10, "ab": 5}, "y": {"baba": 10}}, ["a", "b", "ab", "ba", language.MARK])
    assert np.allclose(model.table[:-2].sum(axis=0), 1)
    assert [p[0] for p in model.predict(["abab ab", "baba", "123", None])] == ["x", "y", "und", "und"]


def test_words_of_any_length_are_summed_over_all_segmentations():
    pieces = ["a", "ab", "b", "ba", "aba", "bbbb", language.MARK, language.MARK + "a"]
    probabilities = np.random.default_rng(4).dirichlet(np.ones(8), 2).T
    model = language.Model(["x", "y"], pieces, probabilities)
    word = "".join(np.random.default_rng(5).choice(list("abx"), 400, p=[.5, .45, .05]))

    def exact(word, p):  # whole numbers: nothing can underflow
        p = {k: Fraction(float(v)) for k, v in p.items()}
        sums = [Fraction(1)]
        for end in range(1, len(word) + 1):
            cuts = range(max(0, end - 5), end)
            sums.append(sum(sums[i] * p.get(word[i:end], Fraction(language.FLOOR) if end - i == 1 else 0) for i in cuts))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    for w in (word, word[:41], word[:40], "z" * 39):
        want = [exact(language.MARK + w, dict(zip(pieces, probabilities[:, k]))) for k in range(2)]
        assert np.allclose(model.word_scores([w])[0], want, rtol=1e-12)
        assert np.allclose(model.text_scores([["ab", w]])[0], np.array(want) + model.word_scores(["ab"])[0], rtol=1e-12)


def test_only_letters_make_words():
    assert language.words_of(" ² ½ Ⅷ ٣ _ ") == [] and language.words_of("x²y 日本 ß_Ñ") == ["x", "y", "日本", "ß", "ñ"]


def test_three_hundred_languages(spark):
    """None is too rare to be learned, and blocks of languages do not change a score."""
    words = {f"l{i:03}": "".join(chr(97 + i // 26 ** k % 26) for k in range(2)) * 2 + "q" for i in range(300)}
    rows = [(n, f"{w} {w} {w}", lang) for n, (lang, w) in enumerate(3 * list(words.items()))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.fit(df, vocabulary("piece_bpe_32k.model"))
    learned = {lang for n, _, lang in rows if zlib.crc32(str(n).encode()) % 4 != 2}
    assert set(model.languages) == learned and len(learned) > 280
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()}
    hits = sum(got[f"{w} {w} {w}"][0] == lang for lang, w in words.items() if lang in learned)
    assert hits > 0.95 * len(learned)
    for text, (lang, score) in list(got.items())[:20]:
        whole = np.concatenate([p.text_scores([language.words_of(text)])[0] for p in model.parts])
        assert lang == model.languages[int(whole.argmax())]
        assert math.isclose(score, 1 / np.exp(whole - whole.max()).sum(), rel_tol=1e-9)


def test_odd_rows(spark):
    df = docs(spark, odd_texts())
    model = language.train({"en": {"word": 3}, "fr": {"mot": 3}}, language.vocabulary_pieces(vocabulary("piece_bpe_32k.model")))
    rows = language.predict(df, model, "p_").collect()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["p_lang_pred"] == "und") == (not letters)
        assert 0 <= r["p_score"] <= 1
    empty = df.filter("false")
    assert language.predict(empty, model).count() == 0
    none = language.fit(empty, vocabulary("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in language.predict(df, none).collect()} == {"und"}


def test_cache_does_not_change_results(monkeypatch):
    model = language.train({"en": {"word": 3, "the": 9}, "fr": {"mot": 3}}, ["w", "o", "r", "d", "the", "mot", language.MARK])
    texts = ["the word", "mot mot", "other words here", "the"]
    want = model.predict(texts)
    monkeypatch.setattr(language, "CACHE_WORDS", 2)
    assert [model.predict([t])[0] for t in texts] == want


def test_held_out_rows_and_accuracy(spark, sf):
    got = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.93, sum(held) / len(held)
