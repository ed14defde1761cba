"""Quality, toxicity and language: accuracy on held-out rows and edge cases."""

import zlib

import numpy as np
import pytest

from arealis.llm import language, quality, toxicity
from arealis.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "1234 !!"), (5, "word " * 200_000), (5, "word " * 200_000), (None, "no id")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, None, "s", "x", "x") for i, t in rows], "doc_id long, text string, lang string, source string, _text string, score string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def joined(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    return got.merge(docs, on="doc_id").merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id", how="left")


def test_quality_ranks_held_out_documents(spark):
    m = joined(spark, "op3_quality_ranking")
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in m.doc_id]).all()
    assert m.score.between(0, 1).all() and ((m.score >= 0.3) == (m.predicted == 1)).all()
    h = m[m.held_out & m.quality.notna()]
    assert (h.predicted == h.quality).mean() > 0.95
    good, bad = h[h.quality == 1].score.to_numpy(), h[h.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97


def test_pairs_by_hand():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, quality.SIZE))
    good = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.standard_normal(400) > -1).astype(int)
    m = quality.fit_pairs(x, good)
    assert m.weights[0] > 0 > m.weights[1] and ((m.score(x) >= quality.CUT) == good).mean() > 0.9
    assert (quality.fit_pairs(x, np.ones(400)).score(x) == 0.5).all()
    assert (quality.fit_pairs(np.zeros((0, quality.SIZE)), np.zeros(0)).score(x) == 0.5).all()


@pytest.mark.parametrize("known", [[], [(1, 1, 0)], [(1, 1, 1), (4, 0, 0), (4, 0, 0), (5, None, None), (99, 1, 1), (None, 0, 1)]])
def test_classifiers_take_odd_rows(spark, known):
    d, lab = docs(spark), labels(spark, known)
    score = d.select(quality.score_column(quality.train(d, lab))("text").alias("s")).collect()
    assert len(score) == len(ODD) and all(0 <= r.s <= 1 for r in score)
    chain = toxicity.train(d, lab)
    p = d.select(toxicity.chances_column(chain)("text").alias("p")).collect()
    assert all(len(r.p) == 3 and all(0 <= x <= 1 for x in r.p) for r in p)
    kept = toxicity.keep_clean(quality.keep_good(d, d, lab), d, lab)
    assert kept.columns == d.columns
    none = docs(spark, [])
    assert toxicity.keep_clean(quality.keep_good(none, none, lab), none, lab).count() == 0


def test_chain_finds_toxic_documents(spark):
    m = joined(spark, "op7_toxicity_chain")
    known = m[m.toxic_y.notna()]
    assert ((known.toxic_x) & (known.toxic_y == 0)).mean() < 0.005
    assert ((~known.toxic_x) & (known.toxic_y == 1)).mean() < 0.02


def test_earlier_categories_help_later_ones():
    rng = np.random.default_rng(1)
    x = (rng.random((600, 6)) < 0.3).astype(float)
    first = x[:, 0].astype(bool) | x[:, 1].astype(bool)
    second = first & x[:, 2].astype(bool)
    model = toxicity.fit_chain(x, np.c_[first, second].astype(float), ["a", "b"], {})
    assert len(model.weights[1]) == len(model.weights[0]) + 1
    p = model.predict(x)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.98 and ((p[:, 1] > 0.5) == second).mean() > 0.95


def test_feature_rows_are_the_features():
    text = "Stemalpha stembeta other Stem stemgamma the"
    names = toxicity.features(text)
    index = {f: i for i, f in enumerate([*sorted(names), "absent", "abs+", "abs++"])}
    row = toxicity.Chain([], index, []).rows([text, None, ""])
    assert {f for f, i in index.items() if row[0, i]} == set(names) and not row[1:].any()
    assert "stem++" in names and "stema+" in names and "other" in names and "the+" not in names


def test_languages_of_held_out_documents(spark):
    m = joined(spark, "op5_language_mixtures")
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in m.doc_id]).all()
    h = m[m.held_out & m.lang.notna()]
    assert (h.lang_pred == h.lang).mean() > 0.99 and m.score.between(0, 1).all()


def test_mixture_by_brute_force():
    texts = {"a": "abba baba abab " * 40, "b": "cddc dcdc ccdd " * 40}
    n = np.array([np.bincount(language.grams([t])[0], minlength=language.BUCKETS) for t in texts.values()], float)
    model = language.Languages(list(texts), np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * language.BUCKETS)).astype(np.float32))
    only, both, none, tie = model.mixtures([texts["a"], texts["a"] + texts["b"] + texts["b"], "123 --", "xyz"])
    assert only[:2] == ("a", 1.0) and only[2] == ["a"]
    assert both[0] == "b" and both[2] == ["b", "a"] and both[1] == pytest.approx(2 / 3, abs=0.01)
    assert none is None and tie[0] == "a"


def test_grams_do_not_leave_a_text():
    one = [language.grams([t]) for t in ("ab cd", "e", "Éa1b")]
    cells, first, owner = language.grams(["ab cd", "e", "Éa1b"])
    assert cells.tolist() == sum((c[0].tolist() for c in one), []) and owner.tolist() == [0, 0, 1, 2, 2]


def test_language_of_odd_rows(spark):
    d = docs(spark)
    nothing = language.train(d)
    assert {r.g.lang for r in d.select(language.guess_column(nothing)("text").alias("g")).collect()} == {"und"}
    some = language.train(spark.createDataFrame([("word text", "en"), ("mot texte", "fr"), (None, "fr"), ("x", None)], "text string, lang string"))
    got = [r.g.lang for r in d.select(language.guess_column(some)("text").alias("g")).collect()]
    assert got[:4] == ["und"] * 4 and set(got[4:]) <= {"en", "fr"}


def test_language_sets_match_a_plain_loop():
    """EM and penalised sets, one document and one word at a time, with more than three languages."""
    rng = np.random.default_rng(6)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    word = lambda k: "".join(rng.choice(list(letters[k]), 6))
    logs = np.zeros((5, language.BUCKETS))
    for k in range(5):
        n = np.bincount(language.grams([" ".join(word(k) for _ in range(3000))])[0], minlength=language.BUCKETS)
        logs[k] = np.log((n + 0.5) / (n.sum() + 0.5 * language.BUCKETS))
    model = language.Languages(list("vwxyz"), logs.astype(np.float32))
    texts = [" ".join(word(k % (m + 1)) for k in range(60)) for m in range(5)] + ["abc", "abc pqr"]
    for text, got in zip(texts, model.mixtures(texts)):
        words = [logs[:, language.grams([w])[0]].sum(1) for w in text.split()]
        like = np.exp(np.array(words) - np.max(words, axis=1, keepdims=True))
        rest = np.max(words, axis=1).sum()

        def em(allowed):
            share = allowed / allowed.sum()
            for _ in range(language.STEPS):
                share = np.mean([w * share / (w * share).sum() for w in like], axis=0)
            return share, np.log((like * share).sum(1)).sum() + rest

        order = np.argsort(-em(np.ones(5))[0], kind="stable")
        best = (-np.inf, None, 0)
        for k in range(1, 6):
            if k > 3 and best[2] < k - 1:
                break
            share, value = em(np.isin(np.arange(5), order[:k]).astype(float))
            value -= language.PENALTY * (k - 1) * np.log(len(words) + 1)
            best = max(best, (value, share, k), key=lambda b: b[0])
        want = {model.names[j]: best[1][j] for j in range(5) if best[1][j] > 1e-6}
        assert set(got[2]) == set(want) and got[3] == pytest.approx([want[x] for x in got[2]], abs=1e-3)
    assert [len(m[2]) for m in model.mixtures(texts[:5])] == [1, 2, 3, 4, 5]
