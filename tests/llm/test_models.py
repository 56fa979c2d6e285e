import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import clashing, sentence

from curata.llm.common import remainder
from curata.llm import language_id, quality


@pytest.fixture(scope="module")
def labelled(spark):
    import random
    rng = random.Random(9)
    rows = []
    for i in range(400):
        lang = "en" if i % 2 else "de"
        rows.append((i, sentence(rng, lang, rng.randint(3, 60)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_held_out(labelled):
    train = labelled.where(remainder("doc_id", 4) != 2)
    model = language_id.fit(train)
    out = language_id.predict(labelled.where(remainder("doc_id", 4) == 2), model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_every_row_of_the_sample_size_is_learned(spark):
    """2,800 rows a language: a word of two rows counts twice, so it is known."""
    def name(i):
        return "".join(chr(97 + int(d)) for d in f"{i:04d}")

    rows = [(2 * i + j, f"{lang} {lang}x{name(i % 1400)}", lang) for i in range(2800) for j, lang in enumerate(("de", "en"))]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {f"{lang}x{name(i)}" for i in range(1400) for lang in ("de", "en")} <= set(model["words"])


def test_unseen_words_fall_back(labelled):
    model = language_id.fit(labelled, max_words=5)
    out = language_id.predict(labelled, model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) >= 0.9


def test_scorer_is_the_plain_definition(labelled):
    """Batch scores equal those of one word at a time by the written rule."""
    model = language_id.fit(labelled, max_words=40)
    scorer = language_id.Scorer(model)
    words = [*list(model["words"])[:5], "sching", "theung", "ouse", "日", "q", "zzzz"]
    for w, got in zip(words, scorer.score(words), strict=True):
        freq = model["words"].get(w)
        if freq is None:
            for n in (4, 3, 2, 1):
                known = [model["grams"][n, g] for g in language_id.grams(w, n) if (n, g) in model["grams"]]
                if known:
                    freq = np.mean(np.array(known, float), axis=0)
                    break
        want = np.zeros(len(model["langs"])) if freq is None else np.asarray(freq, float) - np.log(np.exp(np.asarray(freq, float)).sum())
        assert np.allclose(got, want, atol=1e-5)


def test_language_edge_cases(spark, labelled):
    model = language_id.fit(labelled)
    rows = [(1, None), (2, ""), (3, "12 %% 34"), (None, "the and of"), (4, "the and of\n\tder"), (5, "the " * 50000), (5, "und der")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "lang_pred", "score", "lang")
    out = language_id.predict(df, model, df.columns)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == (None, "en") and got[5] == (5, "en") and got[6] == (5, "de")
    assert language_id.predict(df.limit(0), model, ["doc_id"]).collect() == []
    none = language_id.fit(labelled.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(df, none, ["doc_id"]).collect()} == {"und"}


@pytest.fixture(scope="module")
def judged(spark):
    import random
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(600):
        w = sentence(rng, "en", rng.randint(20, 80)).split()
        good = i % 3 > 0
        if not good:
            w = [x for x in w[:8] for _ in range(9)] if i % 2 else [x + "%%%" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(judged):
    docs, labels = judged
    model = quality.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    out = quality.score(docs.where(remainder("doc_id", 5) == 0), model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in out]) >= 0.95
    assert np.mean([(r["score"] - r["quality"]) ** 2 for r in out]) < 0.1


def test_quality_is_reproducible(judged):
    docs, labels = judged
    a, b = (quality.fit(d, labels) for d in (docs, docs.repartition(3)))
    assert a.vocabulary == b.vocabulary and np.array_equal(a.vectors, b.vectors) and all(np.array_equal(x, y) for x, y in zip(a.layers, b.layers, strict=True))


def test_context_sums_are_those_of_neighbours():
    ids, offsets, n = np.array([0, 1, 2, 1, 3]), np.array([0, 3, 3, 5]), 4
    place, sign = quality.index_vectors(n)
    index = np.zeros((n, quality.DIM))
    for t in range(n):
        np.add.at(index[t], place[t], sign[t])
    want = np.zeros((n, quality.DIM))
    for a, b in ((0, 3), (3, 5)):
        for i in range(a, b):
            for j in range(a, b):
                if 0 < abs(i - j) <= quality.WINDOW:
                    want[ids[i]] += index[ids[j]]
    assert np.allclose(quality.context_sums(ids, offsets, n), want)


def test_quality_edge_cases(spark, judged):
    docs, labels = judged
    odd = clashing(spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "w " * 100000), (3, "日本 %%")], "doc_id long, text string"), "score", "y", "x", "label", "quality")
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (5, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int"))
    model = quality.fit(docs, more)
    out = quality.score(odd, model).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out) and out[0]["score"] == out[1]["score"]
    assert quality.score(odd.limit(0), model).collect() == []
    same = quality.fit(docs, labels.withColumn("quality", F.lit(1)))
    assert {r["score"] for r in quality.score(odd, same).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_number_signs_are_no_letters(spark, labelled):
    model = language_id.fit(labelled)
    rows = [(1, "\u00bd \u00b2"), (2, "m\u00b2 of the"), (3, "\u2460\u3289 12 \U0001f101"), (4, "\u2167"), (5, None), (6, "\u65e5\u672c")]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id"]).collect()}
    for i, text in rows:
        letters = any(c.isalpha() for c in text or "")
        assert (out[i][0] != "und") == letters, (i, out[i])
