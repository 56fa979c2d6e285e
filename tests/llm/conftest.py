import random

import pytest

LANGS = {
    "en": ["the", "of", "and", "ing", "tion", "ther", "wh", "ouse", "ly", "st"],
    "de": ["der", "und", "ung", "sch", "ich", "keit", "ein", "zu", "ber", "au"],
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared
    passages, short, empty, null and long texts."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.choice(["en", "de"]), rng.randint(30, 120)) for _ in range(60)]
    passage = sentence(rng, "en", 50)
    texts += [texts[0], texts[0].upper(), texts[1] + " extra words here", "  " + texts[2].replace(" ", "\t\n ", 3) + "\n"]
    for k in range(12):  # a chain of near copies, each a little different from the one before
        w = texts[3].split()
        w[:k] = [f"new{i}" for i in range(k)]
        texts.append(" ".join(w))
    for k in range(10):
        own = sentence(rng, "de", 60).split()
        texts.append(" ".join(own[:30] + passage.split() + own[30:]))
    texts += ["", None, "one", "one two three", "one two three", "ONE Two three", " \n\t ", "a b c d e", "a b c d e f", "x " * 40, "x " * 40,
              sentence(rng, "en", 3000), "Ünïcode wörds — “quoted” 日本語 é   end", "line\x0bone\x0ctwo\x1cthree four five six seven"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((7 * i % 211, t, "de" if i % 3 == 0 else "en", f"src{i % 4}", None if t is None else len(t)))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df, *names):
    """The rows with extra columns of these names."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("own").alias(n) for n in names))
