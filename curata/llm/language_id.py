"""Language identification by word-first backoff.

Model: for every language the log frequency of its words, and of character
n-grams of 4, 3, 2 and 1 letters of ``^word$``. A known word is scored by its
own log frequencies. An unseen word falls back to its 4-grams; if none of them
is known, to its 3-grams, and so on down to single letters. What a word says
is turned into log posteriors over the languages, and these are added over all
words of the whole text.

The model is fitted on a bounded sample of labelled rows: about
``rows_per_language`` rows of each language, chosen by a hash of the id, with
at most ``max_words`` words and ``max_grams`` n-grams kept (the most frequent,
ties by the string). That bound is what makes it safe to send to every task.

Edge cases: a null text or one without a letter gives ``und`` with score 0; a
null id is never held out and never learned from; without any labelled row
every text is ``und``; ties between languages go to the first by name.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import chunks, give_back, segment_sums, split_words, texts_of, written

UNKNOWN = "und"
#: Characters that \w takes but that are neither letters nor decimal digits (number signs).
_SIGNS = "".join(c for c in map(chr, range(0x3200)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(rf"[^\W\d_{re.escape(_SIGNS)}]+")
GRAMS = (4, 3, 2, 1)
ROWS_PER_LANGUAGE = 3000
MAX_WORDS = 120_000
MAX_GRAMS = 60_000
#: Words that a task remembers the score of.
MEMO = 150_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word with its ends marked; for n = 1 its letters."""
    s = word if n == 1 else f"^{word}$"
    return [s[i:i + n] for i in range(len(s) - n + 1)]


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS, min_count: int = 2) -> dict:
    """Model from rows (doc_id, text, lang), none of them null."""
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    per = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not per:
        return {"langs": [], "words": {}, "grams": {}}
    share = F.lit(0.0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows_per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).select("text", "lang")

    def count(frames):
        total: dict[str, list[Counter]] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                total.setdefault(lang, [Counter() for _ in range(5)])[0].update(WORD.findall(text.lower()))
        for lang, counters in total.items():
            for word, k in counters[0].items():
                for n in GRAMS:
                    for g in grams(word, n):
                        counters[n][g] += k
            for n, counter in enumerate(counters):
                yield pd.DataFrame({"lang": lang, "n": n, "gram": list(counter), "k": list(counter.values())})

    counted = sample.mapInPandas(count, "lang string, n int, gram string, k long").groupBy("n", "gram", "lang").agg(F.sum("k").alias("k"))
    counted = written(counted, "grams")
    by_gram = counted.groupBy("n", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "k"))).alias("by"), F.sum("k").alias("k"))
    by_gram = by_gram.where(F.col("k") >= min_count)
    kept = []
    for cond, most in ((F.col("n") == 0, max_words), (F.col("n") > 0, max_grams)):
        kept += by_gram.where(cond).orderBy(F.desc("k"), "n", "gram").limit(most).collect()
    langs = sorted(per)
    totals = np.ones((5, len(langs)))
    for r in kept:
        totals[r["n"]] += [r["by"].get(x, 0) for x in langs]
    model: dict = {"langs": langs, "words": {}, "grams": {}}
    for r in kept:
        freq = np.log((np.array([r["by"].get(x, 0) for x in langs]) + 0.05) / totals[r["n"]])
        (model["grams"] if r["n"] else model["words"])[r["gram"] if not r["n"] else (r["n"], r["gram"])] = freq.astype(np.float32)
    return model


def _posteriors(frequencies: np.ndarray) -> np.ndarray:
    """Log posteriors of the languages from rows of log frequencies."""
    x = frequencies - frequencies.max(axis=1, keepdims=True, initial=-np.inf)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Scorer:
    """Scores of words by a model, kept for words seen before."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        n = len(self.langs)
        self.words = {w: i for i, w in enumerate(model["words"])}
        self.word_rows = _posteriors(np.array(list(model["words"].values()), np.float64).reshape(-1, max(n, 1)))[:, :n]
        self.grams = {g: i for i, g in enumerate(model["grams"])}
        self.gram_rows = np.array(list(model["grams"].values()), np.float64).reshape(-1, max(n, 1))[:, :n]
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def backed_off(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word that are known."""
        for n in GRAMS:
            if found := [i for g in grams(word, n) if (i := self.grams.get((n, g))) is not None]:
                return found
        return []

    def score(self, letters: list[str]) -> np.ndarray:
        """Log posteriors of each word; zeros where nothing is known."""
        out = np.zeros((len(letters), len(self.langs)))
        known = [self.words.get(w, -1) for w in letters]
        at = np.array(known, np.int64)
        out[at >= 0] = self.word_rows[at[at >= 0]]
        unseen = [(i, f) for i, k in enumerate(known) if k < 0 and (f := self.backed_off(letters[i]))]
        if unseen:
            size = np.array([len(f) for _, f in unseen])
            flat = self.gram_rows[np.array([x for _, f in unseen for x in f])]
            mean = np.add.reduceat(flat, np.cumsum(size) - size, axis=0) / size[:, None]
            out[[i for i, _ in unseen]] = _posteriors(mean)
        return out

    @staticmethod
    def letters_of(word: str) -> list[str]:
        """Runs of letters of a string; number signs beyond the basic planes
        are few and tested apart."""
        return [x for x in WORD.findall(word.lower()) if x.isascii() or any(map(str.isalpha, x))]

    def of(self, words: list[str]) -> np.ndarray:
        """For each string the summed log posteriors of its words, and their number."""
        if len(self.place) > MEMO:
            self.place, self.rows = {}, []
        place = self.place
        if new := [w for w in words if w not in place]:
            letters = [self.letters_of(w) for w in new]
            size = np.array([len(x) for x in letters])
            total = segment_sums(self.score([x for own in letters for x in own]), np.concatenate([[0], np.cumsum(size)]))
            self.place.update(zip(new, range(len(place), len(place) + len(new))))
            self.rows.append(np.column_stack([total, size]))
        table = np.concatenate(self.rows) if len(self.rows) != 1 else self.rows[0]
        self.rows = [table]
        return table[[place[w] for w in words]]


def predict_texts(texts: pa.Array, scorer: Scorer) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs = scorer.langs
    words, codes, offsets = split_words(texts)
    if not len(codes):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sums = segment_sums(scorer.of(words)[codes], offsets)
    n = np.rint(sums[:, -1])
    if not langs:
        return [UNKNOWN] * len(n), np.zeros(len(n))
    # Words of one text are not independent: their sum counts as that of sqrt(n) words.
    z = sums[:, :-1] / np.sqrt(np.maximum(n, 1))[:, None]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], np.where(n > 0, p[np.arange(len(n)), best], 0.0)


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the documents with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by max_words and max_grams
    kept = [k for k in keep if k not in ("lang_pred", "score")]
    text = "text" if "text" in kept else "_curata_text"  # a kept text travels once
    rows = docs.select(*kept) if text == "text" else docs.select(*kept, F.col("text").alias(text))
    schema = rows.drop("_curata_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            for part in chunks(batch, text):
                lang, score = predict_texts(texts_of(part, text), scorer)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(lang, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])
        del scorer
        give_back()

    return rows.mapInArrow(run, schema)
