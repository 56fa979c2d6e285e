import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import clashing, sentence

from curata.llm import lm_scoring as L
from curata.llm.common import remainder

SCHEMA = "doc_id long, text string"


def training():
    return F.coalesce(remainder("doc_id", 7) != 2, F.lit(True))


def tokens(text):
    return re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def plain(rows, least=2):
    """The definition with exact counts, one token at a time."""
    grams = Counter()
    for i, text in rows:
        if i is not None and not held_out(i):
            seq = ["<"] + tokens(text)
            grams.update(tuple(seq[j - k + 1:j + 1]) for k in (1, 2, 3) for j in range(k - 1, len(seq)))
    begins = grams.get(("<",), 0)
    words = {g[0]: c for g, c in grams.items() if len(g) == 1 and g != ("<",)}
    n, v = sum(words.values()), len(words)

    def middle(g):
        c = grams.get(g, 0)
        if len(g) > 1 and c < least:
            return 0.0
        return (3 * 2 ** (c.bit_length() - 1) - 1) / 2 if c else 0.0

    out = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in own)
        seq, score = ["<"] + own, 0.0
        for j in range(1, len(seq)):
            p = (middle((seq[j],)) + 1) / (n + v + 1)
            for k in (2, 3):
                if j >= k - 1:
                    g = tuple(seq[j - k + 1:j + 1])
                    context = middle(g[:-1])
                    p = (min(middle(g), context) + L.WEIGHT * p) / (context + L.WEIGHT)
            score += math.log10(min(p, 1.0))
        out.append((i, held_out(i), len(own), sum(w in words for w in own), n, base, score))
    assert begins or not words
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0], r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9), g[0]


@pytest.fixture(scope="module")
def rows(corpus):
    return [(r[0], r[1]) for r in corpus] + [(None, "the the ing"), (None, None), (5, "again again"), (5, "again again")]


@pytest.mark.parametrize("head, shard_bytes", [(L.HEAD, L.SHARD_BYTES), (3, 900), (0, 1)])
def test_equals_the_definition(spark, rows, head, shard_bytes):
    """With so many bits that no probe errs; few words sent, and the filter in shards."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(L.score_texts(df, training(), head, shard_bytes, bits_per_key=400).collect(), plain(rows))


def test_the_query_learns_ngrams_that_occur_once(spark, rows, tmp_path):
    from curata.llm.queries import op13_lm_scoring

    df = spark.createDataFrame(rows, SCHEMA)
    same(L.score_texts(df, training(), bits_per_key=400, least=1).collect(), plain(rows, 1))
    spare = [i for i in range(30_000, 40_000)]
    learned, out = next(i for i in spare if not held_out(i)), next(i for i in spare if held_out(i))
    text = " ".join(f"once{i}" for i in range(40))
    rows = rows + [(learned, text), (out, text)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in op13_lm_scoring(spark, str(tmp_path)).where(F.col("doc_id").isin(learned, out)).collect()}
    want = {r[0]: r[6] for r in plain(rows, 1) if r[0] == out}
    assert got[out] == got[learned] == pytest.approx(want[out], rel=0.02)


def test_flushes_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "FLUSH", 100)
    same(L.score_texts(spark.createDataFrame(rows, SCHEMA), training(), bits_per_key=400).collect(), plain(rows))


def test_filter_errs_on_the_high_side_only(spark, rows):
    got = {(r["doc_id"], r["n_tokens"], round(r["base_score"], 6)): r["score"] for r in L.score_texts(spark.createDataFrame(rows, SCHEMA), training()).collect()}
    want = {(r[0], r[2], round(r[5], 6)): r[6] for r in plain(rows)}
    off = [abs(got[k] - want[k]) / abs(want[k]) for k in want]
    assert np.mean(off) < 0.02


def test_held_out_texts_beat_the_base_and_shuffled_words(spark):
    """Sentences of a small grammar: word order matters."""
    rng = random.Random(3)
    follow = {w: [rng.randrange(60) for _ in range(3)] for w in range(60)}

    def text():
        w, out = rng.randrange(60), []
        for _ in range(40):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return out

    own = [text() for _ in range(600)]
    mixed = [rng.sample(t, len(t)) for t in own[:150]]
    rows = [(i, " ".join(t)) for i, t in enumerate(own)]
    ids = [i for i in range(10_000, 20_000) if held_out(i)][:150]
    rows += [(i, " ".join(t)) for i, t in zip(ids, mixed)]
    got = {r["doc_id"]: r for r in L.score_texts(spark.createDataFrame(rows, SCHEMA), training()).collect()}
    out = [got[i] for i in range(600) if held_out(i)]
    assert np.mean([r["score"] / r["n_tokens"] for r in out]) > np.mean([r["base_score"] / r["n_tokens"] for r in out]) + 0.5
    assert np.mean([got[i]["score"] for i in ids]) < np.mean([r["score"] for r in out]) - 20


def test_empty_tables_nothing_learned_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.score_texts(empty, training()).collect() == []
    none = L.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), F.lit(False)).collect()
    assert sorted(map(tuple, none)) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "word", "c", "row", "levels", "score", "rare", "n_tokens")
    assert sorted(r[2] for r in L.score_texts(df, training()).collect()) == sorted(len(tokens(t)) for _, t in rows)


def test_levels_grow_with_counts():
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 2**40])
    assert L.level_of(counts).tolist() == [0, 1, 2, 2, 3, 3, 4, 41]
    assert L.count_of(L.level_of(counts))[:7].tolist() == [0, 1, 2.5, 2.5, 5.5, 5.5, 11.5]


def test_a_larger_filter_takes_no_more_tables_and_no_broadcast(spark, rows, monkeypatch):
    """Documents go through a fixed number of steps, whatever the filter's size."""
    names, own = [], L.written
    monkeypatch.setattr(L, "written", lambda df, name: (names.append(name), own(df, name))[1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: pytest.fail("broadcast"))
    L.score_texts(spark.createDataFrame(rows, SCHEMA), training(), shard_bytes=1, bits_per_key=400)
    assert names == ["chunks", "answers"]


def test_what_was_asked_goes_from_disk_once_answered(spark, rows, monkeypatch):
    """Without waiting for the driver to collect garbage; the setting is the session's own again after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    left, own, before = {}, L.written, spark.conf.get(key, None)

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    def written(df, name):
        there = shuffled()
        out, until = own(df, name), time.time() + 10
        while (new := shuffled() - there) and time.time() < until:
            time.sleep(0.1)
        left[name] = new
        return out

    monkeypatch.setattr(L, "written", written)
    L.score_texts(spark.createDataFrame(rows, SCHEMA), training())
    assert left == {"chunks": set(), "answers": set()}
    assert spark.conf.get(key, None) == before


def test_counts_of_more_than_a_byte(spark, rows):
    rows = rows + [(1, "x y " * 400), (2, None), (3, "z"), (4, "x y " * 200)]
    same(L.score_texts(spark.createDataFrame(rows, SCHEMA), training(), bits_per_key=400, least=1).collect(), plain(rows, 1))


@pytest.mark.parametrize("kind, most", [("u4", 2**32 - 1), ("u8", 2**64 - 1)])
def test_packed_keys_come_back(kind, most):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2000):
        cuts = np.sort(np.concatenate([[0, n], rng.integers(0, n + 1, 5)]))
        keys = rng.integers(0, most, n, kind, endpoint=True)
        for a, b in zip(cuts, cuts[1:]):
            keys[a:b].sort()
        got, back = L.unpacked_runs(L.packed_runs(keys, cuts).to_pylist(), keys.itemsize)
        assert got.tolist() == keys.tolist() and back.tolist() == cuts.tolist()
