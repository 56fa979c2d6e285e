import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import clashing

from curata.llm import bloom, collocations as C, packed as P, quotient_filter as Q

SCHEMA = "text string, lang string"


def plain(rows, least, longest, absorbed, top):
    """The definition, one phrase at a time."""
    f, n = {}, Counter()
    for text, lang in rows:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            own.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q for p, b in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i:i + k]] if 100 * b >= absorbed * cand[q]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, _, l, r = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(corpus):
    own = [(r[1], r[2]) for r in corpus]
    return own + [("New York, new york! NEW YORK\nnew\tyork  city; new york city. new york city", None)] * 3 + [("a, b", "en"), (". . ,", "en"), (None, None), ("É é e", "fr")]


@pytest.mark.parametrize("least, longest, absorbed, top", [(2, 3, 50, 2000), (3, 4, 80, 15), (2, 2, 50, 7)])
def test_equals_the_definition(spark, rows, monkeypatch, least, longest, absorbed, top):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, C.collocations(df, least, longest, absorbed, top).collect()))
    assert got == plain(rows, least, longest, absorbed, top) and got


def test_small_filters_and_flushes_change_nothing(spark, rows, monkeypatch):
    """Full Bloom filters let rare n-grams pass, and many filters are merged."""
    for name, value in (("MOST_FILTER_BITS", 64), ("FLUSH", 50), ("HELD_WORDS", 20), ("SALTS", 2)):
        monkeypatch.setattr(C, name, value)
    got = sorted(map(tuple, C.collocations(spark.createDataFrame(rows, SCHEMA), 2, 3).collect()))
    assert got == plain(rows, 2, 3, 50, 2000)


def test_a_shared_id_takes_another_hash(spark, rows, monkeypatch):
    tried = []
    counted = C.word_counts

    def first_collides(docs, seed):
        from pyspark.sql import functions as F
        tried.append(seed)
        return counted(docs, seed) if seed else counted(docs, seed).withColumn("id", F.col("id") % 5)

    monkeypatch.setattr(C, "word_counts", first_collides)
    words, seed = C.words_with_ids(spark.createDataFrame(rows, SCHEMA))
    assert tried == [0, 1] and seed == 1 and words.count() == words.select("id").distinct().count()


def test_counts_beyond_64_bit_products(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    big = 3_000_000_017
    words = spark.createDataFrame([(1, "en", "x", big), (2, "en", "y", big + 6), (3, "en", "z", 12)], "id long, lang string, word string, n long")
    levels = [words.selectExpr("id as w0", "n as a"), spark.createDataFrame([(1, 2, big - 4)], "w0 long, w1 long, a long")]
    monkeypatch.setattr(C, "frequent_phrases", lambda *a: (words, levels))
    r = C.collocations(None, longest=2).collect()[0]
    assert r["score"] == 1_000_000 * (big - 4) ** 2 // (big * (big + 6)) and r["n"] == 2 * big + 18


def test_empty_tables_and_clashing_columns(spark, rows):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    df = clashing(spark.createDataFrame(rows, SCHEMA), "word", "id", "n", "a", "w0", "rank", "phrase", "segment")
    assert sorted(map(tuple, C.collocations(df, 2).collect())) == plain(rows, 2, 3, 50, 2000)


@pytest.mark.parametrize("width", [2, 3, 4])
@pytest.mark.parametrize("segment_bits", [4, 17])
def test_filters_count_without_error(width, segment_bits):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 12, (width, 4000)).astype(P.U) * P.U(0x9E3779B97F4A7C15)
    assert all((a == b).all() for a, b in zip(Q.restore(Q.permute(list(ids))), ids))
    blobs: dict[int, list[bytes]] = {}
    for cut in (ids[:, :900], ids[:, 900:], ids[:, :1], np.repeat(ids[:, :1], 700, axis=1)):
        lanes, counts = Q.counted(Q.permute(list(cut)))
        segment = (lanes[0] >> P.U(64 - segment_bits)).astype(np.int64)
        for s in np.unique(segment).tolist():
            at = segment == s
            blobs.setdefault(s, []).append(Q.encode([x[at] for x in lanes], counts[at], s, segment_bits))
    got = Counter()
    for s, own in blobs.items():
        lanes, counts = Q.merge(own, width, s, segment_bits)
        got.update(dict(zip(zip(*(x.tolist() for x in Q.restore(lanes))), counts.tolist())))
    want = Counter(zip(*ids.tolist()))
    want[tuple(ids[:, 0].tolist())] += 701
    assert got == want


def test_keys_that_share_a_first_id_are_told_apart():
    lanes = [np.array([7, 7, 7, 7], P.U), np.array([1, 2, 1, 2], P.U)]
    keys, counts = Q.counted(lanes)
    assert [k.tolist() for k in keys] == [[7, 7], [1, 2]] and counts.tolist() == [2, 2]


def test_bloom_loses_no_key(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 300_000)
    for most, rate in ((1 << 27, 0.01), (1 << 16, 1.0)):
        found = bloom.build(spark.createDataFrame([(int(k),) for k in keys[:20_000]], "key long"), 20_000, most)
        u = keys.view(P.U)
        hit = found.has(u, bloom.block_of(u, len(found.bits)))
        assert hit[:20_000].all() and hit[20_000:].mean() <= rate
    many = bloom.Blocks(np.array([64, 0]), [bloom.bitmap(u[:3], 64).tobytes(), b""])
    assert not many.has(u[:5], np.ones(5, np.int64)).any()
