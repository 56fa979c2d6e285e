import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import clashing

from curata.llm.mih_search import Index, codes, hamming, search, substring_radii


def brute_force(rows, is_query, k):
    n = max((len(v) for _, v in rows if v), key=[len(v) for _, v in rows if v].count, default=0)
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == n and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if is_query(i):
            found = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in good if j != i)
            out[i] = [j for _, j in found[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 32))
    x = (centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 32))).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    out = search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    want = brute_force(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in out:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert abs(r["score"] - float(np.dot(x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)))) < 1e-9
    recall = np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()])
    assert set(got) == set(want) and recall >= 0.9


def test_outliers_of_tight_clusters_get_full_answers(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 3000)] + 0.001 * rng.standard_normal((3000, 32))
    x[::100] = rng.standard_normal((30, 32))  # every fifth query
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(search(df, F.col("vec_id") % 20 == 0, k=20))
    assert set(got) == set(range(0, 3000, 20)) and {len(set(a) - {q}) for q, a in got.items()} == {20}


def test_bad_vectors_ties_copies_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, [0.0, 0.0]), (6, None), (7, []),
            (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, [0.0, 0.0]), (80, [-1.0, -0.0])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "code", "ids", "rank", "b", "q")
    got = answers(search(df, F.col("vec_id") % 20 == 0, k=3))
    assert got == brute_force(rows, lambda i: i % 20 == 0, 3)
    assert got[0] == [3, 20, 40] and got[40] == [0, 3, 20]


def test_fewer_candidates_than_k_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert answers(search(df, F.col("vec_id") == 0, k=5)) == {0: [1]}
    assert search(df, F.col("vec_id") == 7).collect() == []
    assert search(df.limit(0), F.col("vec_id") == 0).collect() == []
    alone = df.where("vec_id = 0")
    assert search(alone, F.col("vec_id") == 0).collect() == []


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 32))
    c = codes(x, np.linalg.qr(rng.standard_normal((32, 32)))[0])
    index = Index(c)
    for radius in (0, 3, 8, 13, 32):
        want = hamming(c[:40], c) <= radius
        for q, near in zip(c[:40], want, strict=True):
            assert (index.within(q, radius) == np.flatnonzero(near)).all()
        radii = substring_radii(radius, 4)
        assert sum(r + 1 for r in radii) == radius + 1


def test_distances_only_for_what_the_tables_return():
    rng = np.random.default_rng(4)
    c = rng.integers(0, 256, (4000, 8), np.uint8)
    c[2000:] = c[:2000] ^ np.packbits(rng.random((2000, 64)) < 0.05, axis=1)
    index = Index(c)
    met = sum(len(index.retrieved(q, 8)) for q in c[:100])
    near = sum(len(index.within(q, 8)) for q in c[:100])
    # eight substrings of eight bits, one of them to radius 1: about 16 of 256 values meet
    assert near >= 190 and met < 0.1 * 100 * len(c)


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], np.array(r[1], float)) for r in df.select("vec_id", "embedding").collect() if r[1]]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = answers(search(df, F.col("vec_id") % 20 == 0))
    found = []
    for i, v in rows:
        if i % 20 == 0:
            s = x @ v
            s[ids == i] = -np.inf
            found.append(len(set(ids[np.argsort(-s)[:20]].tolist()) & set(got[i])) / 20)
    assert len(found) == len(got) and np.mean(found) >= 0.9
