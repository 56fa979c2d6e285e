from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import clashing

from curata.llm import packed
from curata.llm.components import components
from curata.llm.ngram_join import Bloom, join_documents, shingle_sets

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and sets[i][0] is not None and sets[j][0] is not None:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), None if d is None else least[find(i)]) for i, (d, s) in enumerate(sets))


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def test_same_as_all_pairs(spark, docs, corpus):
    assert found(join_documents(docs)) == brute_force([r[:2] for r in corpus])


def test_null_ids_repeats_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base), (5, base), (3, base + " more"), (None, base), (None, None), (9, None), (9, "quite another text of some words"),
            (8, "quite another text of some words"), (2, None), (9, base.replace("w0", "v0")),
            (-1, " ".join(f"z{i}" for i in range(30))), (0, " ".join(f"z{i}" for i in range(30))), (-2**63, "lone words of the smallest id there is")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "component_id", "n_shingles", "node", "place", "a")
    assert found(join_documents(df)) == brute_force(rows)


def test_empty_table(no_docs):
    assert join_documents(no_docs).collect() == []


def test_large_group_of_near_copies_stays_linear(spark):
    """Every copy has words of its own; all are one component."""
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1:])) for i in range(150) for k in [(37 * i) % 200]]
    got = join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 150


def test_shingle_sets_match_words():
    texts = ["", "a B c", "a b C", "a b c d e f", "A b c d e  f\n", "x x x x x x x x", "é É b c d e f"]
    hashes, at = shingle_sets(pa.array(texts, pa.large_string()))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[1] == sets[2] and sets[3] == sets[4] and not sets[1] & sets[3]


def test_hashes_do_not_depend_on_the_chunk():
    texts = [" ".join(f"word{i}" for i in range(n)) for n in (3, 50, 7)]
    one = [shingle_sets(pa.array([t], pa.large_string()))[0].tolist() for t in texts]
    hashes, at = shingle_sets(pa.array(texts, pa.large_string()))
    assert one == [hashes[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.choice(np.array([-2**63, -5, 0, 1, 2, 300, 2**62, 2**63 - 1]), n)
    a, b = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 9, n).astype(np.uint32)
    got = packed.unpack(packed.pack(ids, a, b), np.uint64, np.uint32)
    assert sorted(zip(ids, a, b, strict=True)) == sorted(zip(*got, strict=True))


def test_xxhash64_is_that_of_spark(spark):
    ids = [0, 1, -1, 42, 2**62, -2**63, 2**63 - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("xxhash64(i) as h").collect()
    assert [r["h"] for r in got] == packed.xxhash64(np.array(ids)).tolist()


def test_bloom_filter_has_no_false_miss(spark):
    ids = [1, 2, 77, -4, 2**60]
    bloom = Bloom.of(spark.createDataFrame([(i,) for i in ids], "i long"), "i", 1 << 12)
    assert bloom.has(np.array(ids)).all()
    assert bloom.has(np.arange(1000, 2000)).mean() < 0.1


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 29)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_plan_has_no_cross_join(docs):
    plan = partial(join_documents, docs)()._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


@pytest.mark.parametrize("places, n", [([], 99), ([3, 1, 3], 4), ([5], 1000), ([7, 70000, 7], 80000)])
def test_dealt(places, n):
    got = {k: i.tolist() for k, i in packed.dealt(np.array(places, np.int64), n)}
    assert got == {k: [i for i, p in enumerate(places) if p == k] for k in places}
