"""Most frequent values by sketch, buckets and hashes against plain counting."""

import random

import pytest
from pyspark.sql import functions as F

from curata.operators import fit, heavy
from curata.operators.summary import categorical_summary


def brute(cells, k):
    counts = {}
    for v in cells:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    key = (lambda e: (-e[1], e[0].encode())) if any(isinstance(v, str) for v in counts) else (lambda e: (-e[1], e[0]))
    return sorted(counts.items(), key=key)[:k]


def columns():
    rnd = random.Random(5)
    n = 600
    distinct = [f"text {i:04d} é" for i in rnd.sample(range(n), n)]
    hot = ["hot" if i % 3 == 0 else f"v{i}" for i in range(n)]
    ties = [f"pair {i % 300:03d}" for i in range(n)]
    pairs = [f"x{i}" for i in range(n - 4)] + ["x7", "x9", "x7", "x9"]
    few = [rnd.choice(["a", "b", "c"]) for _ in range(n)]
    holes = [None if i % 2 else f"h{i % 50:02d}" for i in range(n)]
    numbers = [rnd.choice([10, 2, -3, 44]) for _ in range(n)]
    return {"distinct_": distinct, "hot": hot, "ties": ties, "pairs": pairs, "few": few, "holes": holes,
            "empty": [None] * n, "numbers": numbers}


@pytest.fixture(scope="module")
def table(spark):
    cols = columns()
    schema = ", ".join(f"{c} {'int' if c == 'numbers' else 'string'}" for c in cols)
    return spark.createDataFrame(list(zip(*cols.values())), schema).repartition(5).cache(), cols


@pytest.mark.parametrize("k,tracked,buckets", [(1, 16, 8), (3, 4096, 16_384), (7, 8, 1)])
def test_equals_plain_counts(table, k, tracked, buckets):
    df, cols = table
    got = heavy.top_values(df, {c: F.col(c) for c in cols}, k, tracked, buckets)
    assert got == {c: brute(v, k) for c, v in cols.items()}


def test_many_ties_are_counted_as_values(table, monkeypatch):
    df, cols = table
    monkeypatch.setattr(heavy, "BROADCAST_ROWS", 10)
    assert heavy.top_values(df, {"ties": F.col("ties")}, 3, 8, 4)["ties"] == brute(cols["ties"], 3)


@pytest.mark.parametrize("k", [1, 4, 60])
def test_equal_hashes_change_nothing(table, monkeypatch, k):
    """A hash of three values only: every count by hash is far too high."""
    df, cols = table
    monkeypatch.setattr(heavy, "_hash", lambda v, t: F.when(v.isNotNull(), F.pmod(F.xxhash64(v), F.lit(3))))
    names = ["distinct_", "hot", "pairs", "numbers"]
    assert heavy.top_values(df, {c: F.col(c) for c in names}, k, 64, 2) == {c: brute(cols[c], k) for c in names}


def test_empty_table_and_zero(spark, table):
    none = spark.createDataFrame([], "a string, b double")
    assert heavy.top_values(none, {"a": F.col("a"), "b": F.col("b")}, 2) == {"a": [], "b": []}
    assert heavy.top_values(table[0], {}, 2) == {}
    signs = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double")
    assert heavy.top_values(signs, {"x": F.col("x")}, 1, 8, 4)["x"][0][1] == 2


def test_a_value_that_stands_out_needs_no_counting_by_hash(spark, monkeypatch):
    """200 copies among 20,000 distinct texts: no bucket reaches the candidate."""
    df = spark.range(20_200).select(F.when(F.col("id") < 200, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("t"))
    kept = []
    monkeypatch.setattr(heavy, "materialize", lambda *a, **k: kept.append(a))
    assert heavy.top_values(df, {"t": F.col("t")}, 1)["t"] == [("copy", 200)]
    assert not kept


def test_modes_and_top_categories(table, monkeypatch):
    df, cols = table
    names = ["distinct_", "hot", "ties", "few", "holes"]
    plain = fit.column_modes(df, names)
    monkeypatch.setattr(fit, "SKETCH_VALUES", 20)
    assert fit.column_modes(df, names) == plain == {c: brute(cols[c], 1)[0][0] for c in names}
    for c in ("hot", "holes", "distinct_"):
        a = categorical_summary(df, c, top_n=4)
        b = categorical_summary(df, c, top_n=4, sketch=True)
        assert a.schema.names == b.schema.names and a.collect() == b.collect()
