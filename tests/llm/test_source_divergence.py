import re
from collections import Counter

import pytest
from tests.llm.conftest import clashing

from curata.llm import source_divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_df, top):
    """The definition, one group and term at a time."""
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    docs = [(lang, s, re.findall(D.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t))) for t, lang, s in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        df = Counter(t for x, _, ts in docs if x == lang for t in set(ts))
        kept = [t for t, n in df.items() if n >= min_df]
        count = {s: Counter(t for x, y, ts in docs if (x, y) == (lang, s) for t in ts) for x, s, _ in docs if x == lang}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + D.SCALE * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows(corpus):
    own = [(r[0], r[1], r[2], r[3]) for r in corpus]
    return own + [(900, "Été ÉTÉ été ete 12été_b", "fr", "a"), (901, "été É", "fr", "b"), (902, None, "fr", "c"), (903, "été", None, None),
                  (904, "of of of", None, "x"), (904, "of of of", None, "x"), (905, "alone", "zz", "only"), (906, "", "yy", "s1"), (907, "rare", "yy", "s2")]


@pytest.mark.parametrize("min_df", [2, 4])
def test_equals_the_definition(spark, rows, min_df):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, D.divergence(df, min_df=min_df, top_terms=5).collect()))
    assert got == plain(rows, min_df, 5)
    assert any(r[0] == "yy" and r[4] == 0 for r in got)  # no kept term: pairs with value 0


def test_blocks_of_the_vocabulary_change_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, D.divergence(df, min_df=2).collect()))
    fits = []
    fit = D.count_vectors
    monkeypatch.setattr(D, "count_vectors", lambda *a: fits.append(1) or fit(*a))
    assert sorted(map(tuple, D.divergence(df, min_df=2, block_terms=300).collect())) == whole
    assert len(fits) > 1


def test_many_pairs_in_small_steps(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 23}") for i, t, _, _ in rows], SCHEMA)
    assert sorted(map(tuple, D.divergence(df, min_df=3).collect())) == plain([(i, t, "en", f"s{i % 23}") for i, t, _, _ in rows], 3, 10)


def test_pairs_of_a_term_are_cut(monkeypatch):
    import pyarrow as pa

    rows = [{"block": t // 4, "idx": t % 4, "gid": g, "p": 5 * g + t + 1, "p0": g + 1} for t in range(7) for g in range(9)]
    batch = pa.RecordBatch.from_pylist(rows)

    def summed(step):
        total = Counter()
        for b in D._both_used(batch.slice(i, step) for i in range(0, len(batch), step)):
            for r in b.to_pylist():
                total[r["gid"], r["other"]] += r["value"]
        return total

    whole = summed(100)
    assert summed(4) == whole and len(whole) == 72
    monkeypatch.setattr(D, "PAIRS", 5)
    assert summed(100) == summed(10) == whole


def test_empty_tables_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.divergence(empty).collect() == []
    df = clashing(spark.createDataFrame(rows[:30], SCHEMA), "terms", "vec", "term", "part", "p", "gid", "block", "idx", "count", "n", "v", "rank", "value")
    assert sorted(map(tuple, D.divergence(df, min_df=2).collect())) == plain(rows[:30], 2, 10)


def test_rows_of_a_share_hold_its_counts_and_document_frequencies(monkeypatch):
    import pyarrow as pa

    docs = [(1, "en", "a a a b"), (2, "en", "a c"), (1, "en", "a b"), (3, "de", "a"), (3, "de", None), (2, "en", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)))]
    gid, lang, text = zip(*docs, strict=True)
    share = pa.RecordBatch.from_arrays([pa.array(gid), pa.array(lang), pa.array(text, pa.string())], ["gid", "lang", "text"])
    counts, frequencies = Counter(), Counter()
    for g, x, t in docs:
        counts.update((g, f"{x}\x01{w}") for w in re.findall(D.TERM, t or ""))
        frequencies.update({f"{x}\x01{w}" for w in re.findall(D.TERM, t or "")})
    for most in (1024, 7):
        monkeypatch.setattr(D, "ROW_TERMS", most)
        rows = [r for b in D._share_rows(share, 2) for r in b.to_pylist()]
        got, seen = Counter(), Counter()
        for r in rows:
            assert len(set(r["terms"])) == len(r["terms"]) <= most
            if r["gid"] is None:
                seen.update(r["terms"])
            else:
                got.update({(r["gid"], t): r["weight"] for t in r["terms"]})
        assert got == counts
        assert seen == Counter({t: min(n, 2) for t, n in frequencies.items()})


def test_small_shares_change_nothing(spark, rows):
    import pyarrow as pa

    df = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(text, '') text", "coalesce(lang, '') lang", "xxhash64(coalesce(lang, '')) gid").coalesce(1)
    share = pa.RecordBatch.from_pylist([r.asDict() for r in df.collect()])
    total = [sum(len(r["terms"]) for s in parts for b in D._share_rows(s, 3) for r in b.to_pylist() if r["gid"] is None and r["weight"] == 0)
             for parts in ([share], [share.slice(i, 9) for i in range(0, len(share), 9)])]
    assert total[0] < total[1]  # one row of a share for each of its terms
    counts = []
    for parts in ([share], [share.slice(i, 9) for i in range(0, len(share), 9)]):
        counts.append(Counter())
        for r in (r for s in parts for b in D._share_rows(s, 3) for r in b.to_pylist() if r["gid"] is not None):
            counts[-1].update({t: r["weight"] for t in r["terms"]})
    assert counts[0] == counts[1]


def test_the_vocabulary_stays_out_of_the_drivers_python(spark, rows, monkeypatch):
    from pyspark.ml.feature import CountVectorizerModel

    def refused(model):
        raise AssertionError("the vocabulary came to the driver's Python")

    monkeypatch.setattr(CountVectorizerModel, "vocabulary", property(refused))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, D.divergence(df, min_df=2, top_terms=5).collect())) == plain(rows, 2, 5)
