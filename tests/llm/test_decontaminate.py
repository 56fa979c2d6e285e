import random
import re
from collections import Counter

import pytest
from tests.llm.conftest import clashing, sentence

from curata.llm import decontaminate as D

SPLIT = re.compile("[\x00-/:-`{-¿ -⁯　-〿]+")


def words(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def brute_force(docs, items, threshold=D.THRESHOLD):
    out = {}
    for i, t in items:
        w = words(t)
        if not w:
            continue
        g = min(5, len(w))
        own = Counter(tuple(w[k:k + g]) for k in range(len(w) - g + 1))
        for d, text in docs:
            v = words(text)
            for s in range(len(v) - len(w) + 1):
                win = Counter(tuple(v[s + k:s + k + g]) for k in range(len(w) - g + 1))
                both = sum((win & own).values())
                sim = both / (2 * sum(own.values()) - both)
                if sim >= threshold and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(21)
    items = [(i, sentence(rng, "en", rng.randint(14, 45))) for i in range(12)]
    items += [(50, "three short words"), (51, "word"), (52, ""), (53, None), (54, items[0][1]), (55, "rep eat " * 20), (56, "…—")]
    docs = []
    for k in range(40):
        w = sentence(rng, "de", rng.randint(20, 90)).split()
        item = items[k % 12][1].split()
        if k % 4 == 1:
            w[5:5] = item
        elif k % 4 == 2:
            w += [*item[:-2], "changed", "end"]
        elif k % 4 == 3:
            w += item[: len(item) // 2]
        docs.append((k, " ".join(w)))
    docs += [(100, None), (101, ""), (102, items[3][1].upper().replace(" ", ", ")), (103, "Three—short “words”"), (104, "a word here"), (105, "rep eat " * 30),
             (106, "x " * 60000 + items[5][1]), (107, items[1][1].split()[0]), (102, "other text of the same id " + items[4][1]), (7, docs[7][1]), (None, items[2][1])]
    return docs, items


def found(df):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in df.collect()}


def rounded(matches):
    return {k: (round(s, 12), at) for k, (s, at) in matches.items()}


def tables(spark, cases):
    docs, items = cases
    docs = clashing(spark.createDataFrame(docs, "doc_id long, text string"), "item_id", "uid", "t", "g", "shingles", "size", "similarity", "start")
    return docs.repartition(3), clashing(spark.createDataFrame(items, "item_id long, text string"), "doc_id", "size", "h", "fingerprint")


def test_same_as_brute_force(spark, cases):
    assert rounded(found(D.matches(*tables(spark, cases)))) == rounded(brute_force(*cases))


def test_joined_anchors_give_the_same(spark, cases, monkeypatch):
    monkeypatch.setattr(D, "MAX_LITERALS", 0)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert rounded(found(D.matches(*tables(spark, cases)))) == rounded(brute_force(*cases))


def test_decontaminated_keeps_clean_documents(spark, cases):
    docs, items = tables(spark, cases)
    clean = [(d, text) for d, text in cases[0] if not brute_force([(d, text)], cases[1])]
    out = D.decontaminated(docs, items)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(clean)
    assert (None, cases[1][2][1]) not in clean  # a contaminated row without id goes


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, cases):
    item = cases[1][0][1]
    docs = spark.createDataFrame([(1, item), (1, "clean text of the same id"), (None, item), (None, "clean text without an id"), (2, None), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = D.decontaminated(docs, items).collect()
    assert Counter(map(tuple, out)) == Counter([(1, "clean text of the same id"), (None, "clean text without an id"), (2, None), (None, None)])


def test_empty_tables(spark, cases):
    docs, items = tables(spark, cases)
    assert D.matches(docs.limit(0), items).collect() == [] and D.matches(docs, items.limit(0)).collect() == []


def test_near_masks_cover_the_radius():
    assert len(D.near_masks()) == 1 + 9 + 36
    assert D.BLOCKS * (D.BLOCK_RADIUS + 1) > D.RADIUS and D.BLOCKS * D.BLOCK_BITS == D.BITS


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(2)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 300)]
    df = spark.createDataFrame([(x,) for x in lists], "s array<long>")
    for r in df.select("s", D.simhash(df["s"]).alias("f")).collect():
        want = sum(1 << b for b in range(63) if 2 * sum(x >> b & 1 for x in r["s"]) > len(r["s"]))
        assert r["f"] == want


def test_native(spark, cases):
    plan = D.matches(*tables(spark, cases))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
