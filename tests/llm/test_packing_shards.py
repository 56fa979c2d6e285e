import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import clashing

from curata.llm.complement_packing import WordTokenizer, pack_documents, plan
from curata.llm.feistel_shards import permute, place, row_at, shard_documents, write_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def laid_out(counts, capacity):
    """Sequences as lists of (offset, length) from a plan."""
    rows = plan(counts, capacity)
    ranks, out = Counter(), {}
    for length, rank, count, sequence, offset in rows.tolist():
        assert ranks[length] == rank
        ranks[length] += count
        for i in range(count):
            out.setdefault(sequence + i, []).append((offset, length))
    assert {k: v for k, v in ranks.items() if v} == {k: v for k, v in counts.items() if v}
    for members in out.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_places_every_piece_once(counts):
    out = laid_out(counts, 64)
    total = sum(k * v for k, v in counts.items())
    assert len(out) >= -(-total // 64)
    assert len(out) <= max(1, 2 * -(-total // 64))


def test_plan_fills_gaps_exactly():
    assert len(laid_out({60: 10, 4: 10}, 64)) == 10
    assert len(laid_out({50: 3, 9: 3, 5: 3}, 64)) == 3
    assert len(laid_out({50: 2, 7: 2, 4: 2, 3: 2}, 64)) == 2
    assert len(laid_out({32: 7}, 64)) == 4
    assert len(laid_out({64: 5}, 64)) == 5
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1, 20000).astype(int) + 1).tolist())
    least = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert len(laid_out(counts, 4096)) <= least + 2


TEXTS = ["", None, "a", "Hello, World... it's <|endoftext|>x 12,3. Straße µm ª,", "tab\tvert\x0bform\x0cunit\x1cend", "word " * 9000, "İstanbul é 日本語. ŉ ſ ΑΣ, ǅ", "a b c don't. ,. .,"]


def test_tokenizer_is_the_whole_tokenizer():
    words = WordTokenizer(PATH)
    texts = [t or "" for t in TEXTS]
    ids, at = words.ids(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [words.encode(t) for t in texts]


def test_pack_documents(spark, docs, corpus):
    rows = [(d, t) for d, t, *_ in corpus] + [(900 + i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "length", "sequence_id", "offset", "start", "piece")
    got = pack_documents(df, PATH).collect()
    encode = WordTokenizer(PATH).encode
    want = Counter()
    for d, t in rows:
        ids = [*encode(t or ""), 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            piece = ids[s:s + 4096]
            want[d, n, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_tables(no_docs):
    assert pack_documents(no_docs, PATH).collect() == []
    assert shard_documents(no_docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000, 4097])
def test_permutation(n):
    p = permute(np.arange(n), n, 5)
    assert sorted(p.tolist()) == list(range(n))
    assert (permute(p, n, 5, back=True) == np.arange(n)).all()


def test_place_and_back():
    assert all(row_at(*place(r, 1000, 7, 3), 1000, 7, 3) == r for r in range(1000))


def test_shards(spark, corpus):
    rows = [(d, t) for d, t, *_ in corpus] + [(None, None), (None, "x"), (5, "same"), (5, "same"), (5, None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "shard", "slot", "row_number", "size", "law")
    got = shard_documents(df, 7).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(text(t)) + 16, zlib.crc32(text(t))) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert (r["shard"], r["slot"]) == place(r["row_number"], len(rows), 7) and r["grown_shard"] is None and r["law"] == "rows"
    sizes = [len(v) for v in slots.values()]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    again = shard_documents(df.repartition(2), 7).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_write_shards(spark, docs, tmp_path):
    write_shards(docs.select("doc_id", "text", "lang"), f"{tmp_path}/out", ["doc_id"], 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
