import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.test_decontaminate import brute_force as leaks
from tests.llm.test_ngram_join import brute_force as near
from tests.llm.test_substring_dedup import brute_force as repeats

import corpus_pipeline as C

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    items = [(0, " ".join(corpus[20][1].split()[3:25])), (1, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


def expected(rows, items):
    """Stages two to four on (doc_id, text) rows by brute force."""
    judged = near(rows)
    copies = {d for d, _, c in judged if d is not None and c != d}
    rows = list(dict.fromkeys((d, t) for d, t in rows if d not in copies))
    cut = {}
    for d, n, removed, kept in repeats(rows):
        cut.setdefault(d, []).append((n, removed, kept))
    out = []
    for d, t in rows:
        n = len((t or "").encode().split())
        removed, kept = next((r, k) for m, r, k in cut[d] if m == n)
        if n == 0 or removed < n:
            out.append((d, kept if removed else t))
    return [(d, t) for d, t in out if not leaks([(d, t)], items)]


def test_run(spark, tables, corpus):
    from curata.llm.complement_packing import WordTokenizer

    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    spoken = C.language_id(spark, docs, path)
    assert spoken.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    assert {d for d, t, *_ in corpus if t and len(t.split()) > 20 and not t.startswith("x x")} <= {d for d, _ in kept}
    assert not {d for d, t, *_ in corpus if not (t or "").strip()} & {d for d, _ in kept}
    encode = WordTokenizer(C._vocabulary()).encode
    want = Counter()
    for d, t in expected(kept, items):
        ids = [*encode(t or ""), 1]
        for n, s in enumerate(range(0, len(ids), 4096)):
            want[d, n, zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())] += 1
    got = C.run(spark, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == want


def test_stages_keep_the_columns(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(C.STAGES) <= 5
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema


def test_empty_table(spark, no_docs, tables):
    for _, stage in C.STAGES:
        assert stage(spark, no_docs, tables[0]).collect() == []


def test_registered():
    import __spark_entry__ as E

    names = [k for k in E.queries() if k.startswith("op")]
    assert sorted({int(k[2:].split("_")[0]) for k in names}) == list(range(1, 14)) and "pipeline" in E.queries()
    assert {"op2_url_filters", "op4_substring_dedup", "op6_chat_formatting"} <= set(E.oracle_sql())
