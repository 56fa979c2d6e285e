import numpy as np
from tests.llm.conftest import clashing

from curata.llm.substring_dedup import Sketch, own_repeats, remove_repeats, resolve
from curata.llm import packed


def brute_force(rows, width=13):
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - width + 1):
            if d is not None:
                k = tuple(w[i:i + width])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


def test_same_as_brute_force(docs, corpus):
    assert found(remove_repeats(docs)) == brute_force([r[:2] for r in corpus])


def test_narrow_sketch_loses_nothing(docs, corpus):
    assert found(remove_repeats(docs, sketch_width=16)) == brute_force([r[:2] for r in corpus])


def test_other_width(docs, corpus):
    assert found(remove_repeats(docs, width=4)) == brute_force([r[:2] for r in corpus], 4)


def test_null_ids_repeated_ids_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(4, base), (4, base), (None, base), (None, None), (6, "lead " + base + " tail"), (7, None), (5, base.upper()), (9, base[:40])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_words", "kept_text", "place", "kind", "blob")
    out = remove_repeats(df)
    assert found(out) == brute_force(rows)
    assert out.columns == ["doc_id", "text", "place", "kind", "blob", "n_words", "n_removed", "kept_text"]


def test_empty_table(no_docs):
    assert remove_repeats(no_docs).collect() == []


def test_own_repeats_sends_the_smallest_id():
    ids, hashes = np.array([5, 3, 3, 9, 1]), np.array([7, 7, 7, 8, 7], np.uint64)
    send, covered = own_repeats(ids, hashes)
    assert sorted(zip(ids[send], hashes[send], strict=True)) == [(1, 7), (9, 8)]
    assert ids[covered].tolist() == [5, 3, 3]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**62, 500).astype(np.uint64)
    sketch = Sketch(256)
    sketch.add(np.concatenate([hashes, hashes[:100]]))
    sketch.add(hashes[:300])
    assert (sketch.estimate(hashes[:100]) >= 3).all() and (sketch.estimate(hashes[:300]) >= 2).all()


def test_resolve_merges_map_tasks():
    blobs = [packed.pack(np.array([4]), np.array([11], np.uint64)), packed.pack(np.array([2, 8]), np.array([11, 12], np.uint64))]
    ids, hashes = resolve(blobs, 1 << 8)
    assert ids.tolist() == [4] and hashes.tolist() == [11]


def test_scan_holds_little_at_once():
    """Beside an executor's whole heap two scans run at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from curata.llm import substring_dedup as S

    class Captured:
        def __getattr__(self, name):
            return lambda *a: setattr(self, "scan", a[0]) or self if name == "mapInArrow" else self

    docs = Captured()
    S.covered_windows(docs, 13, 84, 128)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(1000 * i, 1000 * i + 1000)), pa.array([" ".join(rng.choice(words, 400)) for _ in range(1000)])], ["doc_id", "text"]) for i in range(6)]
    list(docs.scan(iter(batches[:1])))  # powers that stay
    tracemalloc.start()
    try:
        windows = sum(len(S.P.unpack(b.as_py(), np.uint64)[0]) for out in docs.scan(iter(batches)) for b in out.column("blob"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert windows > 6000 * 380
    assert peak < 90 << 20, peak
