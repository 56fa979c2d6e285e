"""Exact removal of repeated word windows behind a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes if it is
covered by a window whose word sequence also occurs in a document with a
smaller id.

A whole-corpus sketch that tells most windows apart grows with the corpus and
cannot be sent to every task, so it is cut into segments by a second hash, and
the windows travel to the segment that counts them, packed (:mod:`packed`).
There the sketches of all map tasks' parts are merged: two rows of counters
that can only overestimate. The second pass over the segment groups exactly,
by the whole hash, only the windows estimated to repeat; none is lost. Map
tasks settle repeats among their own documents themselves and send a window
once, so a passage in a third of all documents loads no segment.

The covered windows go to buckets of documents and meet their texts there.
Hashes are 64 bits beside the segment's own; windows with equal hashes in one
segment count as equal.

Edge cases: a null text has no words; a null id takes no part and loses
nothing; rows with the same id are one document, so a repeat among them
removes nothing; documents of fewer words than the width keep all; columns of
the input named n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm import packed as P
from curata.llm.common import chunks, give_back, id_list, text_bytes, texts_of

WIDTH = 13
#: Counters in each row of a segment's sketch.
SKETCH_WIDTH = 1 << 22
#: Windows that a map task holds before it packs them, and bytes of text whose
#: windows it hashes at once: two tasks run beside an executor's whole heap.
FLUSH = 1 << 19
SCAN_BYTES = 1 << 20
_OUT = pa.schema([("place", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int8()), pa.array(c, pa.binary())], schema=_OUT)


def _windows(texts: pa.Array, width: int):
    """Both hashes of all windows, the text of each, and the texts' word counts."""
    raw, start, end, offsets = P.word_spans(texts)
    first, n = P.starts_of(offsets, width)
    a, b = P.window_hashes(P.word_hashes(raw, start, end), first, first + width)
    return a, b, np.repeat(np.arange(len(texts)), n), first, offsets


def own_repeats(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries to count elsewhere (one of each hash, that of the smallest
    id) and which are covered already (those of larger ids)."""
    order = np.argsort(hashes, kind="stable")
    head, length = P.runs_of(hashes[order])
    send, covered = np.ones(len(ids), bool), np.zeros(len(ids), bool)
    many = np.repeat(length > 1, length)
    some = order[many]
    if len(some):
        some = some[np.lexsort((ids[some], hashes[some]))]
        head, length = P.runs_of(hashes[some])
        send[some] = False
        send[some[head]] = True
        covered[some] = ids[some] > np.repeat(ids[some[head]], length)
    return send, covered


class Sketch:
    """Count-min counters of one segment, two rows, held at 255."""

    def __init__(self, width: int):
        self.mask = P.U(width - 1)
        self.rows = np.zeros((2, width), np.uint8)

    def cells(self, hashes: np.ndarray):
        return (hashes & self.mask).astype(np.int64), ((hashes >> P.U(32)) & self.mask).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        """Merge one map task's part of the sketch."""
        for row, cells in zip(self.rows, self.cells(hashes), strict=True):
            cell, n = np.unique(cells, return_counts=True)
            row[cell] = np.minimum(row[cell].astype(np.int64) + n, 255)

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.cells(hashes)
        return np.minimum(self.rows[0][a], self.rows[1][b])


def resolve(blobs: list[bytes], sketch_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered windows (id, hash) of one segment."""
    parts = [P.unpack(b, np.uint64) for b in blobs]
    sketch = Sketch(sketch_width)
    for _, hashes in parts:
        sketch.add(hashes)
    kept = [(ids[again], hashes[again]) for ids, hashes in parts for again in [sketch.estimate(hashes) > 1]]
    ids, hashes = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((ids, hashes))
    ids, hashes = ids[order], hashes[order]
    head, length = P.runs_of(hashes)
    covered = ids > np.repeat(ids[head], length)
    return ids[covered], hashes[covered]


def _cut(texts: pa.Array, ids: np.ndarray, there: np.ndarray, cover_ids: np.ndarray, cover_hashes: np.ndarray, width: int):
    """Words, removed words and kept text of each document."""
    hashes, _, doc, first, offsets = _windows(texts, width)
    gone = np.zeros(offsets[-1] + 1, np.int32)
    if len(cover_ids):
        # one key for id and hash
        own = np.isin(hashes ^ P.mix(ids.view(P.U))[doc], cover_hashes ^ P.mix(cover_ids.view(P.U))) & there[doc]
        np.add.at(gone, first[own], 1)
        np.add.at(gone, first[own] + width, -1)
    gone = np.cumsum(gone)[:-1] > 0
    n = np.diff(offsets)
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), offsets[:-1]) if len(n) else np.zeros(0, np.int64)
    removed[n == 0] = 0
    kept = []
    for text, a, b, r in zip(texts, offsets[:-1], offsets[1:], removed, strict=True):
        words = text.as_buffer().to_pybytes().split() if b > a else []
        kept.append(b" ".join(compress(words, ~gone[a:b]) if r else words))
    return n, removed, pa.array(kept, pa.binary()).cast(pa.string())


def covered_windows(docs: DataFrame, width: int, segments: int, buckets: int, sketch_width: int = SKETCH_WIDTH) -> DataFrame:
    """Packed covered windows for each bucket of documents: place, blob."""

    def scan(batches):
        held: list = []
        size = 0

        def packed_rows():
            ids, hashes, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            send, covered = own_repeats(ids, hashes)
            rows = []
            for kind, which, to in ((0, send, place), (1, covered, (P.xxhash64(ids) % segments))):
                at = np.flatnonzero(which)
                rows += [(k, kind, P.pack(ids[at[i]], hashes[at[i]])) for k, i in P.dealt(to[at], segments)]
            return _rows(rows)

        for batch in batches:
            for part in chunks(batch, most=SCAN_BYTES):
                ids, there = id_list(part.column("doc_id"))
                a, b, doc, _, _ = _windows(texts_of(part), width)
                own = there[doc]
                held.append((ids[doc[own]], a[own], ((b[own] >> P.U(20)) % P.U(segments)).astype(np.int32)))
                size += int(own.sum())
                del a, b, doc, own
                if size >= FLUSH:
                    yield packed_rows()
                    size = 0
                    give_back()
        if size:
            yield packed_rows()
        give_back()

    def settle(segment: pa.Table) -> pa.Table:
        kinds, blobs = np.asarray(segment.column("kind")), segment.column("blob").to_pylist()
        ids, hashes = resolve([b for b, k in zip(blobs, kinds, strict=True) if k == 0], sketch_width)
        known = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 1], np.uint64)
        ids, hashes = np.concatenate([ids, known[0]]), np.concatenate([hashes, known[1]])
        place = P.xxhash64(ids) % buckets
        rows = [(k, 0, P.pack(ids[i], hashes[i])) for k, i in P.dealt(place, buckets)]
        del ids, hashes, known, place, blobs
        give_back()
        return pa.Table.from_batches([_rows(rows)])

    schema = "place int, kind byte, blob binary"
    found = docs.select("doc_id", "text").mapInArrow(scan, schema).groupBy("place").applyInArrow(settle, schema)
    return found.select("place", "blob")


def remove_repeats(docs: DataFrame, width: int = WIDTH, sketch_width: int = SKETCH_WIDTH) -> DataFrame:
    """All columns of the documents with n_words, n_removed and kept_text (the
    kept words joined by one blank)."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    size = text_bytes(docs)
    segments, buckets = P.segments_for(size), P.buckets_for(size)
    covers = covered_windows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), width, segments, buckets, sketch_width)
    schema = docs.schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    names = schema.names

    def cut(own: pa.Table, covers: pa.Table) -> pa.Table:
        own = own.drop_columns(["_curata_place"]).combine_chunks()
        ids, hashes = P.unpack_all(covers.column("blob").to_pylist(), np.uint64)
        out = []
        for batch in own.to_batches():
            for part in chunks(batch):
                doc, there = id_list(part.column("doc_id"))
                n, removed, kept = _cut(texts_of(part), doc, there, ids, hashes, width)
                out.append(pa.RecordBatch.from_arrays([*part.columns, pa.array(n.astype(np.int64)), pa.array(removed), kept], names))
        return pa.Table.from_batches(out) if out else pa.table([[] for _ in names], names)

    # without an id the text decides, which spreads such rows
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets))
    key = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(buckets))).otherwise(key).cast("int")
    left = docs.withColumn("_curata_place", key).groupBy("_curata_place")
    return left.cogroup(covers.groupBy("place")).applyInArrow(cut, schema)
