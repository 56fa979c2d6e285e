"""Packing token sequences by exact-complement hashing, then best fit.

Every text is tokenised whole and closed with an end id; only a document
longer than the capacity is cut, into pieces of the capacity and a rest. The
histogram of piece lengths (``capacity`` counts at most, whatever the input)
goes to the driver, which plans there:

1. Lengths are taken from the longest down. The gap that a length leaves is
   looked up among the single lengths, then the sums of two, then of three;
   a combination that fills the gap exactly is consumed as often as the counts
   of its lengths allow.
2. What no combination fills goes, longest first, into the open sequence with
   the smallest gap that holds it, else into a new one.

The index of sums is kept as bit sets over the lengths still there: the sums
of two that give g are the bits common to the set and its mirror image shifted
by g, and a sum of three takes a first length and looks up the rest.

The plan holds, for ranges of ranks within a length, the first sequence and
the offset. Pieces get a rank within their length (numbered bucket by bucket,
so a length with a third of all pieces is split over many tasks) and look
their place up.

Edge cases: null and empty texts are one piece holding the end id; equal and
repeated rows are separate pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import chunks, give_back, split_words, texts_of, written

CAPACITY = 4096
END_ID = 1
#: Words that a task remembers the ids of.
MEMO = 900_000
#: Pieces that are numbered in one bucket.
BUCKET_ROWS = 10_000


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordTokenizer:
    """Ids of whole texts by a lower-casing byte-level tokenizer that splits at
    white space and between letters and stops. The ids of words are remembered.

    A word of Latin letters, with a stop after it or not, goes to the
    vocabulary directly; whatever else goes through the whole tokenizer."""

    STOPS = (",", ".")
    #: Letters below this one are lower-cased one by one and are composed already.
    LATIN = "\u0130"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode = lambda s: whole.encode(s, add_special_tokens=False).ids
        self.model, self.letters = whole.model, _byte_letters()
        self.stop_ids = {s: array("I", self.encode(s)).tobytes() for s in self.STOPS}
        self.clear()

    def clear(self) -> None:
        self.cores: dict[str, bytes] = {}  # ids as unsigned 32-bit numbers
        self.place: dict[str, int] = {}
        self.flat, self.start = array("I"), array("q", [0])

    def core(self, word: str) -> bytes:
        ids = self.cores.get(word)
        if ids is None:
            mapped = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            ids = self.cores[word] = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        stop = self.stop_ids.get(word[-1:])
        body = word[:-1] if stop else word
        if body.isalpha() and max(body) < self.LATIN:
            return self.core(body.lower()) + (stop or b"")
        return array("I", self.encode(word)).tobytes()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts."""
        words, codes, offsets = split_words(texts)
        if len(self.place) > MEMO:
            self.clear()
        place, flat, starts = self.place, self.flat, self.start
        for w in words:
            if w not in place:
                place[w] = len(starts) - 1
                flat.frombytes(self.word(w))
                starts.append(len(flat))
        at = np.fromiter((place[w] for w in words), np.int64, len(words))[codes]
        bounds = np.array(starts, np.int64)
        start, length = bounds[at], (bounds[1:] - bounds[:-1])[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        order = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return np.array(flat, np.uint32)[order], np.concatenate([[0], ends])[offsets]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = WordTokenizer(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                ids, offsets = words.ids(texts_of(part))
                out: list[list] = [[], [], [], [], []]
                end = np.array([end_id], np.uint32)
                for k in range(part.num_rows):
                    own = np.concatenate([ids[offsets[k]:offsets[k + 1]], end]).astype("<u4")
                    for n, s in enumerate(range(0, len(own), capacity)):
                        piece = own[s:s + capacity]
                        for column, value in zip(out, (k, n, s, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                     *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Placements (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.taken = capacity, Counter(counts), Counter()
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.there = sum(1 << x for x in counts)
        self.mirror = sum(1 << (capacity - x) for x in counts)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.taken[length], count, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            self.there &= ~(1 << length)
            self.mirror &= ~(1 << (self.capacity - length))

    def allows(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be consumed."""
        return min(self.left[x] // k for x, k in Counter(lengths).items())

    def two(self, gap: int):
        """Pairs of lengths that sum to the gap, the most uneven first."""
        bits = self.there & (self.mirror >> (self.capacity - gap)) & ((1 << gap) - 2)
        while bits:
            a = bits.bit_length() - 1
            if 2 * a < gap:
                return
            yield a, gap - a
            bits ^= 1 << a

    def complement(self, length: int) -> tuple[int, ...] | None:
        gap = self.capacity - length
        if not gap:
            return (length,)
        if self.there >> gap & 1 and self.allows((length, gap)):
            return length, gap
        for pair in self.two(gap):
            if self.allows((length, *pair)):
                return length, *pair
        bits = self.there & ((1 << gap) - 2)
        while bits:
            a = bits.bit_length() - 1
            if 3 * a < gap:
                return None
            for pair in self.two(gap - a):
                if self.allows((length, a, *pair)):
                    return length, a, *pair
            bits ^= 1 << a
        return None

    def exact(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length] and (found := self.complement(length)):
                times, offset = self.allows(found), 0
                for x in found:
                    self.put(x, times, self.sequences, offset)
                    offset += x
                self.sequences += times

    def best_fit(self) -> None:
        gaps: dict[int, list[tuple[int, int]]] = {}
        open_gaps = 0
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                fitting = open_gaps >> length
                if fitting:
                    gap = length + (fitting & -fitting).bit_length() - 1
                    first, count = gaps[gap].pop()
                else:
                    gap, first = self.capacity, self.sequences
                    count = max(1, n // (self.capacity // length))
                    self.sequences += count
                used = min(n, count)
                self.put(length, used, first, self.capacity - gap)
                for rest, span in ((gap - length, (first, used)), (gap, (first + used, count - used))):
                    if rest and span[1]:
                        gaps.setdefault(rest, []).append(span)
                        open_gaps |= 1 << rest
                if gap < self.capacity and not gaps[gap]:
                    open_gaps &= ~(1 << gap)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Placements for a histogram of lengths, sorted by length and rank."""
    p = _Plan({k: v for k, v in counts.items() if v}, capacity)
    p.exact()
    p.best_fit()
    return np.array(sorted(p.rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    ``found`` is read three times, so it should be a written table."""
    spark = found.sparkSession
    found = found.drop("sequence_id", "offset")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # one row per length
    placed = spark.sparkContext.broadcast(plan(counts, capacity))
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    key = ["length", "_curata_bucket"]
    dealt = found.withColumn("_curata_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_curata_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*key).agg(F.count("*").alias("_curata_n")).select(*key, F.coalesce(F.sum("_curata_n").over(before), F.lit(0)).alias("_curata_start"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_curata_rank", inside - 1).join(starts, key).withColumn("_curata_rank", (F.col("_curata_rank") + F.col("_curata_start")).cast("long")).select(*found.columns, "_curata_rank")
    schema = found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    kept, names = found.columns, schema.names

    def look_up(batches):
        rows = placed.value
        base = int(rows[:, 2].sum()) + 1 if len(rows) else 1
        begins = rows[:, 0] * base + rows[:, 1]
        for batch in batches:
            rank = np.asarray(batch.column("_curata_rank"))
            at = np.searchsorted(begins, np.asarray(batch.column("length")) * base + rank, side="right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(rows[at, 4])], names)

    return ranked.mapInArrow(look_up, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
