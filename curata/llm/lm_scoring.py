"""Language-model scoring by a log-frequency Bloom filter.

Tokens: the words of the lower-cased (A-Z) text, then one end. A begin stands
before them as context only.

Chunks. Texts go in chunks of a bounded number of bytes that hold either
training texts or others. A chunk is one compressed row in the shared folder.

Counting. Each chunk counts its distinct n-grams of one to three tokens and
sends them, sorted, to segments of the hash range; chunks of other texts send
theirs without counts, as questions only. A segment adds the counts up and makes
two things: the exact counts of its words, and one block of the Bloom filter. An
n-gram with count c is entered once for each level 1 .. 1 + floor(log2 c).
n-grams of two and three tokens need a count of ``least``: with 1 the model
holds every n-gram, with 2 what occurs once in the corpus doesn't vouch for
itself. A block has a fixed number of bits for each entry, so the filter grows
with the corpus.

Answers. The filter stays where it is made: the segment probes its block for
all n-grams that were sent to it. What was entered is found, so probes start a
level above that and go upwards until one is missing. Levels, and the exact
counts of words, go back to the chunks in the order in which the n-grams came.
Nothing is broadcast, and every n-gram travels once each way, so the work grows
in proportion to the corpus. What was asked goes from disk when the answers are
written, before they travel.

Scoring. A level stands for a quantised count (the middle of its power of 2, 0
without a level). Each order is smoothed by the one below with a fixed weight:
P(w | h) = (min(c(hw), c(h)) + W P(w | shorter h)) / (c(h) + W), down to
(c(w) + 1) / (N + V + 1). The base score takes the exact counts.

Words and n-grams are told apart by 64-bit hashes (n-grams of two and three
tokens within their segment by 32 more bits); the filter errs on the high side
in about 0.4 % of the probes for what it does not hold.

Edge cases: null text is empty and has one token, the end; a null id is never
held out and never learned from; repeated rows are scored each and learned as
often as they occur; without any training row N = V = 0 and scores are 0; an
empty table gives no rows; the result has no other columns of the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import bloom
from curata.llm import packed as P
from curata.llm.common import chunks, give_back, shuffles_given_back, text_bytes, texts_of, written

ORDER = 3
#: Weight of the shorter context.
WEIGHT = 2.0
#: Words and bytes that were broadcast before answers went through a shuffle.
HEAD = 1 << 18
SHARD_BYTES = 64 << 20
#: Bytes of text of a chunk, but for its last slice.
FLUSH = 4 << 20
#: Least count of an n-gram of two or more tokens, if none is given.
LEAST = 2
#: Levels: counts up to 2**48.
LEVELS = 48
U = P.U
#: Columns of what a chunk asks a segment, and of what it gets back.
ASKED = [f"{kind}{order}" for order in range(1, ORDER + 1) for kind in ("grams", "counts")]
ANSWERED = ["chunk", "segment", "counts", *(f"levels{order}" for order in range(1, ORDER + 1)), "n", "v"]
END, BEGIN = U(0x452821E638D01377), U(0xBE5466CF34E90C6C)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words and end of each text, and the offsets of the texts."""
    raw, start, end, offsets = P.word_spans(texts)
    words = P.word_hashes(raw, start, end, lower=True) if len(start) else np.zeros(0, U)
    at = offsets + 2 * np.arange(len(offsets))  # a begin and an end for each text before
    out = np.empty(at[-1], U)
    place = np.ones(len(out), bool)
    place[at[:-1]] = place[at[1:] - 1] = False
    out[place] = words
    out[at[:-1]], out[at[1:] - 1] = BEGIN, END
    return out, at


def grams_of(tokens: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``order`` tokens that end at each token but the begins, and
    whether a text has as many before. The result is by token; what is not
    there has hash 0."""
    h = tokens.copy()
    for j in range(1, order):
        h[j:] = P.mix(h[j:] * U(0x9E3779B97F4A7C15) + tokens[:len(tokens) - j] * U(2 * j + 1)) if len(tokens) > j else h[j:]
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    there = place >= order - 1
    return np.where(there, h, U(0)), there


def keys_of(grams: np.ndarray, bits: int) -> np.ndarray:
    """Segment (upper half) and 32 bits within it (lower half) of n-grams."""
    return P.mix(grams) >> U(32 - bits)


def _level_key(short: np.ndarray, order: int, level) -> np.ndarray:
    return P.mix(short.astype(U) + (U(order) << U(32)) + (np.asarray(level, U) << U(40)))


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level: 0, 1, 2.5, 5.5, 11.5, ..."""
    low = np.exp2(np.maximum(levels, 1) - 1.0)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


def packed_chunks(docs: DataFrame) -> DataFrame:
    """learned and texts (the rows, compressed) of each chunk of the rows doc_id,
    text, held_out and learned."""

    def scan(batches):
        held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def row(learned):
            part = pa.Table.from_batches(held[learned]).combine_chunks().drop_columns("learned")
            held[learned], size[learned] = [], 0
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                out.write_table(part)
            return pa.RecordBatch.from_arrays([pa.array([learned]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["learned", "texts"])

        for batch in batches:
            for learned in held:
                for part in chunks(batch.filter(pc.equal(batch.column("learned"), learned)), most=FLUSH):
                    held[learned].append(part)
                    size[learned] += 8 * len(part) + (pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
                    if size[learned] >= FLUSH:
                        yield row(learned)
        yield from (row(learned) for learned in held if held[learned])
        give_back()

    return docs.mapInArrow(scan, "learned boolean, texts binary")


def _opened(texts: pa.Buffer) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows of a chunk, its tokens and the offsets of the texts in them, its
    distinct words (hashed once more, ascending), and the number of each token's word."""
    rows = pa.ipc.open_stream(texts).read_all().combine_chunks().to_batches()[0]
    tokens, offsets = tokens_of(texts_of(rows))
    return rows, tokens, offsets, *np.unique(P.mix(tokens), return_inverse=True)


def _cut(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values[cuts[i]:cuts[i + 1]]`` for each i."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _planes(cuts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the first byte of each value is, if each slice holds the first bytes
    of its values, then the second ones and so on, and the way to the next byte."""
    n = np.diff(cuts)
    first = np.repeat(cuts[:-1], n)
    return first * (size - 1) + np.arange(len(first)), np.repeat(n, n)


def packed_runs(keys: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of ascending keys as bytes: differences, by place of the byte, whose
    upper bytes the shuffle compresses to little."""
    steps = np.diff(keys, prepend=keys[:1])
    head = cuts[:-1][np.diff(cuts) > 0]
    steps[head] = keys[head]
    raw, out = steps.view(np.uint8).reshape(len(keys), keys.itemsize), np.empty(keys.nbytes, np.uint8)
    at, step = _planes(cuts, keys.itemsize)
    for i in range(keys.itemsize):
        out[at + i * step] = raw[:, i]
    return _cut(out, cuts * keys.itemsize)


def unpacked_runs(blobs: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all slices, and the cuts between them."""
    cuts = np.concatenate([[0], np.cumsum([len(b) // size for b in blobs], dtype=np.int64)])
    data, raw = np.frombuffer(b"".join(blobs), np.uint8), np.empty((cuts[-1], size), np.uint8)
    at, step = _planes(cuts, size)
    for i in range(size):
        raw[:, i] = data[at + i * step]
    total = np.concatenate([np.zeros(1, U), np.cumsum(raw.view(f"u{size}")[:, 0], dtype=U)])
    return (total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))).astype(f"u{size}"), cuts


def _least_type(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def asked_grams(chunked: DataFrame, bits: int) -> DataFrame:
    """chunk and segment, and for each order the distinct n-grams of the chunk in
    the segment (see :func:`packed_runs`; words by 64 bits, others by 32) with their
    counts in it (empty: not to be learned)."""

    def scan(batches):
        edges = np.arange(1, 1 << bits, dtype=U) << U(64 - bits)
        for batch in batches:
            for chunk, learned, texts in zip(*(batch.column(name) for name in ("chunk", "learned", "texts")), strict=True):
                _, tokens, offsets, words, index = _opened(texts.as_buffer())
                sent = [(words, np.bincount(index), edges)]
                for order in range(2, ORDER + 1):
                    h, there = grams_of(tokens, offsets, order)
                    keys = np.sort(keys_of(h[there], bits))
                    head, counts = P.runs_of(keys)
                    sent.append((keys[head], counts, edges >> U(32 - bits)))
                columns = []
                for keys, counts, starts in sent:
                    cuts = np.concatenate([[0], np.searchsorted(keys, starts), [len(keys)]])
                    columns.append(packed_runs(keys if not columns else keys.astype(np.uint32), cuts))
                    columns.append(_cut(_least_type(counts), cuts) if learned.as_py() else pa.array([b""] * (len(cuts) - 1), pa.binary()))
                n = 1 << bits
                rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk.as_py())), pa.array(np.arange(n, dtype=np.int32)), *columns], ["chunk", "segment", *ASKED])
                yield rows.filter(pc.greater(sum_of_lengths(columns[::2]), 0))
        give_back()

    return chunked.mapInArrow(scan, "chunk long, segment int, " + ", ".join(f"{name} binary" for name in ASKED))


def sum_of_lengths(columns: list[pa.Array]) -> pa.Array:
    out = pc.binary_length(columns[0])
    for column in columns[1:]:
        out = pc.add(out, pc.binary_length(column))
    return out


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and where each was. 32-bit keys are sorted together with
    their places, which is faster than sorting places by keys."""
    if keys.itemsize > 4:
        order = np.argsort(keys)
        return keys[order], order
    both = np.sort((keys.astype(U) << U(32)) | np.arange(len(keys), dtype=U))
    return (both >> U(32)).astype(np.uint32), (both & U(0xFFFFFFFF)).astype(np.int64)


def probed_levels(block: bloom.Blocks, short: np.ndarray, order: int, own: np.ndarray) -> np.ndarray:
    """Levels by the filter of n-grams that were entered up to level ``own``: by
    repeated probes, one level up as long as the last was found."""
    out, left = own.astype(np.uint8), np.flatnonzero(own < LEVELS)
    while len(left):
        hit = block.has(_level_key(short[left], order, out[left] + 1), np.zeros(len(left), np.int64))
        left = left[hit]
        out[left] += 1
        left = left[out[left] < LEVELS]
    return out


def answered_grams(asked: DataFrame, bits: int, bits_per_key: int = bloom.BITS_PER_KEY, least: int = LEAST) -> DataFrame:
    """chunk and segment, counts (exact, of the words asked for) and the levels of
    the n-grams of each order, in the order of asking; n and v of a segment, once:
    its tokens and distinct words."""
    begin = P.mix(np.array([BEGIN]))[0]

    def settle(rows: pa.Table) -> pa.Table:
        found, entries = [], []
        for order in range(1, ORDER + 1):
            size = 8 if order == 1 else 4
            blobs, own = (rows.column(name).to_pylist() for name in ASKED[2 * order - 2:2 * order])
            keys, cuts = unpacked_runs(blobs, size)
            keys, back = _sorted(keys)
            counts = np.concatenate([np.frombuffer(c, f"u{len(c) // k}").astype(np.int64) if c else np.zeros(k, np.int64) for c, k in zip(own, np.diff(cuts).tolist(), strict=True)])
            head, times = P.runs_of(keys)
            keys, counts = keys[head], np.add.reduceat(counts[back], head) if len(head) else counts
            short = ((keys << U(bits)) >> U(32)).astype(np.uint32) if order == 1 else keys
            level = level_of(counts) if order == 1 else np.where(counts >= least, level_of(counts), 0)
            for j in range(1, int(level.max(initial=0)) + 1):
                entries.append(_level_key(short[level >= j], order, j))
            found.append((short, level, back, times, cuts))
            if order == 1:
                exact, real = counts, (counts > 0) & (keys != begin)
        entered = np.concatenate(entries) if entries else np.zeros(0, U)
        n = max(64, bits_per_key * len(entered))
        block = bloom.Blocks(np.array([n]), [bloom.bitmap(entered, n).tobytes()])
        del entries, entered

        def returned(values, back, times, cuts):
            out = np.empty(len(back), values.dtype)
            out[back] = np.repeat(values, times)
            return _cut(out, cuts)

        columns = [returned(_least_type(exact), *found[0][2:])]
        columns += [returned(probed_levels(block, short, order, level), *rest) for order, (short, level, *rest) in enumerate(found, 1)]
        once = np.zeros(rows.num_rows, np.int64)
        once[0] = 1
        out = pa.table([rows.column("chunk"), rows.column("segment"), *columns, pa.array(once * exact[real].sum()), pa.array(once * real.sum())], ANSWERED)
        del found, block
        give_back()
        return out

    return asked.groupBy("segment").applyInArrow(settle, "chunk long, segment int, " + ", ".join(f"{name} binary" for name in ANSWERED[2:-2]) + ", n long, v long")


def log_probabilities(levels: np.ndarray, offsets: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 P of each token given up to two before, 0 for the begins."""
    counts = count_of(np.arange(LEVELS + 1))[levels]
    place = np.arange(levels.shape[1]) - np.repeat(offsets[:-1], np.diff(offsets))
    p = (counts[0] + 1) / (total + distinct + 1)
    for order in range(2, ORDER + 1):
        context = np.concatenate([[0.0], counts[order - 2][:-1]])  # of the (order - 1)-gram that ends one before
        there = place >= order - 1
        context = np.where(there, context, 0.0)
        p = (np.minimum(counts[order - 1], context) + WEIGHT * p) / (context + WEIGHT)
    return np.where(place > 0, np.log10(np.minimum(p, 1.0)), 0.0)


def score_texts(docs: DataFrame, training: Column, head: int = HEAD, shard_bytes: int = SHARD_BYTES,
                bits_per_key: int = bloom.BITS_PER_KEY, least: int = LEAST) -> DataFrame:
    """doc_id, held_out (the opposite of ``training``), n_tokens, n_known,
    train_tokens, base_score and score of each row. n-grams of two and three
    tokens that occur less than ``least`` times are left out of the model.
    ``head`` and ``shard_bytes`` bounded broadcasts; there are none any more, and
    they change nothing."""
    docs = docs.select("doc_id", "text", (~training).alias("held_out"))
    learned = F.coalesce(~F.col("held_out") & F.col("doc_id").isNotNull(), F.lit(False))
    bits = max(3, (text_bytes(docs.where(learned)) // (P.WORD_BYTES * P.SEGMENT_WINDOWS)).bit_length())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out", learned.alias("learned"))
    # written with their numbers, which so stay the same
    chunked = written(packed_chunks(docs).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    with shuffles_given_back(docs.sparkSession):  # what was asked is larger than the texts, and must not lie beside the answers' way back
        answers = written(answered_grams(asked_grams(chunked, bits), bits, bits_per_key, least), "answers")
    sums = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"] or 0)

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        by = np.argsort(np.asarray(answers.column("segment")))
        own, *blobs = (answers.column(name).take(by).to_pylist() for name in ANSWERED[2:-2])
        counts = np.concatenate([np.frombuffer(c, f"u{len(c) // len(k)}").astype(np.int64) for c, k in zip(own, blobs[0], strict=True) if k])
        levels = [np.frombuffer(b"".join(column), np.uint8) for column in blobs]
        return _scored(texts.column("texts")[0].as_buffer(), counts, levels, bits, total, distinct)

    answers = answers.select("chunk", *ANSWERED[1:-2])
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return chunked.select("chunk", "texts").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, out)


def _scored(texts: pa.Buffer, counts: np.ndarray, levels: list[np.ndarray], bits: int, total: int, distinct: int) -> pa.Table:
    """Results of the texts of a chunk by the exact counts of its words and the
    levels of its n-grams, both in the order of asking."""
    rows, tokens, offsets, _, index = _opened(texts)
    by_token = np.zeros((ORDER, len(tokens)), np.uint8)
    by_token[0] = levels[0][index]
    for order in range(2, ORDER + 1):
        h, there = grams_of(tokens, offsets, order)
        at, keys = np.flatnonzero(there), keys_of(h[there], bits)
        by = np.argsort(keys)
        by_token[order - 1, at[by]] = np.repeat(levels[order - 1], P.runs_of(keys[by])[1])
    inner = np.ones(len(tokens), bool)
    inner[offsets[:-1]] = False
    score = np.add.reduceat(log_probabilities(by_token, offsets, total, distinct), offsets[:-1])
    base = np.add.reduceat(np.where(inner, np.log10((counts + 1) / (total + distinct + 1))[index], 0.0), offsets[:-1])
    known = np.add.reduceat(((counts > 0)[index] & inner).astype(np.int64), offsets[:-1])
    return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": np.diff(offsets) - 1, "n_known": known,
                     "train_tokens": np.full(len(known), total), "base_score": base, "score": score})
