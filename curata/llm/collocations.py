"""Phrase collocation mining: per language, word sequences that occur together
far more often than their parts do.

Words. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line
ends, and the pieces into words at blanks and tabs. A word's id is a 64-bit
hash of its language and bytes. The word counts keep the strings, so it is
checked that no two words of the corpus share an id (else another hash is
taken): what is counted by ids is exact.

Phrases of n words. A map task permutes the packed word ids of its n-grams into
quotient and full remainder and keeps counting quotient filters
(``quotient_filter``), one for each segment of quotients; the filters of a
segment are merged by the task that gets them. Only n-grams all of whose
(n-1)-grams are frequent can be frequent: a Bloom filter of a bounded size over
those drops most others before they travel. It may let some pass, which then
fall under the least count, but it drops no frequent one.

Scores. Counts of the parts are joined from the tables of shorter phrases; for
every cut the score is floor(10**6 a a / (l r)) in decimals, and the lowest
counts. A phrase inside a longer candidate that has at least ``absorbed``
percent of its count is dropped: the longest that contain it by one word are
enough to look at, since whatever contains those occurs no more often.

Ranks are taken in two steps, within salted groups and then per language, so
no task gets all candidates of a language.

Edge cases: null text is empty, null lang ``und``; texts without words add
nothing; phrases never cross pieces or texts; repeated rows count as often as
they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm import bloom
from curata.llm import packed as P
from curata.llm import quotient_filter as Q
from curata.llm.common import chunks, give_back, text_bytes, texts_of, written

LEAST = 10
LONGEST = 3
ABSORBED = 50
TOP = 2000
SCALE = 1_000_000
#: n-grams that a map task counts before it sends its filters.
FLUSH = 1 << 21
#: n-grams of a segment on average.
SEGMENT_GRAMS = 1 << 20
#: Bits of the filters that drop rare n-grams.
MOST_FILTER_BITS = 1 << 27
#: Groups of a language that are ranked apart at first.
SALTS = 64
#: Words that a task counts before it sends them.
HELD_WORDS = 400_000
U = P.U

_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9]] = _BLANK
_CLASS[[*b".,;:!?", *range(10, 14)]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng([77, seed]).integers(1, 2**63, 256).astype(U) * U(2) + U(1)


def _lang_code(lang: str, seed: int) -> np.uint64:
    return U(int.from_bytes(blake2b(f"{seed} {lang}".encode(), digest_size=8).digest(), "little"))


def words_of(part: pa.RecordBatch, seed: int):
    """Lower-cased bytes, start, end, id, piece and text of every word of a
    slice of rows (lang, text)."""
    texts = texts_of(part)
    off = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    data = texts.buffers()[2]
    raw = _LOWER[np.frombuffer(data, np.uint8)[off[0]:off[-1]]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    kind = _CLASS[raw]
    word = kind == _WORD
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = ~word[:-1]
    edge[off] = True
    start = np.flatnonzero(word & edge[:-1])
    edge[:-1] = ~word
    edge[off] = True
    end = np.flatnonzero(word & edge[1:]) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    piece = np.cumsum(kind == _BREAK)[start] + doc if len(raw) else start
    langs = pc.dictionary_encode(pc.fill_null(part.column("lang"), "und"))
    code = np.array([_lang_code(x, seed) for x in langs.dictionary.to_pylist()], U)
    ids = P.mix(P.word_hashes(raw, start, end, table=_table(seed)) ^ code[np.asarray(langs.indices)[doc]]) if len(start) else np.zeros(0, U)
    return raw, start, end, ids, piece, doc


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """id, lang, word, n: summed within a task, then by Spark."""

    def scan(batches):
        counts: dict[tuple[str, bytes], list[int]] = {}

        def rows():
            (langs, words), own = zip(*counts, strict=True), np.array(list(counts.values()), np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(own[:, 1])],
                                             ["id", "lang", "word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in chunks(batch):
                raw, start, end, ids, _, doc = words_of(part, seed)
                order = np.argsort(ids)
                head, size = P.runs_of(ids[order])
                first = order[head]
                data, langs = raw.tobytes(), pc.fill_null(part.column("lang"), "und").to_pylist()
                for i, a, b, d, n in zip(ids.view(np.int64)[first].tolist(), start[first].tolist(), end[first].tolist(), doc[first].tolist(), size.tolist(), strict=True):
                    own = counts.setdefault((langs[d], data[a:b]), [i, 0])
                    own[1] += n
                if len(counts) > HELD_WORDS:
                    yield rows()
        if counts:
            yield rows()
        give_back()

    found = docs.mapInArrow(scan, "id long, lang string, word string, n long")
    return found.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def words_with_ids(docs: DataFrame) -> tuple[DataFrame, int]:
    """Counts of all words, written, and the seed of the ids: no two words
    share an id."""
    seed = 0
    while True:
        words = written(word_counts(docs, seed), "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def gram_key(lanes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of the ids of an n-gram (the id itself for one word)."""
    return reduce(lambda h, x: P.mix(h * U(0x9E3779B97F4A7C15) + x), lanes[1:], lanes[0])


def phrase_counts(docs: DataFrame, size: int, seed: int, frequent: bloom.Blocks, least: int, segment_bits: int) -> DataFrame:
    """w0 .. w(size-1), a: the phrases of ``size`` words with a count of at
    least ``least``. ``frequent`` holds the keys of the frequent (size-1)-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by MOST_FILTER_BITS

    def scan(batches):
        held: list = []
        n = 0

        def rows():
            lanes, counts = Q.counted([np.concatenate(x) for x in zip(*held, strict=True)])
            segment = (lanes[0] >> U(64 - segment_bits)).astype(np.int64)
            head, length = P.runs_of(segment)
            out = [(int(segment[h]), Q.encode([x[h:h + k] for x in lanes], counts[h:h + k], int(segment[h]), segment_bits)) for h, k in zip(head.tolist(), length.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["segment", "filter"])

        known = sent.value
        for batch in batches:
            for part in chunks(batch):
                _, _, _, ids, piece, _ = words_of(part, seed)
                if len(ids) < size:
                    continue
                # frequent[i]: the (size-1)-gram that starts at word i may be frequent
                shorter = gram_key([ids[j:len(ids) - size + 2 + j] for j in range(size - 1)])
                frequent = known.has(shorter, bloom.block_of(shorter, len(known.bits)))
                at = np.flatnonzero(frequent[:-1] & frequent[1:] & (piece[:len(ids) - size + 1] == piece[size - 1:]))
                if len(at):
                    held.append(Q.permute([ids[at + j] for j in range(size)]))
                    n += len(at)
                if n >= FLUSH:
                    yield rows()
                    held.clear()
                    n = 0
        if held:
            yield rows()
        held.clear()
        give_back()

    names = [f"w{j}" for j in range(size)]

    def settle(rows: pa.Table) -> pa.Table:
        lanes, counts = Q.merge(rows.column("filter").to_pylist(), size, rows.column("segment")[0].as_py(), segment_bits)
        kept = counts >= least
        ids = Q.restore([x[kept] for x in lanes])
        out = pa.table([pa.array(x.view(np.int64)) for x in ids] + [pa.array(counts[kept])], [*names, "a"])
        del lanes, rows
        give_back()
        return out

    found = docs.mapInArrow(scan, "segment int, filter binary").groupBy("segment")
    return found.applyInArrow(settle, ", ".join(f"{x} long" for x in [*names, "a"]))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """All words with their ids and counts, and the tables of frequent phrases
    of 1, 2, ... ``longest`` words (w0 .., a)."""
    docs = docs.select("lang", "text")
    words, seed = words_with_ids(docs)
    segment_bits = max(4, (text_bytes(docs) // (P.WORD_BYTES * SEGMENT_GRAMS)).bit_length())
    levels = [words.where(F.col("n") >= least).select(F.col("id").alias("w0"), F.col("n").alias("a"))]

    def keyed(batches, size):
        for b in batches:
            lanes = [np.asarray(b.column(j)).view(U) for j in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(gram_key(lanes).view(np.int64))], ["key"])

    for size in range(2, longest + 1):
        shorter = levels[-1].select([f"w{j}" for j in range(size - 1)])
        keys = shorter.mapInArrow(lambda batches, n=size - 1: keyed(batches, n), "key long")
        frequent = bloom.build(keys, shorter.count(), MOST_FILTER_BITS)
        levels.append(written(phrase_counts(docs, size, seed, frequent, least, segment_bits), "phrases"))
    return words, levels


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbed: int = ABSORBED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases per language."""
    words, levels = frequent_phrases(docs, least, longest)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    words = words.where(F.col("n") >= least).select("id", "lang", "word", F.col("n").alias("f"))
    wide = "decimal(15,0)"
    found = None
    for size in range(2, longest + 1):
        rows = levels[size - 1]
        for j in range(size):  # strings, and the counts of the first and the last word
            own = words.select(F.col("id").alias(f"w{j}"), F.col("word").alias(f"s{j}"), F.col("f").alias(f"f{j}"), *(["lang"] if j == 0 else []))
            rows = rows.join(own, f"w{j}")
        first, last = {1: F.col("f0")}, {1: F.col(f"f{size - 1}")}
        for k in range(2, size):
            head = levels[k - 1].select(*(F.col(f"w{j}") for j in range(k)), F.col("a").alias(f"first{k}"))
            tail = levels[k - 1].select(*(F.col(f"w{j}").alias(f"w{size - k + j}") for j in range(k)), F.col("a").alias(f"last{k}"))
            rows = rows.join(head, [f"w{j}" for j in range(k)]).join(tail, [f"w{size - k + j}" for j in range(k)])
            first[k], last[k] = F.col(f"first{k}"), F.col(f"last{k}")
        a = F.col("a").cast(wide)
        cuts = []
        for k in range(1, size):
            part = first[k].cast(wide) * last[size - k].cast(wide)
            cuts.append(F.struct(F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * a * a, part).alias("score"), F.lit(k).alias("k"), first[k].alias("l"), last[size - k].alias("r")))
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        if size < longest:  # the longer ones that begin or end with it
            longer, names = levels[size], [f"w{j}" for j in range(size)]
            around = longer.select(*names, F.col("a").alias("of")).unionByName(longer.select(*(F.col(f"w{j + 1}").alias(f"w{j}") for j in range(size)), F.col("a").alias("of")))
            rows = rows.join(around.groupBy(names).agg(F.max("of").alias("of")), names, "left")
            rows = rows.where(F.col("of").isNull() | (100 * F.col("of") < absorbed * F.col("a")))
        rows = rows.select("lang", F.concat_ws(" ", *(F.col(f"s{j}") for j in range(size))).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        found = rows if found is None else found.unionByName(rows)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
