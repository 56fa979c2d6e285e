"""Source divergence audit: how far the word use of each source is from that
of the other sources of its language, and by which terms.

0. Texts are cut into terms once, and the terms of each share of texts are
   written in two forms. For counts: a term that a group uses c times in the
   share stands in the rows of the group whose weights, powers of 2, add up to
   c. For document frequencies: a term in d documents of the share stands in
   min(d, ``min_df``) rows. The rows of all shares with a term are ``min_df`` or
   more exactly if the documents with it are.
1. ``CountVectorizer`` with ``minDF`` and the largest integer as ``vocabSize``
   is fitted on the rows for frequencies and turns each row for counts into a
   sparse vector. A term carries its language, so one fit gives every language
   its own vocabulary and counts document frequencies within the language. What
   a fit holds on the driver and sends to the tasks is bounded: beyond
   ``block_terms`` distinct terms (by HyperLogLog) the terms are dealt to blocks
   by their hash, and each block is fitted on its own share of the tokens. A
   row of ``min_df`` documents with an empty term keeps a fit from failing where
   nothing is frequent. The vocabulary is read from the saved model, not
   through the driver's Python.
2. Group sums: each task adds up its sparse vectors times their weights by
   group and index, as a summarizer does, and Spark the sums of the tasks.
3. Sparse pair evaluation: for sources s, t of a language the sum over all V
   kept terms is V f(p0_s, p0_t), where p0 is the value of a count of 0, plus
   for each source a correction by its distinct counts (their histogram
   against the p0 of every other source), plus a correction for each term
   that both use. Terms that neither uses are never touched, and no pair is a
   row before its sum over a task's terms.

Exact arithmetic: counts and shares go through decimals, the rest are 64-bit
integers below 2**62.

Edge cases: null text, lang and source read as ''; a group without kept terms
is there with count 0 for each term; a language without kept terms gives its
pairs the value 0 and no term rows; a source that is alone in its language has
no pair rows; an empty table gives no rows; extra columns are ignored;
repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curata.llm.common import chunks, give_back, partitions, texts_of, written
from curata.session import scratch_path

#: The pattern of a term, as SQL reads it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DF = 10
TOP_TERMS = 10
#: Distinct terms of a block of the vocabulary.
BLOCK_TERMS = 4_000_000
#: Pairs of one source and another that a task evaluates at once.
PAIRS = 1 << 20
#: Bytes of text whose terms are counted together.
SHARE_BYTES = 4 << 20
#: Terms of a row at most.
ROW_TERMS = 1 << 10
#: Entries of vectors that a task sums at once.
ENTRIES = 1 << 21
#: Ends the language in a tagged term; no term holds it.
MARK = "\x01"
SCALE = 1_000_000_000

#: A byte as it stands in a term, or a blank.
_TERM_BYTE = np.full(256, 32, np.uint8)
_TERM_BYTE[97:123] = _TERM_BYTE[65:91] = range(97, 123)
_TERM_BYTE[128:] = range(128, 256)


def cut_terms(texts: pa.Array) -> pa.Array:
    """Terms of each text (a large_string array from offset 0 without nulls)."""
    raw = texts.buffers()[2]
    if raw is None:
        return pa.array([[]] * len(texts), pa.large_list(pa.large_string()))
    blank = pa.py_buffer(_TERM_BYTE[np.frombuffer(raw, np.uint8)].tobytes())
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, texts.buffers()[1], blank])
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    # a text without a term gives one empty string
    offsets, flat = np.asarray(parts.offsets).astype(np.int64), parts.flatten()
    there = np.asarray(pc.binary_length(flat)) > 0
    kept = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
    return pa.LargeListArray.from_arrays(pa.array(kept), flat.filter(pa.array(there)))


def group_id(lang: Column, source: Column, seed: int) -> Column:
    return F.xxhash64(lang, source, F.lit(seed))


def groups_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """lang, source and gid of each group, and the seed that gives no two
    groups one gid."""
    found = docs.select("lang", "source").distinct()
    seed = 0
    while True:
        groups = written(found.withColumn("gid", group_id(F.col("lang"), F.col("source"), seed)), "groups")
        if groups.groupBy("gid").count().where("count > 1").isEmpty():
            return groups, seed
        seed += 1


def _term_rows(owner: np.ndarray, terms: pa.Array, gids: pa.Array, weight: int) -> pa.RecordBatch:
    """Rows of the terms of each owner (ascending), with the owner's gid."""
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    head = np.flatnonzero(place % ROW_TERMS == 0)
    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(owner)), pa.int32()), terms)
    return pa.RecordBatch.from_arrays([gids.take(pa.array(owner[head])), pa.array([weight] * len(head), pa.int64()), lists], ["gid", "weight", "terms"])


def _share_rows(share: pa.RecordBatch, min_df: int):
    """Rows for counts and for document frequencies (without gid) of some texts."""
    terms = cut_terms(texts_of(share))
    times = np.diff(np.asarray(terms.offsets))
    coded = terms.flatten().dictionary_encode()
    words, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    if not len(code):
        return
    langs, n = share.column("lang").cast(pa.large_string()), len(words)

    def tagged(docs: np.ndarray, codes: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(langs.take(pa.array(docs)), words.take(pa.array(codes)), pa.scalar(MARK, pa.large_string())).cast(pa.string())

    gids, first, group = np.unique(np.asarray(share.column("gid")), return_index=True, return_inverse=True)
    key, count = np.unique(np.repeat(group.astype(np.int64) * n, times) + code, return_counts=True)
    group, own = key // n, tagged(first[key // n], key % n)
    for bit in range(int(count.max()).bit_length()):
        has = count >> bit & 1 > 0
        if has.any():
            yield _term_rows(group[has], own.filter(pa.array(has)), pa.array(gids), 1 << bit)
    del own, group, count

    key = np.unique(np.repeat(np.arange(len(times)) * n, times) + code)
    coded = langs.dictionary_encode()
    lang = np.asarray(coded.indices).astype(np.int64)
    key, docs = np.unique(lang[key // n] * n + key % n, return_counts=True)
    first = np.unique(lang, return_index=True)[1]
    seen = tagged(first[key // n], key % n)
    for least in range(max(1, min_df)):
        has = docs > least
        if has.any():
            yield _term_rows(np.zeros(int(has.sum()), np.int64), seen.filter(pa.array(has)), pa.array([None], pa.int64()), least)


def tagged_terms(docs: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """Terms, each behind its language, in rows for counts (gid, weight) and
    rows for document frequencies (no gid; those of weight 0 hold every term)."""

    def cut(batches):
        held: list = []
        size = 0

        def rows():
            shares = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            for share in shares:
                yield from _share_rows(share, min_df)
                give_back()

        for batch in batches:
            for part in chunks(batch):
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py()
                if size >= SHARE_BYTES:
                    yield from rows()
                    size = 0
        if held:
            yield from rows()

    return docs.select("gid", "lang", "text").mapInArrow(cut, "gid long, weight long, terms array<string>")


def blocks_for(tokens: DataFrame, block_terms: int) -> int:
    seen = tokens.where("gid is null and weight = 0").select(F.explode("terms").alias("t"))
    seen = seen.agg(F.approx_count_distinct("t", 0.05).alias("n")).first()["n"]
    return max(1, -(-int(seen * 1.1) // block_terms))


def count_vectors(tokens: DataFrame, min_df: int = MIN_DF) -> tuple[DataFrame, CountVectorizerModel]:
    """gid, weight and sparse vector of each row for counts, and the model (its
    vocabulary holds the empty term)."""
    spark = tokens.sparkSession
    fill = spark.range(min_df).select(F.array(F.lit(MARK)).alias("terms"))
    seen = tokens.where("gid is null").select("terms").unionByName(fill)
    model = CountVectorizer(inputCol="terms", outputCol="vec", minDF=float(min_df), vocabSize=2**31 - 1).fit(seen)
    return model.transform(tokens.where("gid is not null")).select("gid", "weight", "vec"), model


def vocabulary_of(model: CountVectorizerModel, spark: SparkSession) -> DataFrame:
    """idx and tagged term, from the files of the saved model."""
    path = scratch_path(spark, "model")
    model.save(path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("idx", "tagged"))


def _vector_sums(batches):
    """Sums of the sparse vectors (gid, weight, vec) of a task by group and
    index, in runs of a bounded number of entries."""
    held: list = []
    size = 0

    def rows():
        gid, idx, count = (np.concatenate(x) for x in zip(*held, strict=True))
        names, code = np.unique(gid, return_inverse=True)
        key = code.astype(np.int64) << 32 | idx
        order = np.argsort(key)
        head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        held[:] = [(names[key[order[head]] >> 32], idx[order[head]], np.add.reduceat(count[order], head))]
        return len(head)

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gid", "idx", "count"])

    for batch in batches:
        vec = batch.column("vec")
        indices, values = vec.field("indices"), vec.field("values")
        times = np.diff(np.asarray(indices.offsets))
        if not times.sum():
            continue
        gid, weight = (np.repeat(np.asarray(batch.column(k)), times) for k in ("gid", "weight"))
        held.append((gid, np.asarray(indices.flatten()).astype(np.int64), np.asarray(values.flatten()).astype(np.int64) * weight))
        size += int(times.sum())
        if size > ENTRIES:
            size = rows()
            if size > ENTRIES // 2:
                yield sent()
                held.clear()
                size = 0
    if held:
        rows()
        yield sent()
    held.clear()
    give_back()


def group_sums(docs: DataFrame, min_df: int = MIN_DF, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms by group (gid, block, idx, count), and the
    vocabulary (lang, term, block, idx)."""
    spark, tokens = docs.sparkSession, written(tagged_terms(docs, min_df), "tokens")
    blocks = blocks_for(tokens, block_terms)
    if blocks > 1:
        own = F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int").alias("block")
        dealt = tokens.withColumn("row", F.monotonically_increasing_id()).select("gid", "weight", "row", F.explode("terms").alias("t"))
        dealt = written(dealt.groupBy("gid", "weight", "row", own).agg(F.collect_list("t").alias("terms")).repartition(F.col("block"), F.col("row")), "tokens")
        shares = [dealt.where(F.col("block") == b).select("gid", "weight", "terms") for b in range(blocks)]
    else:
        shares = [tokens]
    sums, words = None, None
    for b, share in enumerate(shares):
        vectors, model = count_vectors(share, min_df)
        entries = vectors.mapInArrow(_vector_sums, "gid long, idx long, count long")
        own = entries.groupBy("gid", F.col("idx").cast("int").alias("idx")).agg(F.sum("count").alias("count")).withColumn("block", F.lit(b))
        named = vocabulary_of(model, spark).where(F.col("tagged") != MARK)
        end = F.length("tagged") - F.length(F.substring_index("tagged", MARK, -1))
        named = named.select(F.col("tagged").substr(F.lit(1), end - 1).alias("lang"), F.substring_index("tagged", MARK, -1).alias("term"), F.lit(b).alias("block"), "idx")
        own, named = written(own, "sums"), written(named, "vocabulary")
        sums, words = (own, named) if sums is None else (sums.unionByName(own), words.unionByName(named))
    return sums, words


#: Below it, 10**9 (count + 2) is a 64-bit integer.
SMALL_COUNT = 9_000_000_000


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 V)), without rounding."""
    all_of = total + 2 * v
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(24,0)") + F.lit(2).cast("decimal(2,0)"))
    small = F.call_function("div", F.lit(SCALE).cast("long") * (count + 2), all_of)
    return F.when(count < SMALL_COUNT, small).otherwise(F.call_function("div", wide, all_of.cast("decimal(24,0)"))) + F.lit(1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _histogram_rows(batches):
    """From the distinct shares of a source and the p0 of all sources of its
    language: for each other source V f(p0, p0') and the correction of the
    terms of the source, in both orders."""
    for batch in batches:
        for row in batch.to_pylist():
            p = np.array([x["p"] for x in row["steps"]], np.int64)
            n = np.array([x["n"] for x in row["steps"]], np.int64)
            other = np.array([x["gid"] for x in row["others"]], np.int64)
            q = np.array([x["p0"] for x in row["others"]], np.int64)
            other, q = other[other != row["gid"]], q[other != row["gid"]]
            for a in range(0, len(other), max(1, PAIRS // max(len(p), 1))):
                b = a + max(1, PAIRS // max(len(p), 1))
                base = _far(np.full(len(q[a:b]), row["p0"], np.int64), q[a:b])
                mend = ((_far(p[:, None], q[None, a:b]) - base[None]) * n[:, None]).sum(axis=0)
                own, others = np.full(len(base), row["gid"], np.int64), other[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, others])), pa.array(np.concatenate([others, own])),
                                                  pa.array(np.concatenate([row["v"] * base + mend, mend]))], ["gid", "other", "value"])


def _whole_terms(batches):
    """idx, gid, p, p0 of the entries, sorted by block and term, in pieces that
    hold all entries of each of their terms."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)).astype(np.int64) for k in ("block", "idx", "gid", "p", "p0")]
        held = columns if not held else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        before = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
        if len(before):  # the last term may go on
            yield _numbered([x[:before[-1] + 1] for x in held])
            held = [x[before[-1] + 1:] for x in held]
    if held:
        yield _numbered(held)


def _numbered(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The terms numbered in order instead of (block, idx)."""
    block, idx, *rest = columns
    new = np.concatenate([[False], (block[1:] != block[:-1]) | (idx[1:] != idx[:-1])])
    return [np.cumsum(new), *rest]


def _both_used(batches):
    """Corrections for the terms that two sources both use, summed over the
    terms of a task (its rows sorted by block and idx): gid, other, value."""
    held: list = []

    def merged(parts):
        key = np.concatenate([k for k, _ in parts], axis=1)
        value = np.concatenate([v for _, v in parts])
        order = np.lexsort(key)
        key, value = key[:, order], value[order]
        head = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(value) else np.zeros(0, np.int64)
        return key[:, head], np.add.reduceat(value, head) if len(head) else value

    def summed(gid, left, right, value):
        # entries of both sides; a run may begin or end within a term
        at, end = (min(left.min(), right.min()), max(left.max(), right.max()) + 1) if len(left) else (0, 0)
        names, code = np.unique(gid[at:end], return_inverse=True)
        n = len(names)
        if n * n > PAIRS:
            return merged([(np.stack([gid[left], gid[right]]), value)])
        # sums of integers below 2**53 are exact in doubles
        key = code[left - at] * n + code[right - at]
        total, used = np.bincount(key, value, n * n), np.bincount(key, minlength=n * n)
        found = np.flatnonzero(used)
        return np.stack([names[found // max(n, 1)], names[found % max(n, 1)]]), np.rint(total[found]).astype(np.int64)

    def rows():
        key, value = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(value)], ["gid", "other", "value"])

    for columns in _whole_terms(batches):
        idx, gid, p, p0 = columns
        begin = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1]]))
        size = np.diff(np.append(begin, len(idx)))
        # each entry meets all entries of its term, in runs of entries of a bounded number of pairs
        first, many = np.repeat(begin, size), np.repeat(size, size)
        ends = np.cumsum(many)
        a = 0
        while a < len(gid):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
            left = np.repeat(np.arange(a, b), many[a:b])
            stop = np.cumsum(many[a:b])
            right = np.repeat(first[a:b], many[a:b]) + np.arange(len(left)) - np.repeat(stop - many[a:b], many[a:b])
            both = left != right
            left, right = left[both], right[both]
            value = _far(p[left], p[right]) - _far(p[left], p0[right]) - _far(p0[left], p[right]) + _far(p0[left], p0[right])
            held.append(summed(gid, left, right, value))
            if sum(len(v) for _, v in held) > PAIRS:
                held[:] = [merged(held)]
                if len(held[0][1]) > PAIRS:
                    yield rows()
                    held.clear()
            a = b
    if held:
        yield rows()
    held.clear()
    give_back()


def divergence(docs: DataFrame, min_df: int = MIN_DF, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the other
    sources of its language (part ``pair``), and its terms that are more
    frequent than in the language (part ``term``)."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    found, seed = groups_of(docs)
    sums, words = group_sums(docs.withColumn("gid", group_id(F.col("lang"), F.col("source"), seed)), min_df, block_terms)
    sizes = words.groupBy("lang").agg(F.count("*").alias("v"))
    totals = sums.groupBy("gid").agg(F.sum("count").alias("n"))
    groups = found.join(totals, "gid", "left").join(sizes, "lang", "left").fillna(0, ["n", "v"])
    p0 = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1))
    groups = written(groups.select("*", p0.alias("p0")), "groups")

    of_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    shares = sums.join(groups.select("gid", "n", "v", "p0"), "gid").withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    shares = written(shares.select("gid", "block", "idx", "count", "p", "p0"), "shares")
    whole = shares.groupBy("block", "idx").agg(F.sum("count").alias("lang_count")).join(words.hint("merge"), ["block", "idx"]).join(sizes, "lang").join(of_lang, "lang")
    whole = whole.select("block", "idx", "term", share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"))

    # pairs
    steps = shares.groupBy("gid", "p").agg(F.count("*").alias("n")).groupBy("gid").agg(F.collect_list(F.struct("p", "n")).alias("steps"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("gid", "p0")).alias("others"))
    no_steps = F.array().cast("array<struct<p: bigint, n: bigint>>")
    base = groups.join(steps, "gid", "left").join(others, "lang").select("gid", "p0", "v", F.coalesce("steps", no_steps).alias("steps"), "others")
    pairs = base.repartition(partitions(docs.sparkSession), "gid").mapInArrow(_histogram_rows, "gid long, other long, value long")
    entries = shares.select("block", "idx", "gid", "p", "p0").repartition("block", "idx").sortWithinPartitions("block", "idx")
    pairs = pairs.unionByName(entries.mapInArrow(_both_used, "gid long, other long, value long"))
    pairs = pairs.groupBy("gid", "other").agg(F.sum("value").alias("value"))
    named = groups.select("gid", "lang", "source")
    pairs = pairs.join(named, "gid").join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")

    # terms
    terms = shares.join(whole.hint("merge"), ["block", "idx"]).where("p > q")
    terms = terms.select("gid", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")).join(named, "gid")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order)).select(columns)
    terms = terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms).select(columns)
    return pairs.unionByName(terms)
