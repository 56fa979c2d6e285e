"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased and cut into words at ASCII and Latin-1 punctuation and
general punctuation. An item of L words is compared with windows of L words of
the documents. Both are multisets of 5-word shingles (an item of fewer words
is one shingle), each shingle weighted by how often it occurs; similarity is
the sum of the smaller weights over the sum of the larger ones, and a window
matches from ``threshold`` on.

1. *Windows.* A matching window holds so many of an item's shingles that it
   must hold one of any ``m - ceil(2 t m / (1 + t)) + 1`` of them (t the
   threshold, m the item's shingles). Those anchors are looked up in every
   document, and only windows around one are fingerprinted; a window without
   any can match nothing.
2. *Fingerprints.* The SimHash of a window: bit b is set if most shingles'
   hashes have it. The bits are counted three to a 64-bit sum, 21 bits apart.
3. *Multi-index blocks.* 63 bits are seven blocks of nine. Fingerprints within
   20 bits agree in at least one block up to two bits, so each item is indexed
   under the 46 values next to each of its blocks and no fingerprint within the
   radius is missed. Items are looked up among windows of their own size.
4. *Verification.* Exact weighted-shingle similarity decides.

At the threshold the expected distance is 11 bits with a standard deviation of
about 3, so the radius of 20 bits holds all but about one pair in a thousand
there, and more above it.

Everything runs on DataFrame functions. Anchors become literals of the plan
when there are at most ``MAX_LITERALS``; beyond that the documents' shingles
are joined with them.

Edge cases: null texts and items have no words and match nothing; a document
shorter than an item cannot match it; rows repeated in id and text are one
document; items with equal texts are reported each; null ids are reported as
they are, and a contaminated row without id is removed; of rows that share an
id only those whose text matches are removed; an empty benchmark matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import written

WIDTH = 5
THRESHOLD = 0.75
SPLIT = "[\\x00-/:-`{-\\u00bf\\u2000-\\u206f\\u3000-\\u303f]+"
BITS, LANES, LANE_BITS = 63, 3, 21
BLOCKS, BLOCK_BITS, BLOCK_RADIUS, RADIUS = 7, 9, 2, 20
MAX_LITERALS = 4096
#: Rows of the items' index below which it may be sent to every task.
BROADCAST_ROWS = 200_000


def with_words(text: Column, use) -> Column:
    """``use`` of the word list of a text; the list is made once."""
    def trimmed(w: Column) -> Column:
        first = (F.get(w, 0) == "").cast("int")
        last = (F.get(w, F.size(w) - 1) == "").cast("int")
        return F.when((first + last) > 0, F.slice(w, first + 1, F.greatest(F.size(w) - first - last, F.lit(0)))).otherwise(w)

    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT, -1)
    return F.get(F.transform(F.transform(F.array(parts), trimmed), use), 0)


def grams(words: Column, g: int, keep=None) -> Column:
    """Hashes of the g-word sequences of a word list, in order."""
    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(g)))

    places = F.when(F.size(words) >= g, F.sequence(F.lit(0), F.size(words) - g)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, at) if keep is None else F.exists(places, lambda i: keep(at(i)))


def grams_of(g: int, keep=None):
    return lambda words: grams(words, g, keep)


def simhash(shingles: Column) -> Column:
    """63-bit SimHash of a list of hashes, each occurrence counting once."""
    ones = sum(1 << (LANE_BITS * j) for j in range(LANES))
    half = F.size(shingles).cast("long")

    def lanes_from(k: int) -> Column:
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(ones)))

    counted = F.array(*(lanes_from(k) for k in range(LANE_BITS)))

    def bit(lanes: Column, k: int, j: int) -> Column:
        n = F.shiftrightunsigned(F.get(lanes, k), LANE_BITS * j).bitwiseAND(F.lit((1 << LANE_BITS) - 1))
        return F.when(n * 2 > half, F.lit(1 << (k + LANE_BITS * j)).cast("long")).otherwise(F.lit(0).cast("long"))

    def joined(lanes: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), (bit(lanes, k, j) for k in range(LANE_BITS) for j in range(LANES)))

    return F.get(F.transform(F.array(counted), joined), 0)


def block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def near_masks() -> list[int]:
    """All differences of a block up to the radius."""
    return [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= BLOCK_RADIUS]


def counts(shingles: Column) -> Column:
    return F.transform(F.array_distinct(shingles), lambda x: F.struct(x.alias("x"), F.size(F.filter(shingles, lambda y: y == x)).alias("n")))


def similarity(window: Column, item_counts: Column) -> Column:
    """Weighted Jaccard similarity of a window and an item, as many shingles each."""
    both = F.aggregate(item_counts, F.lit(0), lambda acc, c: acc + F.least(c["n"], F.size(F.filter(window, lambda y: y == c["x"]))))
    return both / (2 * F.size(window) - both)


def prepared_items(benchmark: DataFrame, threshold: float) -> DataFrame:
    """item_id, size (words), g, shingles, anchors, counts and fingerprint."""
    sized = benchmark.select("item_id", "text", with_words(F.col("text"), F.size).alias("size")).where("size > 0")
    sized = sized.withColumn("g", F.least(F.col("size"), F.lit(WIDTH)))
    shingles = F.lit(None).cast("array<long>")
    for g in range(1, WIDTH + 1):
        shingles = F.when(F.col("g") == g, with_words(F.col("text"), grams_of(g))).otherwise(shingles)
    made = written(sized.select("item_id", "size", "g", shingles.alias("shingles")), "items")
    m = F.size("shingles")
    shared = F.ceil(F.lit(2 * threshold / (1 + threshold)) * m - 1e-9)
    anchors = F.slice(F.array_sort("shingles"), 1, (m - shared + 1).cast("int"))
    return written(made.select("*", F.array_distinct(anchors).alias("anchors"), counts(F.col("shingles")).alias("counts"), simhash(F.col("shingles")).alias("fingerprint")), "items")


def is_in(wanted: list[int]):
    return lambda h: h.isin(wanted)


def touched(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Documents with an anchor: doc_id, t (hash of the text), g, shingles."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    n = anchors.count()
    parts = []
    for g in sorted(r["g"] for r in anchors.select("g").distinct().collect()):  # 1 to 5
        own = anchors.where(F.col("g") == g).select("h")
        if n <= MAX_LITERALS:
            found = keyed.where(with_words(F.col("text"), grams_of(g, is_in([r["h"] for r in own.collect()]))))
        else:
            hits = keyed.select("doc_id", "t", F.explode(with_words(F.col("text"), grams_of(g))).alias("h"))
            hits = hits.join(own, "h", "left_semi").select("doc_id", "t").distinct()
            found = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits["doc_id"]) & (keyed["t"] == hits["t"]), "left_semi")
        parts.append(found.select("doc_id", "t", F.lit(g).alias("g"), with_words(F.col("text"), grams_of(g)).alias("shingles")))
    return reduce(DataFrame.unionByName, parts)


def text_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, t (hash of the text), item_id, start, words, similarity of the
    best window of each distinct (id, text) and item that match."""
    spark = docs.sparkSession
    items = prepared_items(benchmark, threshold)
    anchors = written(items.select("g", F.explode("anchors").alias("h"), "size").distinct(), "anchors")
    kinds = anchors.select("g", "h").distinct()
    if items.isEmpty():
        doc, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
        return spark.createDataFrame([], f"doc_id {doc}, t long, item_id {item}, start int, words int, similarity double")
    held = written(touched(docs, kinds).dropDuplicates(["doc_id", "t", "g"]).withColumn("uid", F.xxhash64("doc_id", "t", "g")), "touched")
    hits = held.select("uid", "g", F.size("shingles").alias("n"), F.posexplode("shingles").alias("p", "h"))
    hits = hits.join(anchors, ["g", "h"]).withColumn("m", F.col("size") - F.col("g") + 1).where("n >= m")
    first, last = F.greatest(F.col("p") - F.col("m") + 1, F.lit(0)), F.least(F.col("p"), F.col("n") - F.col("m"))
    starts = hits.where(first <= last).select("uid", "size", "m", F.explode(F.sequence(first, last)).alias("start")).distinct()
    windows = starts.join(held.select("uid", "doc_id", "shingles"), "uid")
    windows = windows.select("uid", "doc_id", "size", "start", F.slice("shingles", F.col("start") + 1, F.col("m")).alias("window"))
    windows = written(windows.withColumn("fingerprint", simhash(F.col("window"))), "windows")
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), block(F.col("fingerprint"), i).alias("value")) for i in range(BLOCKS)))
    masks = F.array(*(F.lit(x) for x in near_masks()))
    probes = windows.select("uid", "size", "start", "fingerprint", F.explode(blocks).alias("b")).select("uid", "size", "start", "fingerprint", "b.*")
    index = items.select("item_id", "size", F.col("fingerprint").alias("item_fingerprint"), F.explode(blocks).alias("b"))
    index = index.select("item_id", "size", "item_fingerprint", "b.block", F.explode(F.transform(masks, lambda x: F.col("b.value").bitwiseXOR(x))).alias("value"))
    if items.count() * BLOCKS * len(near_masks()) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS
    pairs = probes.join(index, ["size", "block", "value"]).where(close).select("uid", "size", "start", "item_id").distinct()
    pairs = pairs.join(windows.select("uid", "doc_id", "size", "start", "window"), ["uid", "size", "start"]).join(items.select("item_id", "size", "counts"), ["item_id", "size"])
    judged = pairs.select("uid", "doc_id", "item_id", "start", "size", similarity(F.col("window"), F.col("counts")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = judged.groupBy("uid", "doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "start", "size")).alias("b"))
    best = best.join(held.select("uid", "t"), "uid")
    return best.select("doc_id", "t", "item_id", "b.start", F.col("b.size").alias("words"), (-F.col("b.far")).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word), words, similarity of the best window
    (the first of equals) of each document and item that match."""
    each = text_matches(docs, benchmark, threshold)
    return each.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("far"), "start", "words")).alias("b")).select(
        "doc_id", "item_id", "b.start", "b.words", (-F.col("b.far")).alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that match an item, told apart by id and
    text: a row without id goes if its text matches, and a clean row stays where
    another text has its id."""
    found = text_matches(docs, benchmark, threshold).select(F.col("doc_id").alias("_curata_id"), F.col("t").alias("_curata_t")).distinct()
    kept = docs.withColumn("_curata_hash", F.xxhash64("text"))
    same = kept["doc_id"].eqNullSafe(found["_curata_id"]) & (kept["_curata_hash"] == found["_curata_t"])
    return kept.join(found, same, "left_anti").select(docs.columns)
