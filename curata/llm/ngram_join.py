"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct 5-word shingles. Two documents link when
``100 * |A and B| >= 75 * |A or B|``. The result gives each document its set
size and the smallest id that links lead to.

1. *Rare shingles.* Every shingle's count over all documents is found in
   packed segments (:mod:`packed`). A document of n shingles can only link if
   at least ``ceil(0.75 n)`` of them occur elsewhere too; all others are done.
   The rest are remembered in a Bloom filter of fixed size; a false hit costs
   a little work and changes nothing.
2. *Prefixes.* Documents with equal sets are one node. Over the nodes left,
   shingles are ordered by how many nodes hold them, then by hash. Linked sets
   share a shingle of their first ``n - ceil(0.75 n) + 1``. Shingles of one
   node alone come first in this order and match nothing, so a node with that
   many of them is done.
3. *Groups.* Nodes with equal size and equal prefix are one group and send
   each prefix shingle once.
4. *Pairs.* First each group meets, per prefix shingle, only a hub, the group
   with the fewest shingles of its own (and each node its own group's first):
   linear in the sizes of the buckets. The pairs are verified on their whole
   sets, and links tell which nodes are together. Then, exactly, whatever
   members of groups share a prefix shingle and are not known to be together,
   and can link by size, by position and by the parity of their hashes (an
   upper bound of the intersection), are verified. In a bucket only members
   outside its largest part meet the others, so a large group of near copies
   makes no square of pairs, and no link between components is lost.

Shingles, and sets as nodes, are told apart by 64-bit hashes.

Edge cases: a text with fewer words than five is one shingle, its whole word
sequence; without words the set is empty and links nothing; a null text is
empty; a null id gets its set size and a null component and links nothing;
rows with one id and different texts are documents of their own, which both
give their id to their component.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm import packed as P
from curata.llm.common import chunks, give_back, id_list, text_bytes, texts_of, written
from curata.llm.components import components

WIDTH = 5
#: Links need 7 * intersection >= 3 * (sum of sizes), which is a Jaccard similarity of 0.75.
SUM_SHARE, INTER_SHARE = 3, 7
#: Longs of the parity bits that bound an intersection from above.
LANES = 16
#: Bits of the Bloom filters (sent to every task).
BLOOM_BITS = 1 << 26
_OUT = pa.schema([("place", pa.int32()), ("kind", pa.int8()), ("blob", pa.binary())])
_SCHEMA = "place int, kind byte, blob binary"


def needed(n):
    """Shingles that a set of n must share with any partner: ceil(3 n / 4)."""
    return (3 * n + 3) // 4


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the texts' offsets."""
    raw, start, end, offsets = P.word_spans(texts)
    words = P.word_hashes(raw, start, end, lower=True)
    n_words = np.diff(offsets)
    n = np.where(n_words >= WIDTH, n_words - WIDTH + 1, (n_words > 0).astype(np.int64))
    first = np.repeat(offsets[:-1], n) + P._counted(n)
    hashes, _ = P.window_hashes(words, first, first + np.repeat(np.minimum(n_words, WIDTH), n))
    at = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][n > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _segment(hashes: np.ndarray, n: int) -> np.ndarray:
    return (P.mix(hashes ^ P.U(0x5851F42D4C957F2D)) % P.U(n)).astype(np.int64)


def _rows(rows) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int8()), pa.array(c, pa.binary())], schema=_OUT)


class Bloom:
    """Two bits for each id, in a fixed number of bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(ids: DataFrame, column: str, bits: int = BLOOM_BITS) -> Bloom:
        """Built in Spark: at most bits / 64 words reach the driver."""
        h = F.xxhash64(F.col(column).cast("long"))
        places = F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 21), F.lit(bits)))
        at = ids.select(F.explode(F.array_distinct(places)).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toPandas()
        out = np.zeros(bits >> 6, np.int64)
        out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
        return Bloom(out.view(P.U))

    def has(self, ids: np.ndarray) -> np.ndarray:
        h = P.xxhash64(ids)
        bits = len(self.words) << 6
        found = np.ones(len(ids), bool)
        for p in (h % bits, (h >> 21) % bits):
            found &= (self.words[p >> 6] >> (p & 63).astype(P.U)) & P.U(1) == 1
        return found


class _Packer:
    """Entries (id, hash) of a map task, packed for their segments. Entries
    with equal hashes in one task are settled here: they tell ``tell`` and send
    one entry."""

    def __init__(self, segments: int, tell):
        self.segments, self.tell = segments, tell
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray, hashes: np.ndarray):
        self.held.append((ids, hashes))
        self.size += len(ids)
        if self.size >= P.FLUSH:
            yield self.rows()

    def rows(self) -> pa.RecordBatch:
        held, self.held, self.size = self.held, [], 0
        ids = np.concatenate([i for i, _ in held]) if held else np.zeros(0, np.int64)
        hashes = np.concatenate([h for _, h in held]) if held else np.zeros(0, P.U)
        del held
        return _rows(self.tell(ids, hashes))


def _shared_counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, and for each entry in it the number of entries with its
    hash and whether it is the first of them."""
    order = np.argsort(hashes, kind="stable")
    head, length = P.runs_of(hashes[order])
    first = np.zeros(len(hashes), bool)
    first[head] = True
    return order, np.repeat(length, length), first


def frequent_documents(docs: DataFrame, segments: int, buckets: int) -> DataFrame:
    """Each row's doc_id, n_shingles, and ``open``: whether enough of its
    shingles occur in other rows too."""

    def scan(batches):
        def tell(ids, hashes):
            order, count, first = _shared_counts(hashes)
            known = np.zeros(len(ids), np.uint32)
            known[order[count > 1]] = 1
            rows = counted(ids[known > 0], 1)
            # a hash that several rows here hold is sent once, without an id: they count it already
            for kind, sent in ((0, order[first & (count == 1)]), (3, order[first & (count > 1)])):
                owner = ids[sent] if kind == 0 else np.zeros(len(sent), np.int64)
                rows += [(k, kind, P.pack(owner[i], hashes[sent[i]])) for k, i in P.dealt(_segment(hashes[sent], segments), segments)]
            return rows

        def counted(ids, kind):
            """Ids and their counts, by bucket of ids (sent through any segment)."""
            u, n = np.unique(ids, return_counts=True)
            return [(k % segments, kind, P.pack(u[i], n[i].astype(np.uint32))) for k, i in P.dealt(P.xxhash64(u) % buckets, buckets)]

        packer, sizes, held = _Packer(segments, tell), [], 0
        for batch in batches:
            for part in chunks(batch):
                ids, there = id_list(part.column("doc_id"))
                hashes, offsets = shingle_sets(texts_of(part))
                n = np.diff(offsets)
                sizes.append((ids[there], n[there].astype(np.uint32)))
                held += len(ids)
                own = np.repeat(there, n)
                yield from packer.add(np.repeat(ids, n)[own], hashes[own])
                if held >= 50_000:
                    yield _rows(size_rows(sizes))
                    sizes, held = [], 0
        yield packer.rows()
        yield _rows(size_rows(sizes))
        give_back()

    def size_rows(sizes):
        if not sizes:
            return []
        ids, n = (np.concatenate(x) for x in zip(*sizes, strict=True))
        return [(k % segments, 2, P.pack(ids[i], n[i])) for k, i in P.dealt(P.xxhash64(ids) % buckets, buckets)]

    def settle(segment: pa.Table) -> pa.Table:
        kinds, blobs = np.asarray(segment.column("kind")), segment.column("blob").to_pylist()
        ids, hashes = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 0], np.uint64)
        settled = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 3], np.uint64)[1]
        order, count, _ = _shared_counts(np.concatenate([hashes, settled]))
        shared = order[count > 1]
        u, n = np.unique(ids[shared[shared < len(ids)]], return_counts=True)
        rows = [(k, 1, P.pack(u[i], n[i].astype(np.uint32))) for k, i in P.dealt(P.xxhash64(u) % buckets, buckets)]
        for kind in (1, 2):  # on their way to the buckets
            ids, n = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == kind], np.uint32)
            rows += [(k, kind, P.pack(ids[i], n[i])) for k, i in P.dealt(P.xxhash64(ids) % buckets, buckets)]
        del blobs, ids, hashes, settled, order, count, shared
        give_back()
        return pa.Table.from_batches([_rows(rows)])

    def judge(bucket: pa.Table) -> pa.Table:
        kinds, blobs = np.asarray(bucket.column("kind")), bucket.column("blob").to_pylist()
        ids, n = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 2], np.uint32)
        told, counts = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 1], np.uint32)
        u, at = np.unique(np.concatenate([ids, told]), return_inverse=True)
        shared = np.bincount(at[len(ids):], counts.astype(np.float64), len(u))[at[:len(ids)]]
        n = n.astype(np.int64)
        # rows that repeat an id add up their counts, which only errs to the open side
        return pa.table({"doc_id": ids, "n_shingles": n, "open": (n > 0) & (shared >= needed(n))})

    found = docs.select("doc_id", "text").mapInArrow(scan, _SCHEMA).groupBy("place").applyInArrow(settle, _SCHEMA)
    return found.groupBy("place").applyInArrow(judge, "doc_id long, n_shingles long, open boolean")


def node_prefixes(docs: DataFrame, bloom: Bloom, segments: int, buckets: int) -> DataFrame:
    """A table of two kinds of rows. kind 0: each open row's doc_id, n, node.
    kind 1: for each node that may link its node, n, u (shingles of no other
    node) and the rest of its prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)  # a fixed number of bits

    def scan(batches):
        def tell(ids, hashes):
            return [(k, 0, P.pack(ids[i], hashes[i])) for k, i in P.dealt(_segment(hashes, segments), segments)]

        packer, seen = _Packer(segments, tell), set()
        for batch in batches:
            for part in open_rows(batch, sent.value):
                hashes, offsets = shingle_sets(texts_of(part))
                ids, _ = id_list(part.column("doc_id"))
                n = np.diff(offsets)
                nodes = np.array([set_id(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
                full = n > 0
                rows = [(k, 1, P.pack(nodes[full][i], n[full][i].astype(np.uint32), ids[full][i])) for k, i in P.dealt(P.xxhash64(nodes[full]) % segments, segments)]
                yield _rows(rows)
                # equal sets are sent once by a task; the segments drop what other tasks repeat
                new = np.array([f and not (x in seen or seen.add(x)) for x, f in zip(nodes.tolist(), full, strict=True)], bool)
                if len(seen) > 200_000:
                    seen.clear()
                own = np.repeat(new, n)
                yield from packer.add(np.repeat(nodes, n)[own], hashes[own])
        yield packer.rows()
        give_back()

    def settle(segment: pa.Table) -> pa.Table:
        kinds, blobs = np.asarray(segment.column("kind")), segment.column("blob").to_pylist()
        nodes, hashes = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 0], np.uint64)
        order = np.lexsort((nodes, hashes))
        nodes, hashes = nodes[order], hashes[order]
        new = np.ones(len(nodes), bool)
        new[1:] = (nodes[1:] != nodes[:-1]) | (hashes[1:] != hashes[:-1])
        nodes, hashes = nodes[new], hashes[new]
        head, length = P.runs_of(hashes)
        count = np.repeat(length, length)
        many = count > 1
        nodes, hashes, count = nodes[many], hashes[many], count[many].astype(np.uint32)
        rows = [(k, 0, P.pack(nodes[i], hashes[i], count[i])) for k, i in P.dealt(P.xxhash64(nodes) % buckets, buckets)]
        nodes, n, ids = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 1], np.uint32, np.int64)
        rows += [(k, 1, P.pack(nodes[i], n[i], ids[i])) for k, i in P.dealt(P.xxhash64(nodes) % buckets, buckets)]
        return pa.Table.from_batches([_rows(rows)])

    def prefixes(bucket: pa.Table) -> pa.Table:
        kinds, blobs = np.asarray(bucket.column("kind")), bucket.column("blob").to_pylist()
        nodes, hashes, count = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 0], np.uint64, np.uint32)
        row_nodes, row_n, ids = P.unpack_all([b for b, k in zip(blobs, kinds, strict=True) if k == 1], np.uint32, np.int64)
        order = np.lexsort((hashes, count, nodes))
        nodes, hashes = nodes[order], hashes[order].view(np.int64)
        own, at = np.unique(row_nodes, return_index=True)
        n = row_n[at].astype(np.int64)
        a, b = np.searchsorted(nodes, own), np.searchsorted(nodes, own, side="right")
        u = n - (b - a)
        take = np.maximum(n - needed(n) + 1 - u, 0)
        lists = [hashes[x:x + t] for x, t in zip(a[take > 0], take[take > 0], strict=True)]
        k = len(lists)
        links = take > 0
        return pa.table({
            "kind": pa.array([0] * len(ids) + [1] * k, pa.int8()), "doc_id": pa.concat_arrays([pa.array(ids), pa.nulls(k, pa.int64())]),
            "node": np.concatenate([row_nodes, own[links]]), "n": np.concatenate([row_n.astype(np.int64), n[links]]),
            "u": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(u[links])]),
            "prefix": pa.concat_arrays([pa.nulls(len(ids), pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.int64()))])})

    found = docs.select("doc_id", "text").mapInArrow(scan, _SCHEMA).groupBy("place").applyInArrow(settle, _SCHEMA)
    return found.groupBy("place").applyInArrow(prefixes, "kind byte, doc_id long, node long, n long, u long, prefix array<long>")


def open_rows(batch: pa.RecordBatch, bloom: Bloom):
    ids, there = id_list(batch.column("doc_id"))
    batch = batch.filter(pa.array(there & bloom.has(ids)))
    yield from chunks(batch)


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * LANES cells, whether an odd number of the hashes falls
    into it, as LANES longs. Where two sets' cells differ, at least as many
    elements are in one of them only."""
    odd = np.bincount((hashes >> P.U(40)).astype(np.int64) % (64 * LANES), minlength=64 * LANES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def sets_of(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """Rows (node, doc_id, hashes, bits) of the documents that the filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def scan(batches):
        for batch in batches:
            for part in open_rows(batch, sent.value):
                hashes, offsets = shingle_sets(texts_of(part))
                own = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(h) for h in own], pa.int64()), part.column("doc_id"), pa.array([h.tobytes() for h in own], pa.binary()),
                     pa.array([parity(h) for h in own], pa.list_(pa.int64()))], ["node", "doc_id", "hashes", "bits"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(scan, "node long, doc_id long, hashes binary, bits array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def linked(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), P.U) for v in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                inter = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                good.append(INTER_SHARE * inter >= SUM_SHARE * (len(x) + len(y)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])
        give_back()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(linked, "a long, b long")


def _sizes_allow(n: Column, m: Column) -> Column:
    return (4 * n >= 3 * m) & (4 * m >= 3 * n)


def links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Component of each node that links: node, component. ``nodes`` has node,
    n, u, prefix and ``sets`` their node, hashes and bits; both are written
    tables."""
    prefix = F.when(F.col("u") == 0, F.xxhash64("prefix")).otherwise(F.col("node"))
    grouped = nodes.select("node", "n", "u", "prefix", prefix.alias("same"))
    # equal size and prefix: one group, named by its smallest node
    names = grouped.groupBy("n", "same").agg(F.min("node").alias("gid"), F.count("*").alias("members"))
    members = written(grouped.join(names, ["n", "same"]).drop("same"), "members")
    tokens = members.where("node = gid").select("gid", "n", "u", "members", F.posexplode("prefix").alias("pos", "h"))
    tokens = tokens.select("h", "gid", "n", "u", "members", (F.col("pos") + F.col("u")).alias("pos"))
    # The hub of a shingle is the group with the fewest shingles of its own,
    # the likeliest to be what the others were copied from.
    hubs = tokens.groupBy("h").agg(F.min(F.struct("u", "gid", "n")).alias("hub"), F.sum("members").alias("k")).where("k > 1")
    tokens = written(tokens.join(hubs.select("h", "hub"), "h"), "tokens")
    star = tokens.where((F.col("gid") != F.col("hub.gid")) & _sizes_allow(F.col("n"), F.col("hub.n"))).select(F.col("gid").alias("a"), F.col("hub.gid").alias("b"))
    inside = members.where("node <> gid").select(F.col("node").alias("a"), F.col("gid").alias("b"))
    found = written(verified(star.unionByName(inside).distinct(), sets), "links")
    # Nodes known to be together by two steps along their links.
    up = found.groupBy("a").agg(F.min("b").alias("b"))
    two = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("node"), F.coalesce("c", "b").alias("component"))
    placed = members.select("node", "gid").join(two, "node", "left").select("node", "gid", F.coalesce("component", "node").alias("component"))
    # What is left: nodes that share a prefix shingle and are not known to be together.
    held = written(tokens.select("h", "gid", "n", "pos").join(placed, "gid"), "held")
    parts = held.groupBy("h", "component").agg(F.count("*").alias("k"))
    main = parts.groupBy("h").agg(F.max(F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = held.join(main.select("h", F.col("main.component").alias("main")), "h")
    rest = rest.join(sets.select("node", *(F.get("bits", i).alias(f"bits{i}") for i in range(LANES))), "node")
    own = ["node", "n", "pos", "component", *(f"bits{i}" for i in range(LANES))]
    rest = written(rest.select("h", "main", *own), "rest")
    left = rest.where("component <> main").select("h", *(F.col(c).alias(f"l_{c}") for c in own))
    right = rest.select("h", *(F.col(c).alias(f"r_{c}") for c in own))
    n, m, i, j = (F.col(c) for c in ("l_n", "r_n", "l_pos", "r_pos"))
    by_place = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)  # at most so many in common, given where they meet
    apart = sum((F.bit_count(F.col(f"l_bits{k}").bitwiseXOR(F.col(f"r_bits{k}"))) for k in range(1, LANES)),
                F.bit_count(F.col("l_bits0").bitwiseXOR(F.col("r_bits0"))))
    by_bits = n + m - apart  # twice that, given the bits that differ
    enough = (INTER_SHARE * by_place >= SUM_SHARE * (n + m)) & (INTER_SHARE * by_bits >= 2 * SUM_SHARE * (n + m))
    near = left.join(right, "h").where((F.col("l_component") != F.col("r_component")) & _sizes_allow(n, m) & enough)
    near = near.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()
    more = written(verified(near, sets), "links")
    return components(found.unionByName(more))


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(own)
    segments, buckets = P.segments_for(size), P.buckets_for(size)
    judged = written(frequent_documents(own, segments, buckets), "judged")
    bloom = Bloom.of(judged.where("open"), "doc_id")
    found = written(node_prefixes(own, bloom, segments, buckets), "prefixes")
    rows = found.where("kind = 0").select("doc_id", "n", "node")
    firsts = written(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")

    nodes = found.where("kind = 1").select("node", "n", "u", "prefix")
    wanted = firsts.join(nodes.select("node"), "node")
    sets = sets_of(own, Bloom.of(wanted, "doc_id")).join(wanted, ["node", "doc_id"]).select("node", "hashes", "bits")
    part = links(nodes, written(sets, "sets"))
    placed = written(firsts.join(part, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = placed.join(least, "component").select("node", "component_id")
    linked = rows.join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    # an empty set has no node, also where its id has another row that is open
    full = judged.where("n_shingles > 0").join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
    alone = full.unionByName(judged.where("n_shingles = 0")).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).unionByName(_without_id(own))


def _without_id(docs: DataFrame) -> DataFrame:
    def sizes(batches):
        for batch in batches:
            for part in chunks(batch):
                n = np.diff(shingle_sets(texts_of(part))[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), part.column("doc_id")], ["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").mapInArrow(sizes, "doc_id long, n_shingles long, component_id long")
