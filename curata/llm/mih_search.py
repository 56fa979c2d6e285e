"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: the vectors' principal directions are rotated by iterative quantisation
so that signs lose little (learned on a bounded sample); each vector gets one
bit per direction. Index: the code is split into substrings, and each
substring has its own table from value to rows. Probing: codes within Hamming
radius r agree with the query in at least one substring up to a radius that
the pigeonhole principle gives (substring radii add up to r minus the number
of substrings plus one), so probing every substring table to its radius
retrieves every code within r. Hamming distances are computed for what the
tables return, and what lies within r is reranked by the inner product of the
original vectors in double precision; no other row is touched.

The radius is set on the sample as the distance that holds ``recall`` of true
neighbours there. On more rows the true neighbours lie nearer, so it errs to
the safe side. Queries that find too few within it, as those in a thin part of
skewed vectors do, probe again with a larger radius, up to the whole code.
Every row is indexed.

Equal vectors are one entry of the index with the smallest ids that can
appear in an answer (``k`` and the query's own), so copies of one vector cost
one entry however many there are. Queries, in blocks, meet blocks of entries;
a task indexes one block and returns the best ``k`` entries of each query.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than most; ids that
are null neither; rows that repeat an id and vector are one candidate; ties go
to the smaller id; fewer candidates than ``k`` are all returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import written

SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 400
RECALL = 0.975
SUBSTRING_BITS = 8
BLOCK_ENTRIES = 16_384
BLOCK_QUERIES = 4_096


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Directions (dim x bits) whose signs are the code (iterative quantisation)."""
    rng = np.random.default_rng(seed)
    directions = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    parts = []
    for start in range(0, bits, x.shape[1]):
        w = directions[:, :min(x.shape[1], bits - start)]
        v = x @ w
        r = np.linalg.qr(rng.standard_normal((w.shape[1], w.shape[1])))[0]
        for _ in range(rounds):
            u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ t).T
        parts.append(w @ r)
    return np.hstack(parts)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Sign bits of the rotated vectors as bytes (rows x bits/8)."""
    return np.packbits(x @ rotation >= 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes in a to all in b."""
    total = np.zeros((len(a), len(b)), np.uint16)
    for i in range(a.shape[1]):
        total += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return total


def substring_radii(radius: int, parts: int) -> list[int]:
    """Radii that add up to radius - parts + 1; -1 leaves a substring out."""
    low, more = divmod(radius + 1, parts)
    return [low - (i >= more) for i in range(parts)]


class Index:
    """Tables of one block of codes, one for each substring of a byte."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order = [np.argsort(code[:, i], kind="stable") for i in range(code.shape[1])]
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(code[:, i], minlength=256))]) for i in range(code.shape[1])]

    def probe(self, part: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring lies within the radius of the value."""
        near = np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(value)) <= radius)
        start = self.start[part]
        return np.concatenate([self.order[part][start[v]:start[v + 1]] for v in near])

    def retrieved(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows that the substring tables return for a code, each once."""
        met = np.zeros(len(self.code), bool)
        for part, own in enumerate(substring_radii(radius, self.code.shape[1])):
            if own >= 0:
                met[self.probe(part, int(query[part]), own)] = True
        return np.flatnonzero(met)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within the radius: distances are computed only
        for what the tables return, which misses none of them."""
        rows = self.retrieved(query, radius)
        return rows[hamming(query[None], self.code[rows])[0] <= radius]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the components, so that equal
    vectors get equal scores whatever stands beside them."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += q[i] * x[:, i]
    return total


def best(index: Index, x: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, radius: int, k: int):
    """For each query the rows and scores of its k best within the radius."""
    for q, code in zip(queries, query_codes, strict=True):
        rows = index.within(code, radius)
        score = x[rows] @ q
        if len(rows) > k + 8:  # a few more than k, since this product may round differently
            top = np.argpartition(-score, k + 7)[:k + 8]
            rows = rows[top]
        yield rows, inner(q, x[rows])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, code (the vector's bytes as doubles)."""
    value = F.transform("embedding", lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).where(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(embedding, v -> v <> 0)")
    dim = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()

    def packed(batches):
        for batch in batches:
            flat = np.asarray(batch.column("embedding").flatten())
            vectors = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "code"])

    return rows.where(F.size("embedding") == (dim["n"] if dim else 0)).mapInArrow(packed, "vec_id long, code binary")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their smallest ``keep`` ids: code, ids."""

    def smallest(batches):
        """Map-side: what a batch can add to the result."""
        for batch in batches:
            frame = batch.to_pandas().drop_duplicates().sort_values("vec_id")
            ids = frame.groupby("code", sort=False)["vec_id"].apply(lambda s: s.tolist()[:keep])
            yield pa.RecordBatch.from_arrays([pa.array(list(ids.index), pa.binary()), pa.array(list(ids), pa.list_(pa.int64()))], ["code", "ids"])

    parts = rows.mapInArrow(smallest, "code binary, ids array<long>")
    return parts.groupBy("code").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def search(vectors: DataFrame, is_query, k: int = 20, bits: int | None = None, recall: float = RECALL) -> DataFrame:
    """The k nearest of every row that ``is_query`` (a condition on vec_id)
    selects, among all other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors), "vectors")
    entries = written(distinct_vectors(rows, k + 1), "entries")
    n = entries.count()
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "code").distinct()
    asked = written(queries.select("code").distinct(), "queries")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    sample = entries.select("code").where(F.pmod(F.xxhash64("code"), F.lit(1 << 20)) <= int(min(1.0, SAMPLE_ROWS / n) * (1 << 20))).limit(2 * SAMPLE_ROWS)
    x = np.array([np.frombuffer(r["code"]) for r in sample.collect()])
    x = x[np.lexsort(x.T)] if len(x) else np.frombuffer(entries.first()["code"])[None]
    bits = bits or -(-x.shape[1] // 8) * 8
    rotation = learn_rotation(x, bits)
    c = codes(x, rotation)
    probe = np.random.default_rng(11).permutation(len(x))[:SAMPLE_QUERIES]
    near = []
    for i in probe:
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[:min(k, len(x) - 1)]
        near.append(hamming(c[i:i + 1], c[top])[0])
    near = np.concatenate(near) if near else np.zeros(0)
    radius = int(np.quantile(near, recall, method="higher")) if len(near) else bits
    model = spark.sparkContext.broadcast(rotation)  # dim x bits numbers
    wanted = min(k + 1, entries.agg(F.sum(F.size("ids"))).first()[0])
    merged, left_over = None, asked
    while True:
        found = written(probed(entries, n, left_over, n_asked, model, radius, k), "found")
        full = found if radius >= bits else found.where(F.size("p") >= wanted)
        merged = full if merged is None else merged.unionByName(full)
        if radius >= bits:
            break
        left_over = written(left_over.join(full, "code", "left_anti"), "queries")
        n_asked = left_over.count()
        if not n_asked:
            break
        radius = min(bits, max(2 * radius, radius + SUBSTRING_BITS))
    # Queries with equal vectors share the answer, each without itself.
    kept = queries.join(merged, "code").select("query_id", F.expr(f"slice(filter(p, x -> x.vec_id <> query_id), 1, {k})").alias("p"))
    return kept.select("query_id", F.posexplode("p").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def probed(entries: DataFrame, n: int, asked: DataFrame, n_asked: int, model, radius: int, k: int) -> DataFrame:
    """The k + 1 best rows within the radius of each asked vector: code, p
    (far, vec_id). A vector without any is left out."""
    blocks, query_blocks = max(1, -(-n // BLOCK_ENTRIES)), max(1, -(-n_asked // BLOCK_QUERIES))

    def spread(df, own_block, own_n, other_block, other_n):
        mine = F.pmod(F.xxhash64("code"), F.lit(own_n)).cast("int").alias(own_block)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other_block))

    left = spread(entries, "b", blocks, "q", query_blocks)
    right = spread(asked, "q", query_blocks, "b", blocks)

    def meet(e: pa.Table, q: pa.Table) -> pa.Table:
        rotation = model.value
        rows: list = [[], [], []]
        if e.num_rows and q.num_rows:
            x = np.array([np.frombuffer(v) for v in e.column("code").to_pylist()])
            y = np.array([np.frombuffer(v) for v in q.column("code").to_pylist()])
            ids = e.column("ids").to_pylist()
            for code, (at, score) in zip(q.column("code").to_pylist(), best(Index(codes(x, rotation)), x, y, codes(y, rotation), radius, k + 1), strict=True):
                found = sorted((-s, i) for a, s in zip(at, score, strict=True) for i in ids[a])[:k + 1]
                rows[0].append(code)
                rows[1].append([i for _, i in found])
                rows[2].append([-s for s, _ in found])
        return pa.table({"code": pa.array(rows[0], pa.binary()), "ids": pa.array(rows[1], pa.list_(pa.int64())), "scores": pa.array(rows[2], pa.list_(pa.float64()))})

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(meet, "code binary, ids array<long>, scores array<double>")
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("vec_id"))
    return found.select("code", pairs.alias("p")).groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k + 1).alias("p"))
