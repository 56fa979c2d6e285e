"""Quality classifier over random-indexing word vectors.

Every token has a fixed sparse random index vector. A word's vector is the sum
of the index vectors of its neighbours (two on either side) over the training
texts, centred and scaled to length one. A document is pooled from the vectors
of all its tokens: their mean, and the mean product of each token's vector
with the next token's (which is large where words repeat), beside its length
and its shares of distinct, of unseen and of symbol tokens. A network with one hidden layer,
in numpy, is trained on these with Adam; a temperature fitted on a fifth of
the training rows that the network has not seen calibrates its probabilities.

Training takes a bounded sample of the labelled rows: about ``max_rows``,
chosen by a hash of the id, and at most ``vocabulary`` words (the most
frequent, ties by the word, none that occurs once); rarer words share ``UNSEEN`` vectors by hash. The
fitted model is therefore of bounded size and is sent to every task. All
documents are scored on their whole texts.

Edge cases: null and empty texts are scored as texts without a token; a null
id is never trained on; several labels of one id count as the largest; if the
labels are missing or all equal, every score is the share of label 1 (0.5
without labels).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import chunks, give_back, split_words, texts_of, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
MAX_ROWS = 20_000
VOCABULARY = 20_000
UNSEEN = 256
DIM = 32
NONZERO = 4
WINDOW = 2
HIDDEN = 32
SAMPLE_TASKS = 16
CHUNK = 1 << 20
MEMO = 150_000


class Tokens:
    """Token numbers of texts."""

    def __init__(self, vocabulary: list[str]):
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.memo: dict[str, np.ndarray] = {}

    def of(self, word: str) -> list[int]:
        n = len(self.number)
        return [self.number[t] if t in self.number else n + zlib.crc32(t.encode("utf-8", "replace")) % UNSEEN for t in TOKEN.findall(word)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers, offsets of the texts, and for each token whether it is made of symbols."""
        words, codes, offsets = split_words(pc.utf8_lower(texts))
        if len(self.memo) > MEMO:
            self.memo.clear()
        per_word = []
        for w in words:
            own = self.memo.get(w)
            if own is None:
                found = TOKEN.findall(w)
                # the lowest bit tells symbols from words
                own = self.memo[w] = np.array([2 * i + (not t[0].isalnum() and t[0] != "_") for i, t in zip(self.of(w), found, strict=True)], np.int64)
            per_word.append(own)
        size = np.fromiter(map(len, per_word), np.int64, len(words))
        flat = np.concatenate(per_word) if per_word else np.zeros(0, np.int64)
        start, length = np.cumsum(size) - size, size[codes]
        ends = np.cumsum(length)
        at = np.repeat(start[codes] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return flat[at] >> 1, np.concatenate([[0], ends])[offsets], (flat[at] & 1).astype(bool)


def index_vectors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each token's index vector."""
    rng = np.random.default_rng(3)
    return rng.integers(0, DIM, (n, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (n, NONZERO))


def context_sums(ids: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Sum of the index vectors of the neighbours of each token."""
    place, sign = index_vectors(n)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    total = np.zeros(n * DIM)
    for step in range(1, WINDOW + 1):
        same = doc[step:] == doc[:-step]
        a, b = ids[:-step][same], ids[step:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(NONZERO):
                total += np.bincount(x * DIM + place[y, j], sign[y, j], n * DIM)
    return total.reshape(n, DIM)


@dataclass
class Model:
    vocabulary: list[str]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None


def pooled(texts: pa.Array, tokens: Tokens, vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    ids, offsets, symbols = tokens.ids(texts)
    out = np.zeros((len(offsets) - 1, 2 * DIM + 4))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if a == b:
            continue
        own = ids[a:b]
        v = vectors[own]
        n = b - a
        out[i, :DIM] = v.mean(axis=0, dtype=np.float64)
        if n > 1:
            out[i, DIM:2 * DIM] = np.einsum("ij,ij->j", v[:-1], v[1:], dtype=np.float64) / (n - 1)
        out[i, 2 * DIM:] = np.log1p(n), len(np.unique(own)) / n, (own >= len(vectors) - UNSEEN).mean(), symbols[a:b].mean()
    return out


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features around 0; far values are held at 10 standard deviations."""
    return np.clip((x - mean) / scale, -10, 10)


def logits(model: Model, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = model.layers
    return np.tanh(standard(x, model.mean, model.scale) @ w1 + b1) @ w2 + b2


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    return 1 / (1 + np.exp(-np.clip(logits(model, x) / model.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray, steps: int = 6000, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> tuple[list[np.ndarray], float]:
    """Two layers by about ``steps`` steps of Adam, and the temperature from
    rows left out."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[:len(x) // 5], order[len(x) // 5:]
    layers: list[np.ndarray] = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(-(-steps // max(1, -(-len(used) // 128)))):
        shuffled = rng.permutation(used)
        for batch in (shuffled[i:i + 128] for i in range(0, len(shuffled), 128)):
            a, t = x[batch], y[batch]
            h = np.tanh(a @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-(h @ layers[2] + layers[3]))) - t) / len(t)
            back = np.outer(error, layers[2]) * (1 - h * h)
            grads = [a.T @ back + decay * layers[0], back.sum(0), h.T @ error + decay * layers[2], error.sum(keepdims=True)]
            step += 1
            for w, g, m1, v1 in zip(layers, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(x[held] @ layers[0] + layers[1]) @ layers[2] + layers[3]
    grid = np.geomspace(0.25, 8, 61)
    losses = [np.mean(np.logaddexp(0, -z / t * (2 * y[held] - 1))) for t in grid] if len(held) else [0.0] * 61
    return layers, float(grid[int(np.argmin(losses))]) if len(held) else 1.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, vocabulary: int = VOCABULARY) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, 0 or 1)."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_curata_label"))
    n = known.count()
    share = min(1.0, max_rows / n) if n else 0.0
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).limit(2 * max_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * max_rows ids
    sample = written(sample.repartition(SAMPLE_TASKS, "doc_id"), "sample")

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in pc.utf8_lower(texts_of(batch)).to_pylist():
                total.update(TOKEN.findall(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    counted = sample.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    words = [r["token"] for r in counted.where("n > 1").orderBy(F.desc("n"), "token").limit(vocabulary).collect()]
    size = len(words) + UNSEEN
    sent = spark.sparkContext.broadcast(words)

    def contexts(batches):
        tokens, total = Tokens(sent.value), np.zeros((size, DIM))
        for batch in batches:
            for part in chunks(batch):
                ids, offsets, _ = tokens.ids(texts_of(part))
                total += context_sums(ids, offsets, size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # SAMPLE_TASKS sums of fixed size; whole numbers, so their order does not matter
    summed = np.zeros((size, DIM))
    for r in sample.select("text").mapInArrow(contexts, "sums binary").toLocalIterator():
        summed += np.frombuffer(r["sums"]).reshape(size, DIM)
    vectors = np.sign(summed) * np.log1p(np.abs(summed))
    vectors -= vectors.mean(axis=0)
    vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    sent_vectors = spark.sparkContext.broadcast((words, vectors))

    def features(batches):
        words, vectors = sent_vectors.value
        tokens = Tokens(words)
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                x = pooled(texts_of(part), tokens, vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("_curata_label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sorted(sample.mapInArrow(features, "doc_id string, y int, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(words, vectors, np.zeros(1), np.ones(1), [], 1.0, float(y.mean()) if len(y) else 0.5)
    x = np.array([r["x"] for r in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    layers, temperature = train_network(standard(x, mean, scale), y)
    return Model(words, vectors, mean, scale, layers, temperature)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (probability of label 1) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = sent.value
        tokens = Tokens(model.vocabulary)
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                x = pooled(texts_of(part), tokens, model.vectors)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(probabilities(model, x))], ["doc_id", "score"])
        del tokens
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
