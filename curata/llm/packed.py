"""Hashes of word windows, and their way through a shuffle in packed form.

Words are the runs of bytes other than blanks and ASCII control spaces. Word
and window hashes are polynomials over running sums, so a chunk of texts is
hashed with a handful of numpy operations, whatever its words.

Hashes are dealt to segments. A map task packs what it has for a segment into
one row (hashes, and the ids that they belong to as runs of small
differences), so a shuffle of billions of hashes moves few, compact rows, and
a segment is resolved in one task of bounded size. Answers travel back to
buckets of ids in the same form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Windows that a segment holds on average.
SEGMENT_WINDOWS = 1 << 20
#: Bytes of text of a bucket of documents.
BUCKET_BYTES = 4 << 20
#: Hashes that a map task holds before it packs them.
FLUSH = 1 << 20
#: Bytes hashed at once.
SPAN = 1 << 18
#: Bytes of a word and the blank after it, for the number of segments.
WORD_BYTES = 6

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_TABLE = np.random.default_rng(2024).integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.back)):
                x = np.full(size, b, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_BYTES, _FIRST, _SECOND = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=out[1:])
    return out


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts (a large_string array from offset 0 without nulls),
    start and end of each word, and the offsets of the texts in words."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[:len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    word = ~_SPACE[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = ~word[:-1]
    edge[off] = True
    start = np.flatnonzero(word & edge[:-1])
    edge[:-1] = ~word
    edge[off] = True
    end = np.flatnonzero(word & edge[1:]) + 1
    return raw, start, end, np.searchsorted(start, off)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of each word; ``table`` may give another odd number for each byte."""
    if table is None:
        table = _LOWER if lower else _TABLE
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SPAN, side="right")))
        base = start[i]
        up, down = _BYTES.to(int(end[j - 1] - base) + 1)
        total = _running(table[raw[base:end[j - 1]]] * up[:-1])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(U) * U(0x8CB92BA72F3D8DD7))
        i = j
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word sequence ``words[first:last]``."""
    out = []
    for powers in (_FIRST, _SECOND):
        up, down = powers.to(len(words) + 1)
        total = _running(words * up[:-1])
        out.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(U) * U(0xE7037ED1A0B428DB)))
    return out[0], out[1]


def starts_of(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of every full window, and the number of windows of each text."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    return np.repeat(offsets[:-1], n) + _counted(n), n


def _counted(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)


def xxhash64(ids: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for one long column, as int64."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return (x << U(r)) | (x >> U(64 - r))

    with np.errstate(over="ignore"):
        h = np.full(len(ids), U(42) + p5 + U(8), U) ^ (turned(ids.astype(np.int64).view(U) * p2, 31) * p1)
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> U(33))) * p2
        h = (h ^ (h >> U(29))) * p3
        return (h ^ (h >> U(32))).view(np.int64)


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def pack(ids: np.ndarray, *values: np.ndarray) -> bytes:
    """Ids (int64, any order) with values of fixed type for each, as bytes."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    runs = ids[head]
    steps, counts = _least(np.diff(runs).view(U) if len(runs) else np.zeros(0, U)), _least(np.diff(np.append(head, len(ids))))
    meta = np.array([len(ids), len(runs), runs[0] if len(runs) else 0, steps.itemsize, counts.itemsize], np.int64)
    return b"".join([meta.tobytes(), steps.tobytes(), counts.tobytes(), *(v[order].tobytes() for v in values)])


def unpack(blob: bytes, *kinds) -> tuple[np.ndarray, ...]:
    """Ids (ascending) and the values of the given types."""
    n, m, first, a, b = np.frombuffer(blob, np.int64, 5)
    at = 40
    steps = np.frombuffer(blob, f"u{a}", max(m - 1, 0), at).astype(U)
    at += max(m - 1, 0) * a
    counts = np.frombuffer(blob, f"u{b}", m, at)
    at += m * b
    runs = (_running(steps) + np.array([first], np.int64).view(U)).view(np.int64)[:m]
    out = [np.repeat(runs, counts)]
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return tuple(out)


def unpack_all(blobs, *kinds) -> tuple[np.ndarray, ...]:
    parts = [unpack(b, *kinds) for b in blobs]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, k) for k in (np.int64, *kinds))


def dealt(place: np.ndarray, n: int):
    """For each place that occurs: the place and the indices that go there."""
    if not len(place):
        return
    order = np.argsort(place.astype(np.uint16) if n <= 1 << 16 else place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(n + 1)) if n <= 4 * len(place) + 16 else None
    if cut is None:
        keys, begin = np.unique(place[order], return_index=True)
        yield from zip(keys.tolist(), np.split(order, begin[1:]), strict=True)
        return
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, order[cut[k]:cut[k + 1]]


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return head, np.diff(np.append(head, len(sorted_values)))


def segments_for(text_bytes: int) -> int:
    return max(8, -(-text_bytes // (WORD_BYTES * SEGMENT_WINDOWS)))


def buckets_for(text_bytes: int) -> int:
    return max(8, -(-text_bytes // BUCKET_BYTES))
