"""Counting quotient filters for n-grams of 64-bit word ids.

A key is an n-gram of at least two ids. :func:`permute` mixes its ids by an
invertible permutation, so keys spread evenly however often their words occur.
The top bits of the permuted key are its quotient; all other bits are kept as
its remainder, so a filter counts without error and :func:`restore` gives the
n-grams back.

A filter is a run of bytes: how many keys each quotient has, the remainders in
order, and the counts, one byte each, with larger ones listed apart. A segment
is a range of quotients; :func:`merge` adds up the filters that many map tasks
have made of one segment.
"""

from __future__ import annotations

import numpy as np

from curata.llm.packed import U, mix

ROUNDS = 4
_SALT = [U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0), U(0x082EFA98EC4E6C89)]


def _round(lanes: list[np.ndarray], r: int) -> np.ndarray:
    """What round r adds to its lane: a hash of the other lanes."""
    n = len(lanes)
    h = np.full(len(lanes[0]), _SALT[r % len(_SALT)])
    for j in range(1, n):
        h = mix(h + lanes[(r + j) % n] * U(2 * j + 1))
    return h


def permute(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """Each round adds to one id a hash of the others (the first id last)."""
    lanes = list(lanes)
    for r in reversed(range(ROUNDS * len(lanes) // 2)):
        lanes[r % len(lanes)] = lanes[r % len(lanes)] ^ _round(lanes, r)
    return lanes


def restore(lanes: list[np.ndarray]) -> list[np.ndarray]:
    lanes = list(lanes)
    for r in range(ROUNDS * len(lanes) // 2):
        lanes[r % len(lanes)] = lanes[r % len(lanes)] ^ _round(lanes, r)
    return lanes


def quotient_bits(segment_bits: int) -> int:
    return 16 if segment_bits <= 16 else 24 if segment_bits <= 24 else 32


def counted(lanes: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys in order, with the sum of their counts (1 each without)."""
    order = np.argsort(lanes[0])
    first = lanes[0][order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(first) else np.zeros(0, bool)
    rest = [x[order] for x in lanes[1:]]
    other = np.zeros(len(first), bool)
    for x in rest:
        other[1:] |= x[1:] != x[:-1]
    if (other & ~new).any():  # two keys with one first id: in full order
        order = np.lexsort(lanes[::-1])
        first, rest = lanes[0][order], [x[order] for x in lanes[1:]]
        new = np.concatenate([[True], first[1:] != first[:-1]])
        for x in rest:
            new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    sums = np.diff(np.append(head, len(first))) if counts is None else np.add.reduceat(counts[order], head) if len(head) else counts
    return [first[head], *(x[head] for x in rest)], sums


def encode(lanes: list[np.ndarray], counts: np.ndarray, segment: int, segment_bits: int) -> bytes:
    """A segment's filter from its keys in order."""
    q = quotient_bits(segment_bits)
    slots = 1 << (q - segment_bits)
    slot = (lanes[0] >> U(64 - q)).astype(np.int64) - segment * slots
    runs = np.bincount(slot, minlength=slots)
    runs = runs.astype(np.min_scalar_type(int(runs.max(initial=0))))
    low = lanes[0].reshape(-1, 1).view(np.uint8).reshape(len(lanes[0]), 8)[:, :8 - q // 8]  # little-endian
    large = np.flatnonzero(counts > 255)
    meta = np.array([len(counts), runs.itemsize, len(large)], np.int64)
    return b"".join([meta.tobytes(), runs.tobytes(), np.ascontiguousarray(low).tobytes(), *(x.tobytes() for x in lanes[1:]),
                     np.where(counts > 255, 0, counts).astype(np.uint8).tobytes(), large.astype(np.int64).tobytes(), counts[large].astype(np.int64).tobytes()])


def decode(blob: bytes, width: int, segment: int, segment_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    q = quotient_bits(segment_bits)
    slots = 1 << (q - segment_bits)
    n, size, larger = (int(x) for x in np.frombuffer(blob, np.int64, 3))
    at = 24
    runs = np.frombuffer(blob, f"u{size}", slots, at).astype(np.int64)
    at += slots * size
    kept = 8 - q // 8
    first = np.zeros((n, 8), np.uint8)
    first[:, :kept] = np.frombuffer(blob, np.uint8, n * kept, at).reshape(n, kept)
    at += n * kept
    lanes = [first.reshape(-1).view(U) | (np.repeat(np.arange(slots) + segment * slots, runs).astype(U) << U(64 - q))]
    for _ in range(width - 1):
        lanes.append(np.frombuffer(blob, U, n, at))
        at += 8 * n
    counts = np.frombuffer(blob, np.uint8, n, at).astype(np.int64)
    at += n
    counts[np.frombuffer(blob, np.int64, larger, at)] = np.frombuffer(blob, np.int64, larger, at + 8 * larger)
    return lanes, counts


def merge(blobs: list[bytes], width: int, segment: int, segment_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of all the filters of a segment in order, with their summed counts."""
    parts = [decode(b, width, segment, segment_bits) for b in blobs]
    if not parts:
        return [np.zeros(0, U)] * width, np.zeros(0, np.int64)
    lanes = [np.concatenate([p[0][i] for p in parts]) for i in range(width)]
    return counted(lanes, np.concatenate([c for _, c in parts]))
