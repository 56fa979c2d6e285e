"""Bloom filters in blocks. A block holds the keys of one range of hashes and
has its own number of bits, so blocks are built by separate tasks and a filter
may be sent block by block.

Keys are 64-bit hashes as int64. :func:`build` makes a filter of a bounded
size from the keys of a DataFrame; :class:`Blocks` answers for numpy arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.packed import U, mix

PROBES = 6
BITS_PER_KEY = 12
#: Bits of a block made by one task of :func:`build`.
BLOCK_BITS = 1 << 20


def _places(keys: np.ndarray, bits: np.ndarray | int, probe: int, step: np.ndarray) -> np.ndarray:
    """Bit of each key for one probe (bits below 2**32)."""
    h = (keys + U(probe) * step) >> U(32)
    return (h * np.asarray(bits, U)) >> U(32)


def _steps(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ U(0x5851F42D4C957F2D)) | U(1)


def bitmap(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a filter of ``bits`` bits with these keys (uint64)."""
    out = np.zeros(-(-bits // 8) * 8, bool)
    step = _steps(keys)
    for i in range(PROBES):
        out[_places(keys, bits, i, step).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


class Blocks:
    """Bitmaps by block number; ``bits[b]`` is 0 where nothing was inserted."""

    def __init__(self, bits: np.ndarray, maps: list[bytes]):
        self.bits = np.asarray(bits, U)
        size = (self.bits.astype(np.int64) + 7) // 8
        self.at = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(maps) + b"\0", np.uint8)

    def has(self, keys: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Whether each key may have been inserted into its block."""
        found = np.zeros(len(keys), bool)
        bits = self.bits[block]
        left = np.flatnonzero(bits)
        keys, bits, at = keys[left], bits[left], self.at[block[left]]
        step = _steps(keys)
        for i in range(PROBES):
            if not len(left):
                break
            bit = _places(keys, bits, i, step).astype(np.int64)
            hit = (self.data[at + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0
            if not hit.all():
                left, keys, step, bits, at = left[hit], keys[hit], step[hit], bits[hit], at[hit]
        found[left] = True
        return found


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each key by its top bits (``blocks`` is a power of 2)."""
    if blocks == 1:
        return np.zeros(len(keys), np.int64)
    return (keys >> U(65 - blocks.bit_length())).astype(np.int64)


def build(keys: DataFrame, n: int, most_bits: int) -> Blocks:
    """Filter of the one long column ``key`` of about ``n`` rows, of about
    ``most_bits`` bits at most: a fuller filter lets more foreign keys pass,
    but loses none of its own. One task makes a block; only bitmaps reach the
    driver."""
    bits = min(max(n, 1) * BITS_PER_KEY, most_bits)
    blocks = 1 << max(0, (-(-bits // BLOCK_BITS) - 1).bit_length())
    each = max(64, -(-bits // blocks))
    block = F.shiftrightunsigned("key", 65 - blocks.bit_length()) if blocks > 1 else F.lit(0)

    def make(rows: pa.Table) -> pa.Table:
        own = np.asarray(rows.column("key").combine_chunks()).view(U)
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "map": pa.array([bitmap(own, each).tobytes()], pa.binary())})

    made = keys.select("key", block.cast("long").alias("block")).groupBy("block").applyInArrow(make, "block long, map binary").collect()
    size, maps = np.zeros(blocks, np.int64), [b""] * blocks
    for row in made:
        size[row["block"]], maps[row["block"]] = each, bytes(row["map"])
    return Blocks(size, maps)
