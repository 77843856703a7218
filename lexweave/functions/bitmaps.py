"""Compressed bitmaps over 32-bit codes: 16-bit blocks held as sorted arrays when sparse, as bit fields when dense."""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 16
SPARSE_LIMIT = 4096  # an array of uint16 is smaller than the 8 KiB bit field up to here


def _pack(low: np.ndarray) -> np.ndarray:
    """Sorted distinct uint16 values in the smaller of the two forms."""
    if len(low) <= SPARSE_LIMIT:
        return low.astype(np.uint16)
    bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def _values(block: np.ndarray) -> np.ndarray:
    return block if block.dtype == np.uint16 else np.flatnonzero(np.unpackbits(block, bitorder="little")).astype(np.uint16)


def _mask(block: np.ndarray) -> np.ndarray:
    if block.dtype == np.uint8:
        return block
    bits = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    bits[block] = 1
    return np.packbits(bits, bitorder="little")


class Bitmap:
    """Immutable set of codes below 2**32."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, np.ndarray] | None = None):
        self.blocks = blocks or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> "Bitmap":
        codes = np.unique(np.asarray(codes, dtype=np.uint32))
        high = codes >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> BLOCK_BITS): _pack(part & 0xFFFF) for part in np.split(codes, cuts) if len(part)})

    def codes(self) -> np.ndarray:
        parts = [_values(b).astype(np.uint32) + np.uint32(k << BLOCK_BITS) for k, b in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for k, mine in self.blocks.items():
            theirs = other.blocks.get(k)
            if theirs is None:
                out[k] = mine
                continue
            if mine.dtype == np.uint16:
                mask = _mask(theirs)
                rest = mine[(mask[mine >> 3] >> (mine & 7).astype(np.uint8)) & 1 == 0]
            else:
                rest = _values(mine & ~_mask(theirs))
            if len(rest):
                out[k] = _pack(rest)
        return Bitmap(out)

    def union(self, other: "Bitmap") -> "Bitmap":
        out = dict(self.blocks)
        for k, theirs in other.blocks.items():
            mine = out.get(k)
            out[k] = theirs if mine is None else _pack(_values(_mask(mine) | _mask(theirs)))
        return Bitmap(out)

    def has(self, codes: np.ndarray) -> np.ndarray:
        codes = np.asarray(codes, dtype=np.uint32)
        found = np.zeros(len(codes), dtype=bool)
        high = codes >> BLOCK_BITS
        for k in np.unique(high):
            block = self.blocks.get(int(k))
            if block is not None:
                at = np.flatnonzero(high == k)
                low = codes[at] & 0xFFFF
                found[at] = (_mask(block)[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
        return found

    def __len__(self) -> int:
        return sum(len(b) if b.dtype == np.uint16 else int(np.unpackbits(b).sum()) for b in self.blocks.values())
