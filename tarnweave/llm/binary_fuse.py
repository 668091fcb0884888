"""Static 3-wise binary fuse filters over 64-bit keys, in NumPy (Graf and Lemire, 2022)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(_U) + _U(seed & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _slots(h: np.ndarray, seg_len: int, seg_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # the high 32 bits pick the start; a 32 x 32 bit product stays within 64 bits
    a = ((h >> _U(32)) * _U(seg_len * seg_count)) >> _U(32)
    mask = _U(seg_len - 1)
    b = (a + _U(seg_len)) ^ ((h >> _U(18)) & mask)
    c = (a + _U(2 * seg_len)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


@dataclass(frozen=True)
class BinaryFuse:
    """An immutable set sketch: no false negatives, false positives at about 1 in 256, about 9 bits a key."""

    seed: int
    seg_len: int
    seg_count: int
    cells: bytes

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(np.asarray(keys).astype(np.int64).view(_U))
        n = len(keys)
        if n == 0:
            return cls(0, 0, 0, b"")
        seg_len = min(1 << 18, 1 << int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
        for attempt in range(200):
            seg_count = max(1, math.ceil(n * factor / seg_len) - 2)
            size = (seg_count + 2) * seg_len
            seed = (0x9E3779B97F4A7C15 * (attempt + 1)) & 0xFFFFFFFFFFFFFFFF
            h = _mix(keys, seed)
            at = np.stack(_slots(h, seg_len, seg_count))
            flat = at.ravel()
            count = np.bincount(flat, minlength=size)
            total = np.bincount(flat, weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size)
            done = np.zeros(n, bool)
            layers, left = [], n
            front = np.flatnonzero(count == 1)
            while len(front):
                key = total[front].astype(np.int64)
                key, first = np.unique(key, return_index=True)
                slot = front[first]
                layers.append((key, slot))
                done[key] = True
                left -= len(key)
                hit = at[:, key].ravel()
                np.subtract.at(count, hit, 1)
                np.subtract.at(total, hit, np.tile(key.astype(np.float64), 3))
                hit = np.unique(hit)
                front = hit[count[hit] == 1]
            if left == 0:
                cells = np.zeros(size, np.uint8)
                want = _print(h)
                for key, slot in reversed(layers):
                    a, b, c = at[:, key]
                    cells[slot] = 0
                    cells[slot] = want[key] ^ cells[a] ^ cells[b] ^ cells[c]
                return cls(seed, seg_len, seg_count, cells.tobytes())
            factor *= 1.03 if attempt % 4 == 3 else 1.0
        raise RuntimeError("no binary fuse filter was found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.cells:
            return np.zeros(len(keys), bool)
        h = _mix(np.asarray(keys).astype(np.int64).view(_U), self.seed)
        a, b, c = _slots(h, self.seg_len, self.seg_count)
        cells = np.frombuffer(self.cells, np.uint8)
        return _print(h) == cells[a] ^ cells[b] ^ cells[c]
