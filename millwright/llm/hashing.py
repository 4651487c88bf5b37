"""Words of texts and their hashes, worked out on whole Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from millwright.llm.common import text_buffers

BASE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_SEGMENT = 4 << 20

# Bytes of a word are digits, letters and everything outside ASCII.
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Words:
    """Word places, hashes and owners of a run of texts."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = text_buffers(texts)
        self.data = _LOWER[data]
        inside = _WORD[self.data]
        self.starts, self.ends = bounds(inside, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hashes = range_hashes(self.data, self.starts, self.ends)
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)

    def strings(self, start: int, end: int) -> list[str]:
        if end <= start:
            return []
        base = int(self.starts[start])
        piece = self.data[base : int(self.ends[end - 1])].tobytes()
        return [
            piece[s - base : e - base].decode()
            for s, e in zip(self.starts[start:end].tolist(), self.ends[start:end].tolist())
        ]


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes; a run stops at the end of its text."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    before[edges] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte range, ranges taken a few megabytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            stop = max(at + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
            size = int(ends[stop - 1]) - base
            up, down = _powers(size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
            s, e = starts[at:stop] - base, ends[at:stop] - base
            out[at:stop] = mixed((sums[e] - sums[s]) * down[s])
            at = stop
    return out


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) <= size:
        n = max(1 << 20, size + 1)
        factors = np.full((2, n), BASE, np.uint64)
        factors[1] = pow(BASE, -1, 1 << 64)
        factors[:, 0] = 1
        up, down = np.cumprod(factors, axis=1, dtype=np.uint64)
        _POWERS[:] = [(up, down)]
    return _POWERS[0]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
