"""Static three-wise binary fuse filters with 8-bit fingerprints, built in whole-array steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ _U(seed)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class BinaryFuse:
    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    def _slots(self, h: np.ndarray) -> np.ndarray:
        mask = _U(self.segment - 1)
        first = ((h >> _U(32)) * _U(self.segments * self.segment)) >> _U(32)
        second = (first + _U(self.segment)) ^ ((h >> _U(18)) & mask)
        third = (first + _U(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Never False for a key that was put in; True for about 1 in 256 others."""
        if len(self.cells) == 0:
            return np.zeros(len(keys), bool)
        h = _mix(keys.astype(np.int64).view(_U), self.seed)
        a, b, c = self._slots(h)
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == _fingerprint(h)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> _U(32))).astype(np.uint8)


def build(keys: np.ndarray) -> BinaryFuse:
    """Filter over distinct 64-bit keys (repeats are put in once); no keys give a filter that
    holds nothing. Keys are peeled in rounds, all keys alone in a slot at once, and cells are
    set in reverse order; a seed that leaves a core is replaced by the next."""
    keys = np.unique(keys.astype(np.int64)).view(_U)
    n = len(keys)
    if n == 0:
        return BinaryFuse(0, 1, 1, np.zeros(0, np.uint8))
    logs = math.log(max(n, 2))
    segment = 1 << min(18, max(2, int(math.floor(logs / math.log(3.33) + 2.25))))
    capacity = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / logs)
    segments = max(1, math.ceil(capacity / segment) - 2)
    for attempt in range(200):
        found = BinaryFuse(0x9E3779B97F4A7C15 * (attempt + 1) % (1 << 64), segment, segments, np.zeros((segments + 2) * segment, np.uint8))
        h = _mix(keys, found.seed)
        slots = found._slots(h)
        rounds = _peel(slots, n, len(found.cells))
        if rounds is not None:
            prints = _fingerprint(h)
            for who, where in reversed(rounds):
                a, b, c = slots[:, who]
                cells = found.cells
                cells[where] = prints[who] ^ cells[a] ^ cells[b] ^ cells[c] ^ cells[where]
            return found
        if attempt % 20 == 19:
            segments += max(1, segments // 8)
    raise RuntimeError("no seed lets the filter be built")


def _peel(slots: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    degree = np.zeros(size, np.int32)
    owner = np.zeros(size, np.int64)  # xor of the numbers of the keys left in a slot
    ids = np.arange(n)
    for row in slots:
        np.add.at(degree, row, 1)
        np.bitwise_xor.at(owner, row, ids)
    rounds, left = [], n
    alone = np.flatnonzero(degree == 1)
    while len(alone):
        who, first = np.unique(owner[alone], return_index=True)
        rounds.append((who, alone[first]))
        left -= len(who)
        touched = slots[:, who]
        for row in touched:
            np.subtract.at(degree, row, 1)
            np.bitwise_xor.at(owner, row, who)
        candidates = np.unique(touched)
        alone = candidates[degree[candidates] == 1]
    return rounds if left == 0 else None
