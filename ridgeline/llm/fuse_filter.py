"""Static three-wise binary fuse filters with 8-bit fingerprints, built and probed in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

_SHIFT = np.uint64(32)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # the finaliser of MurmurHash3
        h = (h ^ (h >> np.uint64(33))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """Answers True for every key it was built of, and for about 1 in 256 others."""

    seed: int
    segment: int  # slots in a segment, a power of two
    segments: int  # where a key's first slot may lie
    slots: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, attempts: int = 100) -> FuseFilter:
        """keys: uint64, in any order; equal keys count once."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << math.floor(math.log(n) / math.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 4
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, attempts + 1):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError(f"no seed of {attempts} gives a filter for {n} keys")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        mask = np.uint64(self.segment - 1)
        first = (h >> _SHIFT) * np.uint64(self.segments * self.segment) >> _SHIFT
        second = (first + np.uint64(self.segment)) ^ (h >> np.uint64(18) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third], axis=1).astype(np.int64), (h ^ (h >> _SHIFT)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peel keys that are alone in a slot, round by round, then set slots in the opposite order."""
        if not len(keys):
            return True
        places, prints = self._places(keys)
        load = np.bincount(places.ravel(), minlength=len(self.slots))
        owner = np.bincount(places.ravel(), weights=np.repeat(np.arange(len(keys)), 3), minlength=len(self.slots)).astype(np.int64)
        rounds, peeled, alone = [], 0, np.flatnonzero(load == 1)
        while len(alone):
            took, at = np.unique(owner[alone], return_index=True)
            rounds.append((took, alone[at]))
            peeled += len(took)
            touched = places[took].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(owner, touched, np.repeat(took, 3))
            touched = np.unique(touched)
            alone = touched[load[touched] == 1]
        if peeled < len(keys):
            return False
        for took, slot in reversed(rounds):
            p = places[took]
            self.slots[slot] = prints[took] ^ self.slots[p[:, 0]] ^ self.slots[p[:, 1]] ^ self.slots[p[:, 2]]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, prints = self._places(np.asarray(keys, np.uint64))
        return prints == self.slots[p[:, 0]] ^ self.slots[p[:, 1]] ^ self.slots[p[:, 2]]
