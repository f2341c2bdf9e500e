"""A cuckoo filter: approximate membership with deletion, over 64-bit keys."""

from __future__ import annotations

import numpy as np

from .wordhash import mix

_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, partial-key cuckoo hashing; about 2.2 bytes a key.

    A key that was inserted is always found. Another is found with a probability of about 1 / 8000.
    Deleting a key that was inserted removes one copy of its fingerprint. ``insert`` returns False
    where the filter is full: the owner then builds a larger one from its exact table.
    """

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * _SLOTS * 0.9 < max(1, capacity):
            buckets *= 2
        self.table = np.zeros((buckets, _SLOTS), np.uint16)
        self._rng = np.random.default_rng(buckets)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(keys).astype(np.uint64))
        fp = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64(len(self.table) - 1)
        a = h & mask
        return fp, a.astype(np.int64), self._other(a.astype(np.int64), fp)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ (mix(np.asarray(fp).astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def _fill(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets, as many as there are; which were put."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket, "left")
        free = self.table[bucket] == 0
        ok = rank < free.sum(1)
        slot = (np.cumsum(free, 1) == rank[:, None] + 1).argmax(1)
        self.table[bucket[ok], slot[ok]] = fp[order[ok]]
        done = np.zeros(len(at), bool)
        done[order[ok]] = True
        return done

    def insert(self, keys: np.ndarray) -> bool:
        fp, a, b = self._places(keys)
        left = ~self._fill(fp, a)
        fp, at = fp[left], b[left]
        for _ in range(_KICKS):
            left = ~self._fill(fp, at)
            fp, at = fp[left], at[left]
            if not len(fp):
                return True
            # one fingerprint of each full bucket gives way and goes to its other bucket; the others wait
            one = np.unique(at, return_index=True)[1]
            bucket, slot = at[one], self._rng.integers(_SLOTS, size=len(one))
            gone = self.table[bucket, slot]
            self.table[bucket, slot] = fp[one]
            fp[one], at[one] = gone, self._other(bucket, gone)
        return False

    def _take(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Removes a copy of each fingerprint from its bucket, as many as there are; which were removed."""
        order = np.lexsort((fp, at))
        both = at[order] * (1 << 16) + fp[order]
        rank = np.arange(len(both)) - np.searchsorted(both, both, "left")
        same = self.table[at[order]] == fp[order][:, None]
        ok = rank < same.sum(1)
        slot = (np.cumsum(same, 1) == rank[:, None] + 1).argmax(1)
        self.table[at[order[ok]], slot[ok]] = 0
        done = np.zeros(len(at), bool)
        done[order[ok]] = True
        return done

    def delete(self, keys: np.ndarray) -> int:
        """The number of keys of which a fingerprint was found and removed."""
        fp, a, b = self._places(keys)
        done = self._take(fp, a)
        left = np.flatnonzero(~done)
        return int(done.sum() + self._take(fp[left], b[left]).sum())

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        out = cls(0)
        out.table = np.frombuffer(raw, "<u2").reshape(-1, _SLOTS).astype(np.uint16)
        return out

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = max(64, len(keys))
        while True:
            out = cls(capacity)
            if out.insert(keys):
                return out
            capacity *= 2
