"""Matches of a vocabulary's pieces in many words at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Lattice:
    """All piece matches of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for rows, codes in by_length(pieces):
            keys[rows] = self._key(codes)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.near = np.zeros(1 << 20, bool)
        self.near[self.keys >> np.uint64(44)] = True

    @staticmethod
    def _key(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1]):
            h = Lattice._step(h, codes[:, k])
        return h

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ (code.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def matches(self, codes: np.ndarray, low: int = 0, high: int | None = None
                ) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For (start, length): the rows of ``codes`` (words of one length) that have a piece there, and the pieces.

        Starts from ``low`` up to ``high`` only, if given.
        """
        n, out = codes.shape[1], {}
        for start in range(low, n if high is None else high):
            h = np.zeros(len(codes), np.uint64)
            for size in range(1, min(self.longest, n - start) + 1):
                h = self._step(h, codes[:, start + size - 1])
                rows = np.flatnonzero(self.near[h >> np.uint64(44)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                    hit = self.keys[at] == h[rows]
                    if hit.any():
                        out[start, size] = rows[hit], self.ids[at[hit]]
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the words of each length."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n, own in groups.items():
        for at in range(0, len(own), 20_000):
            part = own[at:at + 20_000]
            yield np.array(part), np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "surrogatepass"),
                                                np.uint32).reshape(len(part), n)
