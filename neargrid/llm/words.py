"""Words of a batch of texts as 64-bit hashes, found with array operations.

A word is a maximal run of ASCII letters, digits, underscores and characters beyond ASCII; letters A-Z and the capital
letters of the Latin-1 block count as their small ones.
"""

from __future__ import annotations

import numpy as np

from .common import RunHashes, mix64, utf8_runs

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


#: Bytes that are worked on at once. A block ends between words; only a longer word makes it longer.
BLOCK = 1 << 19


def _block_end(data: np.ndarray, b: int) -> int:
    """The least place from b on that is not inside a word."""
    while b < len(data) and _IS_WORD[data[b - 1]] and _IS_WORD[data[b]]:
        gap = np.flatnonzero(~_IS_WORD[data[b : b + 4096]])
        b += int(gap[0]) if len(gap) else min(4096, len(data) - b)
    return min(b, len(data))


class Words:
    """hashes: of all words; bounds: of the texts, in words; prefixes: one column of hashes for each of the given
    numbers of leading bytes (a word that is no longer keeps its own hash)."""

    def __init__(self, texts, prefixes: tuple[int, ...] = ()):
        raw, offsets = utf8_runs(texts)
        data = np.frombuffer(raw, dtype=np.uint8)
        starts, hashes, heads = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros((0, len(prefixes)), dtype=np.uint64)]
        a = 0
        while a < len(data):
            b = _block_end(data, min(a + BLOCK, len(data)))
            first, own, head = self._block(data[a:b], offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b)] - a, prefixes)
            starts.append(first + a)
            hashes.append(own)
            heads.append(head)
            a = b
        self.hashes, self.prefixes = np.concatenate(hashes), np.concatenate(heads)
        self.bounds = np.searchsorted(np.concatenate(starts), offsets)

    @staticmethod
    def _block(data: np.ndarray, inner: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the words of a block; `inner`: the texts' ends in it, which also end a word."""
        on = _IS_WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[1:-1] = on[1:] != on[:-1]
        edge[0], edge[-1] = on[0], on[-1]
        at = np.flatnonzero(edge)
        joined = np.unique(inner[on[inner - 1] & on[inner]]) if len(inner) else inner
        starts, ends = at[0::2], at[1::2]
        if len(joined):
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
        low = _LOWER[data]
        wide = np.zeros_like(on)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[wide] += 32
        runs = RunHashes(low)
        own = runs.of(starts, ends)
        heads = np.empty((len(starts), len(prefixes)), dtype=np.uint64)
        for j, size in enumerate(prefixes):
            heads[:, j] = np.where(ends - starts > size, mix64(runs.of(starts, np.minimum(starts + size, ends)), j + 1), own)
        return starts, own, heads


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k tokens (uint64), by one running hash; len(tokens) - k + 1 of them."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(n)
    return RunHashes(tokens).of(at, at + k)
