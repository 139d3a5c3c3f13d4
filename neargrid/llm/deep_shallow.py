"""Deep-shallow sorting of byte strings (Manzini and Ferragina 2004).

Shallow: multikey quicksort (Bentley and Sedgewick 1997) with eight bytes as one character, to a depth of `SHALLOW` bytes. Deep: each group
that still shares its prefix is ordered by a blind trie, which branches only where strings differ: a search reads one
byte for each branch, and one comparison with the leaf it comes to tells where the new string leaves the trie.
"""

from __future__ import annotations

import numpy as np

from .common import gather_runs, ragged

SHALLOW = 24


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, of which `low` bytes are known."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 8:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    while a[low] == b[low]:
        low += 1
    return low


class _Node:
    __slots__ = ("depth", "children", "leaf")

    def __init__(self, depth: int, children: dict | None, leaf: list | None):
        self.depth, self.children, self.leaf = depth, children, leaf


def blind_trie_order(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length, and the common prefix of each with the one before it (0 for the first)."""
    width = len(keys[0])
    root = _Node(width, None, [0])
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while node.children is not None:  # blind: only the bytes at branches are read
            node = node.children.get(key[node.depth]) or next(iter(node.children.values()))
        leave = common_prefix(keys[node.leaf[0]], key)
        if leave == width:
            node.leaf.append(i)
            continue
        parent, node = None, root
        while node.depth < leave:
            parent, node = node, node.children[key[node.depth]]
        if node.depth == leave:
            node.children[key[leave]] = _Node(width, None, [i])
            continue
        first = node
        while first.children is not None:
            first = next(iter(first.children.values()))
        other = keys[first.leaf[0]]
        branch = _Node(leave, {other[leave]: node, key[leave]: _Node(width, None, [i])}, None)
        if parent is None:
            root = branch
        else:
            parent.children[key[parent.depth]] = branch
    order: list[int] = []
    shared: list[int] = []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node.children is None:
            order += node.leaf
            shared += [depth] + [width] * (len(node.leaf) - 1)
        else:
            kids = [node.children[c] for c in sorted(node.children)]
            stack += [(k, node.depth if j else depth) for j, k in reversed(list(enumerate(kids)))]
    return order, shared


def multikey_quicksort(words: np.ndarray, order: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Sort `order` in place by the first `depth` words of the rows, each segment (from one start to the next) by itself.
    Returns the starts of the runs that have these words in common.

    Ternary partitions by a pivot at one word; the middle part goes on at the next word. All segments are partitioned at
    once, one level of the recursion after another.
    """
    bounds = np.append(starts, len(order))
    done = [starts]
    at, size, level = bounds[:-1], np.diff(bounds), np.zeros(len(starts), dtype=np.int64)
    while True:
        on = (size > 1) & (level < depth)
        at, size, level = at[on], size[on], level[on]
        if not len(at):
            return np.unique(np.concatenate(done))
        place, of = gather_runs(at, size), np.repeat(np.arange(len(at)), size)
        rows = order[place]
        value = words[rows, level[of]]
        ends = ragged(size)
        three = np.stack([value[ends[:-1]], value[(ends[:-1] + ends[1:]) // 2], value[ends[1:] - 1]])
        three.sort(axis=0)
        pivot = three[1][of]
        part = of * 3 + (value >= pivot) + (value > pivot)
        order[place] = rows[np.argsort(part, kind="stable")]
        size = np.bincount(part, minlength=3 * len(at))
        at = np.repeat(at - ends[:-1], 3) + ragged(size)[:-1]
        level = np.repeat(level, 3) + (np.arange(len(size)) % 3 == 1)
        done.append(at[size > 0])


def neighbours_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common leading bytes of each row with the one before it in the order (0 for the first)."""
    out = np.zeros(len(order), dtype=np.int64)
    for a in range(1, len(order), 1 << 14):
        x = words[order[a : a + (1 << 14)]] ^ words[order[a - 1 : a - 1 + (1 << 14)][: len(order) - a]]
        differ = x != 0
        first = differ.argmax(axis=1)
        left = x[np.arange(len(x)), first]
        zeros = sum((left < (1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[a : a + len(x)] = np.where(differ.any(axis=1), 8 * first + zeros, 8 * words.shape[1])
    return out


def deep_shallow(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (n x width bytes, width a multiple of 8) by group and then by content, and the common prefix of
    each with the row before it in that order: -1 where a group begins."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = groups[order][1:] != groups[order][:-1]
    starts = np.append(multikey_quicksort(words, order, np.flatnonzero(new), SHALLOW // 8), n)
    sizes = np.diff(starts)
    for a, size in zip(starts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = order[a : a + size]
        got, _ = blind_trie_order([rows[i].tobytes() for i in own.tolist()])
        order[a : a + size] = own[got]
    shared = neighbours_prefix(words, order)
    shared[new] = -1
    return order, shared
