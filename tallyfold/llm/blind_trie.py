"""Ordering strings as deep-shallow sorting does: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np


class BlindTrie:
    """A compact trie that keeps branch places and characters only; strings of equal length, equal ones together.

    A search follows branch characters blindly to some leaf, compares once with that leaf's string, and so learns
    where the new string leaves the trie.
    """

    def __init__(self) -> None:
        self.root: list | None = None  # inner: [place, {char: node}], leaf: [string, members]

    def insert(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while isinstance(node[0], int):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == s:
            node[1].append(member)
            return
        apart = next(k for k, (a, b) in enumerate(zip(s, other)) if a != b)
        above, node = None, self.root
        while isinstance(node[0], int) and node[0] < apart:
            above, node = node, node[1][s[node[0]]]
        leaf = [s, [member]]
        if isinstance(node[0], int) and node[0] == apart:
            node[1][s[apart]] = leaf
            return
        inner = [apart, {s[apart]: leaf, other[apart]: node}]
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner

    def ordered(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node[0], int):
                todo.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a big-endian word; bytes after the end are 0."""
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def multikey_quicksort(perm: np.ndarray, lo: np.ndarray, hi: np.ndarray, key_of, depths: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the segments lo..hi of perm in place by their keys of depth 0, 1, ...; (lo, hi) of what is equal in all.

    Three-way partitioning about a median of three: the smaller and the larger part stay at their depth, the equal
    part goes one deeper. All segments take a step at once. key_of(members, depths) gives keys.
    """
    depth = np.zeros(len(lo), np.int64)
    equal: list[tuple[np.ndarray, np.ndarray]] = []
    keep = hi - lo > 1
    lo, hi, depth = lo[keep], hi[keep], depth[keep]
    while len(lo):
        size = hi - lo
        first = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(seg)) + (lo - first)[seg]
        moved = perm[at]
        key = key_of(moved, depth[seg])
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[seg]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        n_less, n_same = np.add.reduceat(less, first, dtype=np.int64), np.add.reduceat(same, first, dtype=np.int64)
        to = np.empty(len(seg), np.int64)
        for part, begin in ((less, lo), (same, lo + n_less), (more, lo + n_less + n_same)):
            rank = np.cumsum(part) - part
            to[part] = (begin[seg] + rank - rank[first][seg])[part]
        perm[to] = moved
        last = depth + 1 >= depths
        equal.append(((lo + n_less)[last], (lo + n_less + n_same)[last]))
        mid, end = lo + n_less, lo + n_less + n_same
        lo, hi, depth = np.r_[lo, mid[~last], end], np.r_[mid, end[~last], hi], np.r_[depth, depth[~last] + 1, depth]
        keep = hi - lo > 1
        lo, hi, depth = lo[keep], hi[keep], depth[keep]
    lo, hi = (np.concatenate([x[k] for x in equal]) if equal else lo for k in (0, 1))
    keep = hi - lo > 1
    return lo[keep], hi[keep]


def equal_groups(group: np.ndarray, start: np.ndarray, length: int, text: np.ndarray, shallow_words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(member, class) of strings text[start:start + length] that another of their group equals, classes in order.

    Multikey quicksort orders each group to a depth of shallow_words words of 8 bytes; what is alone by then is done.
    Members that still share their prefix are ordered by a blind trie, unless all the rest of them is equal, which is
    one leaf.
    """
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = words_at(text)
    perm = np.argsort(group, kind="stable")
    lo = np.flatnonzero(np.r_[True, group[perm][1:] != group[perm][:-1]])
    hi = np.r_[lo[1:], len(perm)]
    depths = min(shallow_words, length // 8)
    if depths:
        lo, hi = multikey_quicksort(perm, lo, hi, lambda m, d: word[start[m] + 8 * d], depths)
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(lo)
    lo, size = lo[order], (hi - lo)[order]
    first = np.cumsum(size) - size
    member = perm[np.arange(int(size.sum())) + np.repeat(lo - first, size)]
    head, done = np.repeat(member[first], size), 8 * depths
    same = np.ones(len(member), bool)
    for k in [*range(done, length - 7, 8), *([length - 8] if length >= 8 and (length - done) % 8 else range(done, length) if length < 8 else [])]:
        same &= (word[start[member] + k] == word[start[head] + k]) if length >= 8 else text[start[member] + k] == text[start[head] + k]
    whole = np.logical_and.reduceat(same, first)
    out = np.repeat(np.arange(len(first)) << 32, size)
    data, begin, rest = text.tobytes(), (start[member] + done).tolist(), length - done
    places: list[int] = []
    ranks: list[int] = []
    for f, n in zip(first[~whole].tolist(), size[~whole].tolist()):
        trie = BlindTrie()
        for k in range(f, f + n):
            trie.insert(data[begin[k] : begin[k] + rest], k)
        for rank, ks in enumerate(trie.ordered()):
            places += ks
            ranks += [rank] * len(ks)
    out[np.array(places, np.int64)] += np.array(ranks, np.int64)
    _, out, count = np.unique(out, return_inverse=True, return_counts=True)
    keep = count[out] > 1
    return member[keep], out[keep]
