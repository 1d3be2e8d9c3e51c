"""Deep-shallow sorting of suffixes, as far as `depth` bytes, by groups.

Shallow: multikey quicksort's order, a machine word at a time for all groups at once; a group splits by the word, and only
groups of equal words go on, to `shallow` bytes. Deep: what is left of a group has a long common prefix, and a blind trie
orders it: a suffix descends by the bytes at branching depths only, is compared once with the leaf it arrives at, and
branches off at their common prefix.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings of equal length."""
    if a == b:
        return len(a)
    differing = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (differing.bit_length() + 7) // 8


class BlindTrie:
    """Branches are [depth, {byte: child}], leaves are (text, members)."""

    def __init__(self):
        self.root = None

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        shared = common_prefix(text, node[0])
        if shared == len(text):
            node[1].append(member)
            return
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < shared:
            parent, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == shared:
            node[1][text[shared]] = (text, [member])
            return
        sample = node
        while isinstance(sample, list):
            sample = next(iter(sample[1].values()))
        branch = [shared, {sample[0][shared]: node, text[shared]: (text, [member])}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """Members of each distinct text, in the order of the texts."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.append(node[1])
        return out


def sort_suffixes(data: bytes, starts: np.ndarray, groups: np.ndarray, depth: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by group and their first `depth` bytes, and whether each equals the one before it.

    `data` must reach `depth` bytes beyond every start.
    """
    n = len(starts)
    order = np.argsort(groups, kind="stable")
    fresh = np.ones(n, bool)  # begins a new class, in order
    fresh[1:] = groups[order[1:]] != groups[order[:-1]]
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), WORD)
    for at in range(0, shallow, WORD):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        own = np.flatnonzero(tied)
        if not len(own):
            return order, ~fresh
        part, label = order[own], np.cumsum(fresh)[own]
        key = np.ascontiguousarray(words[starts[part] + at]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((key, label))
        order[own] = part[by]
        differs = np.ones(len(own), bool)
        differs[1:] = (label[by][1:] != label[by][:-1]) | (key[by][1:] != key[by][:-1])
        fresh[own] = differs
    bounds = np.append(np.flatnonzero(fresh), n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < 2:
            continue
        members, trie = order[a:b].tolist(), BlindTrie()
        for member in members:
            start = int(starts[member])
            trie.insert(data[start + shallow : start + depth], member)
        at = a
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            fresh[at] = True
            at += len(leaf)
    return order, ~fresh
