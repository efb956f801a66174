"""Deep-shallow sorting of short byte strings, for the suffixes that leave an anchor in either direction.

Strings are rows of big-endian 64-bit words, padded with zeros. Multikey quicksort takes a word as one character: all
groups of one level are parted at once, and only ties go on to the next word, down to ``SHALLOW`` words. Groups that
still agree there have a long common prefix; a blind trie orders each of them.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3


def words_of(strings: list[bytes], width: int) -> np.ndarray:
    """A row of ``width / 8`` words for every string."""
    data = b"".join(s[:width].ljust(width, b"\0") for s in strings)
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(len(strings), width // 8)


class BlindTrie:
    """A trie of branching places only. A node is [place, {byte: child}]; a leaf is a list of equal strings' numbers.

    Descending looks at the branching bytes alone, so the leaf it ends in shares the longest prefix that any leaf shares;
    one comparison with that leaf finds the place where the new string leaves the trie.
    """

    def __init__(self, width: int):
        self.width, self.root, self.strings = width, None, {}

    def add(self, number: int, string: bytes) -> None:
        value = int.from_bytes(string, "big")
        if self.root is None:
            self.root = (None, [number])
            self.strings[number] = (string, value)
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other, other_value = self.strings[node[1][0]]
        if other_value == value:
            node[1].append(number)
            return
        place = self.width - ((value ^ other_value).bit_length() + 7) // 8
        self.strings[number] = (string, value)
        leaf = (None, [number])
        above, node = None, self.root
        while node[0] is not None and node[0] < place:
            above, node = node, node[1][string[node[0]]]
        if node[0] == place:
            node[1][string[place]] = leaf
            return
        branch = (place, {other[place]: node, string[place]: leaf})
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def order_of(words: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows by group and string."""
    order = np.lexsort((words[:, 0], group))
    tie = same_as_before(order, group) & same_as_before(order, words[:, 0])
    for level in range(1, min(shallow, words.shape[1])):
        at, runs = tied(tie)
        if not len(at):
            return order
        order[at] = order[at][np.lexsort((words[order[at], level], runs))]
        tie &= same_as_before(order, words[:, level])
    at, runs = tied(tie)
    if len(at):
        width = 8 * words.shape[1]
        data = words.astype(">u8").tobytes()
        for first, last in zip(*run_ends(runs), strict=True):
            members, trie = order[at[first:last]].tolist(), BlindTrie(width)
            for i in members:
                trie.add(i, data[i * width:(i + 1) * width])
            order[at[first:last]] = trie.ordered()
    return order


def same_as_before(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    sorted_ = values[order]
    return np.concatenate([[False], sorted_[1:] == sorted_[:-1]])


def tied(tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in runs of two or more ties, and the number of each one's run."""
    member = tie | np.concatenate([tie[1:], [False]])
    at = np.flatnonzero(member)
    return at, np.cumsum(~tie)[at]


def run_ends(runs: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(np.diff(runs)) + 1).tolist()
    return [0, *cuts], [*cuts, len(runs)]


def common_prefixes(words: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each string shares with the one before it in order; -1 for the first of a group."""
    sorted_ = words[order]
    differs = sorted_[1:] ^ sorted_[:-1]
    first = (differs != 0).argmax(axis=1)
    word = differs[np.arange(len(differs)), first]
    shift, zeros = word.copy(), np.zeros(len(word), np.int64)
    for step in (32, 16, 8):
        high = shift < (np.uint64(1) << np.uint64(64 - step))
        zeros[high] += step
        shift[high] <<= np.uint64(step)
    shared = np.where(word == 0, 8 * words.shape[1], 8 * first + zeros // 8)
    grouped = group[order]
    return np.concatenate([[-1], np.where(grouped[1:] == grouped[:-1], shared, -1)])
