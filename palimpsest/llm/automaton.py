"""Candidate retrieval: a Levenshtein automaton run over a vocabulary trie.

States of the automaton are (position in the word as read, cost so far).  The
automaton and the trie are walked together, so exactly the vocabulary words
within the cost bound come out, without generating or scanning the others.
Costs are weighted: a confusion of letter shapes, a digit in a letter's place
and a stray mark are cheap, any other edit is dear.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

#: Letters that print and scanning confuse, as (true, read) pairs (fixed values).
CONFUSED = (
    "יו וי הח חה וז זו תח חת בכ כב םס סם מט טמ נג גנ עצ צע רד דר קה הק ןו ון ןז "
    "il li ce ec un nu ft tf hb bh oc co ao oa ij ıi sf rn"
)
#: Letter groups read as one and the reverse, as (true, read) pairs (fixed values).
MERGED = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("vv", "w"), ("w", "vv"), ("li", "h"))
SHAPE, STRAY, DIGIT, OTHER = 2, 2, 2, 5


def _confusions() -> dict[str, str]:
    out: dict[str, str] = {}
    for true, read in CONFUSED.split():
        out[read] = out.get(read, "") + true
    return out


_BY_READ = _confusions()


class Trie:
    """A trie in three flat arrays: labels of the nodes level by level, where each node's children begin, and frequencies.

    About 12 bytes a node; the children of a node are neighbours, so one is found by a search of the label string.
    """

    def __init__(self, words: Iterable[tuple[str, int]]):
        counts: dict[str, int] = {}
        for word, n in words:
            counts[word] = counts.get(word, 0) + n
        ordered = sorted(w for w in counts if w)
        labels, self.first, self.freq = ["\0"], array("I"), array("I", [0])
        level = [(0, len(ordered), 0)]
        while level:
            deeper = []
            for low, high, depth in level:
                self.first.append(len(labels))
                while low < high:
                    word = ordered[low]
                    if len(word) == depth:
                        low += 1
                        continue
                    end = bisect_right(ordered, word[depth], low, high, key=lambda w: w[depth])
                    labels.append(word[depth])
                    self.freq.append(min(counts[word], 2**32 - 1) if len(word) == depth + 1 else 0)
                    deeper.append((low, end, depth + 1))
                    low = end
            level = deeper
        self.first.append(len(labels))
        self.labels = "".join(labels)
        self._cache()

    def _cache(self) -> None:
        self.near = lru_cache(maxsize=200_000)(self._near)
        self.count = lru_cache(maxsize=200_000)(self._count)

    def __getstate__(self) -> tuple:
        return self.labels, self.first, self.freq

    def __setstate__(self, state: tuple) -> None:
        self.labels, self.first, self.freq = state
        self._cache()

    def child(self, node: int, c: str) -> int:
        """The child of `node` under the character `c`, or -1."""
        return self.labels.find(c, self.first[node], self.first[node + 1])

    def _count(self, word: str) -> int:
        """Frequency of a vocabulary word, 0 for any other string."""
        node = 0
        for c in word:
            node = self.child(node, c)
            if node < 0:
                return 0
        return self.freq[node]

    def __contains__(self, word: str) -> bool:
        return self.count(word) > 0

    def _near(self, read: str, bound: int) -> tuple[tuple[int, int, str], ...]:
        """(cost, -frequency, word) of every vocabulary word within `bound`, best first."""
        labels, first, freq, child = self.labels, self.first, self.freq, self.child
        best: dict[str, tuple[int, int]] = {}
        size = len(read)
        stack = [(0, 0, 0, "")]
        seen: dict[tuple[int, int], int] = {}
        while stack:
            node, i, cost, word = stack.pop()
            if seen.get((node, i), bound + 1) <= cost:
                continue
            seen[node, i] = cost
            children = range(first[node], first[node + 1])
            if i == size:
                if freq[node] and cost < best.get(word, (bound + 1,))[0]:
                    best[word] = cost, freq[node]
            else:
                c = read[i]
                if (k := child(node, c)) >= 0:
                    stack.append((k, i + 1, cost, word + c))
                if not c.isalpha():
                    if cost + STRAY <= bound:
                        stack.append((node, i + 1, cost + STRAY, word))
                    if cost + DIGIT <= bound:
                        stack.extend((k, i + 1, cost + DIGIT, word + labels[k]) for k in children)
                elif cost + SHAPE <= bound:
                    for t in _BY_READ.get(c, ""):
                        if (k := child(node, t)) >= 0:
                            stack.append((k, i + 1, cost + SHAPE, word + t))
                if cost + SHAPE <= bound:
                    for true, seen_as in MERGED:
                        if read.startswith(seen_as, i):
                            target = node
                            for t in true:
                                target = child(target, t)
                                if target < 0:
                                    break
                            else:
                                stack.append((target, i + len(seen_as), cost + SHAPE, word + true))
                if cost + OTHER <= bound:
                    stack.append((node, i + 1, cost + OTHER, word))
                    stack.extend((k, i + 1, cost + OTHER, word + labels[k]) for k in children if labels[k] != c)
            if cost + OTHER <= bound:
                stack.extend((k, i, cost + OTHER, word + labels[k]) for k in children)
        return tuple(sorted((cost, -n, word) for word, (cost, n) in best.items()))
