"""A generalised suffix automaton over the words of many items, and its longest matches in a stream of words.

A state stands for the word sequences that end at the same places of the items. Read word by word, a document moves from
state to state, and its longest suffix that occurs in any item is known at every word, whatever the number of items.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence


class Automaton:
    """Built from items (sequences of words); holds the windows of each: all runs of ``window`` words, or the whole
    item if it is shorter."""

    def __init__(self, items: Sequence[Sequence[bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item] for item in items]
        moves: list[dict[int, int]] = [{}]
        link, size = array("i", [-1]), array("i", [0])
        for item in coded:
            last = 0
            for word in item:
                last = _extend(moves, link, size, last, word)
        self.link, self.size = link, size
        self._pack(moves)
        self._mark(coded, moves)

    def _pack(self, moves: list[dict[int, int]]) -> None:
        """Most states have one way on: those lie in arrays, all others in one table."""
        self.base = len(self.vocabulary) + 1
        self.root = array("i", [moves[0].get(w, 0) for w in range(len(self.vocabulary))])
        self.word, self.next, self.more = array("i"), array("i"), {}
        for state, ways in enumerate(moves):
            first = next(iter(ways.items()), (-2, 0))
            self.word.append(first[0])
            self.next.append(first[1])
            if state:
                self.more.update({state * self.base + w: t for w, t in ways.items() if w != first[0]})

    def _mark(self, coded: list[list[int]], moves: list[dict[int, int]]) -> None:
        """Which items hold each window: by the state of the window's last ``window`` words, or of a short item."""
        link, size, window = self.link, self.size, self.window
        order = sorted(range(1, len(size)), key=size.__getitem__)
        # the state on the way to the root that stands for the last `window` words
        self.anchor = array("i", bytes(4 * len(size)))
        for s in order:
            if size[s] >= window:
                self.anchor[s] = s if size[link[s]] < window else self.anchor[link[s]]
        self.holders: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for code, item in enumerate(coded):
            state = 0
            for at, word in enumerate(item, 1):
                state = moves[state][word]
                if at >= window:
                    held = self.holders.setdefault(self.anchor[state], [])
                    if not held or held[-1] != code:
                        held.append(code)
            if 0 < len(item) < window:
                self.short.setdefault(state, []).append((len(item), code))
        # the nearest state, itself included, on the way to the root at which a short item ends
        self.nearest = array("i", bytes(4 * len(size)))
        for s in order:
            self.nearest[s] = s if s in self.short else self.nearest[link[s]]

    def reader(self) -> Reader:
        return Reader(self)


def _extend(moves: list[dict[int, int]], link: array, size: array, last: int, word: int) -> int:
    """The state of the text read so far and ``word``; states are added or split where needed."""
    known = moves[last].get(word)
    if known is not None:
        return known if size[known] == size[last] + 1 else _split(moves, link, size, last, word, known)
    new = len(size)
    moves.append({})
    link.append(0)
    size.append(size[last] + 1)
    while last != -1 and word not in moves[last]:
        moves[last][word] = new
        last = link[last]
    if last != -1:
        known = moves[last][word]
        link[new] = known if size[known] == size[last] + 1 else _split(moves, link, size, last, word, known)
    return new


def _split(moves: list[dict[int, int]], link: array, size: array, last: int, word: int, known: int) -> int:
    """A state of its own for the sequences of ``known`` that are no longer than the way through ``last``."""
    part = len(size)
    moves.append(dict(moves[known]))
    link.append(link[known])
    size.append(size[last] + 1)
    link[known] = part
    while last != -1 and moves[last].get(word) == known:
        moves[last][word] = part
        last = link[last]
    return part


class Reader:
    """Reads one document, in as many portions of words as it takes."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.state = self.length = self.n_words = 0
        #: [first word, word after the last, longest match] of each run of words inside windows
        self.spans: list[list[int]] = []
        self._anchors: set[int] = set()
        self._shorts: set[int] = set()

    def read(self, words: Iterable[bytes]) -> None:
        a = self.automaton
        code, root, word, after, more, link, size = a.vocabulary.get, a.root, a.word, a.next, a.more, a.link, a.size
        nearest, anchor, window, base = a.nearest, a.anchor, a.window, a.base
        state, length, at = self.state, self.length, self.n_words
        for at, w in enumerate(map(code, words), at + 1):
            if w is None:
                state = length = 0
                continue
            while state:
                if word[state] == w:
                    state = after[state]
                    length += 1
                    break
                way = more.get(state * base + w)
                if way is not None:
                    state = way
                    length += 1
                    break
                state = link[state]
                length = size[state]
            else:
                state, length = root[w], 1
            if length >= window:
                self._hit(at - length, at, length)
                self._anchors.add(anchor[state])
            if nearest[state]:
                self._short(state, length, at)
        self.state, self.length, self.n_words = state, length, at

    def _short(self, state: int, length: int, at: int) -> None:
        a = self.automaton
        while state := a.nearest[state]:
            for n, item in a.short[state]:
                if n <= length:
                    self._hit(at - n, at, n)
                    self._shorts.add(item)
            state = a.link[state]

    def _hit(self, start: int, end: int, length: int) -> None:
        longest = length
        while self.spans and self.spans[-1][1] >= start:
            first, _, other = self.spans.pop()
            start, longest = min(start, first), max(longest, other)
        self.spans.append([start, end, longest])

    def items(self) -> set[int]:
        """Codes of the items with a window in what was read."""
        return self._shorts.union(*(self.automaton.holders[s] for s in self._anchors))
