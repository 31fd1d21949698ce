"""Suffix automaton over token sequences with the smallest owner of every substring."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Automaton of several sequences; ``owner`` of a state is the smallest owner among its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [float("inf")]
        self._settled = True

    def _state(self, moves: dict, link: int, length: int, owner: float) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, token: Hashable, q: int) -> int:
        """State for exactly the suffix read over ``p``: ``q`` itself, or a clone of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, float("inf"))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, tokens: Sequence[Hashable], owner: int) -> None:
        at = 0
        for t in tokens:
            if (q := self.next[at].get(t)) is not None:
                at = self._split(at, t, q)
            else:
                new = self._state({}, 0, self.length[at] + 1, float("inf"))
                p = at
                while p >= 0 and t not in self.next[p]:
                    self.next[p][t] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, t, self.next[p][t])
                at = new
            if owner < self.owner[at]:
                self.owner[at] = owner
        self._settled = False

    def settle(self) -> None:
        """Hand owners up the suffix links, longest states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.owner[s] < self.owner[up]:
                self.owner[up] = self.owner[s]
        self._settled = True

    def stream(self, tokens: Sequence[Hashable], least: int):
        """Matching statistics: per token the length of the longest match that ends there, and the
        smallest owner of the match's last ``least`` tokens (None while it is shorter)."""
        if not self._settled:
            self.settle()
        at = length = 0
        for t in tokens:
            while at and t not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if t in self.next[at]:
                at, length = self.next[at][t], length + 1
            owner = None
            if length >= least:
                s = at
                while self.length[self.link[s]] >= least:
                    s = self.link[s]
                owner = self.owner[s]
            yield length, owner
