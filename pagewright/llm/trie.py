"""Double-array tries over numbered words, whose transitions numpy makes for all positions of a text at once."""

from __future__ import annotations

import numpy as np

#: places tried together for a node with several children
TRIES = 256


class Trie:
    """Phrases of one length. State 0 is no state, state w is the one word w, later ones follow by ``base`` and ``check``.

    From state s the word w leads to base[s] + w, if check of that is s.
    """

    def __init__(self, phrases: np.ndarray, n_words: int):
        """``phrases`` has one row of word numbers (from 1 to ``n_words``) for each phrase, no two alike."""
        self.depth = phrases.shape[1]
        order = np.lexsort(phrases.T[::-1])
        rows = phrases[order].astype(np.int64)
        self.size = n_words + 1
        self.base, self.check = np.zeros(self.size, np.int32), np.full(self.size, -1, np.int32)
        self.check[1:] = 0
        self.rng = np.random.default_rng(1)
        states = rows[:, 0].copy()
        for j in range(1, self.depth):
            # rows are sorted, so the children of one state stand together
            new = np.ones(len(rows), bool)
            new[1:] = (states[1:] != states[:-1]) | (rows[1:, j] != rows[:-1, j])
            child = np.cumsum(new) - 1
            states = self._grow(states[new], rows[new, j])[child]
        #: the row of ``phrases`` that ends in a state, from 1; 0 for none
        self.ends = np.zeros(self.size, np.int32)
        self.ends[states] = order + 1
        del self.rng

    def _more(self, size: int) -> None:
        if size > self.size:
            size = max(size, self.size + self.size // 2)
            self.base = np.concatenate([self.base, np.zeros(size - self.size, np.int32)])
            self.check = np.concatenate([self.check, np.full(size - self.size, -1, np.int32)])
            self.size = size

    def _grow(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Gives the states in ``parents`` (sorted) children by ``words``; returns the children's states."""
        out = np.zeros(len(parents), np.int64)
        if not len(parents):
            return out
        start = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        n = np.diff(np.concatenate([start, [len(parents)]]))
        for k in np.argsort(-n, kind="stable")[: int((n > 1).sum())].tolist():
            some = slice(start[k], start[k] + n[k])
            out[some] = self._place(int(parents[start[k]]), words[some])
        single = start[n == 1]
        free = np.flatnonzero(self.check[1:] == -1) + 1
        if len(free) < len(single):
            self._more(self.size + len(single))
            free = np.flatnonzero(self.check[1:] == -1) + 1
        at = free[: len(single)]
        self.base[parents[single]] = at - words[single]
        self.check[at] = parents[single]
        out[single] = at
        return out

    def _place(self, parent: int, words: np.ndarray) -> np.ndarray:
        """States for the children of one parent, at a place where all are free."""
        ahead = words - words[0]
        self._more(int(ahead[-1]) + 2 * len(words) + 2)
        while True:
            room = self.size - int(ahead[-1])
            first = self.rng.integers(1, room, min(TRIES, max(8, (1 << 16) // len(words))))
            fits = (self.check[first[:, None] + ahead] == -1).all(1)
            if fits.any():
                at = int(first[np.argmax(fits)])
                self.base[parent] = at - words[0]
                self.check[at + ahead] = parent
                return at + ahead
            self._more(self.size + max(int(ahead[-1]), self.size // 4))

    def ends_at(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``text`` (word numbers, 0 between pieces) where a phrase starts, and its row from 1.

        All positions take one step together for each word of the phrase.
        """
        at = np.flatnonzero(text[: len(text) - self.depth + 1]) if len(text) >= self.depth else np.zeros(0, np.int64)
        state = text[at].astype(np.int64)
        for j in range(1, self.depth):
            word = text[at + j]
            then = self.base[state] + word.astype(np.int64)
            goes = (word > 0) & (then > 0) & (then < self.size)
            at, then, state = at[goes], then[goes], state[goes]
            goes = self.check[then] == state
            at, state = at[goes], then[goes]
        row = self.ends[state]
        found = row > 0
        return at[found], row[found]
