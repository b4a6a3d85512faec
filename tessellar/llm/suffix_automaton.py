"""A generalised suffix automaton of bounded depth over sequences of word numbers, in arrays.

States are the classes of phrases of at most `depth` words that end at the same places (endpos). The
phrases of a state are suffixes of its longest one; its suffix link leads to the state of the longest
suffix that ends at more places. Built level by level: the phrases of k + 1 words are the distinct pairs of
a phrase of k words and the word before it, and a phrase that always follows the same word is in the
state of the longer one. Transitions aren't stored: counting and enumerating go along states and links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROOT = -1


@dataclass
class SuffixAutomaton:
    words: np.ndarray
    #: By state: words of its longest phrase, the state its link leads to, number of its end places, one of them.
    longest: np.ndarray
    link: np.ndarray
    endpos: np.ndarray
    end: np.ndarray

    @property
    def shortest(self) -> np.ndarray:
        """Words of each state's shortest phrase: one more than the longest of the state it links to."""
        return np.where(self.link == ROOT, 0, self.longest[self.link]) + 1

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of so many words, one a row, and how often each occurs."""
        held = np.flatnonzero((self.shortest <= length) & (length <= self.longest))
        return self.words[self.end[held][:, None] + np.arange(1 - length, 1)], self.endpos[held]


def build(words: np.ndarray, room: np.ndarray, depth: int) -> SuffixAutomaton:
    """words: numbers from 0, each of which occurs; room: words of its own sequence up to and with each word."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return SuffixAutomaton(words, none, none, none, none)
    many = int(words.max()) + 1
    where, at = np.arange(len(words)), words.astype(np.int64)  # places, and the number of the phrase that ends there
    first = np.zeros(many, np.int64)
    first[words] = where
    levels = [(np.bincount(words, minlength=many), first, None)]  # by phrase: count, a place it ends at, its suffix one word shorter
    for k in range(1, depth):
        on = room[where] > k
        where, at = where[on], at[on]
        if not len(where):
            break
        _, some, now, n = np.unique(at * many + words[where - k], return_index=True, return_inverse=True, return_counts=True)
        levels.append((n, where[some], at[some]))
        at = now
    longest, endpos, end, states, total = [], [], [], [None] * len(levels), 0
    for k in reversed(range(len(levels))):
        count, first, _ = levels[k]
        state = np.full(len(count), ROOT, np.int64)
        if k + 1 < len(levels):
            n, _, up = levels[k + 1]
            same = n == count[up]
            state[up[same]] = states[k + 1][same]
        new = np.flatnonzero(state == ROOT)
        state[new] = total + np.arange(len(new))
        total += len(new)
        longest.append(np.full(len(new), k + 1))
        endpos.append(count[new])
        end.append(first[new])
        states[k] = state
    link = np.full(total, ROOT, np.int64)
    for k in range(1, len(levels)):
        up = levels[k][2]
        top = states[k] != states[k - 1][up]
        link[states[k][top]] = states[k - 1][up[top]]
    return SuffixAutomaton(words, np.concatenate(longest), link, np.concatenate(endpos), np.concatenate(end))
