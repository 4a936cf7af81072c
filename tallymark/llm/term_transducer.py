"""Minimal acyclic transducers: sorted words to their places in order, over bytes.

Words come in ascending order; equal right languages share one state, so the automaton stays minimal while it grows. Each
transition carries how many words come before it; the sum along a path is the word's place.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Words walked at once.
LANES = 200_000


class Transducer:
    """Arrays of a finished automaton: transitions sorted by state and byte, their targets and skips, and final states."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int, words: int):
        self.keys, self.targets, self.skips, self.final, self.root, self.words = keys, targets, skips, final, root, words

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        below: list[int] = []  # words from each state on
        path: list[list] = [[False, [], []]]  # open states: final, bytes, targets of the closed children

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, labels, targets = path.pop()
                state = (final, tuple(labels), tuple(targets))
                number = known.get(state)
                if number is None:
                    number = known[state] = len(states)
                    states.append(state)
                    below.append(final + sum(below[t] for t in targets))
                path[-1][2].append(number)

        last = None
        for word in words:
            if last is not None and word <= last:
                raise ValueError("words must ascend")
            depth, most = 0, min(len(word), len(last or b""))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            close(depth)
            for byte in word[depth:]:
                path[-1][1].append(byte)
                path.append([False, [], []])
            path[-1][0] = True
            last = word
        close(0)
        root = (path[0][0], tuple(path[0][1]), tuple(path[0][2]))
        states.append(root)
        below.append(root[0] + sum(below[t] for t in root[2]))
        keys, targets, skips = [], [], []
        for number, (final, labels, children) in enumerate(states):
            seen = int(final)
            for byte, child in zip(labels, children, strict=True):
                keys.append(number << 8 | byte)
                targets.append(child)
                skips.append(seen)
                seen += below[child]
        final = np.array([s[0] for s in states], bool)
        return cls(np.array(keys, np.int64), np.array(targets, np.int64), np.array(skips, np.int64), final, len(states) - 1, below[-1])

    def pack(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.root, self.words], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets.astype(np.int32), self.skips.astype(np.int32), self.final))

    @classmethod
    def unpack(cls, data: bytes) -> Transducer:
        n, states, root, words = np.frombuffer(data, np.int64, 4).tolist()
        keys = np.frombuffer(data, np.int64, n, 32)
        targets = np.frombuffer(data, np.int32, n, 32 + 8 * n).astype(np.int64)
        skips = np.frombuffer(data, np.int32, n, 32 + 12 * n).astype(np.int64)
        return cls(keys, targets, skips, np.frombuffer(data, bool, states, 32 + 16 * n), root, words)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word ``data[start:end]``, or -1; all words walk side by side, one byte a step."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return out
        for low in range(0, len(starts), LANES):
            lanes = np.arange(low, min(low + LANES, len(starts)))
            state, place = np.full(len(lanes), self.root), np.zeros(len(lanes), np.int64)
            at, end = starts[lanes], ends[lanes]
            while len(lanes):
                key = state << 8 | data[at]
                edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                alive = self.keys[edge] == key
                edge, lanes, at, end, place = edge[alive], lanes[alive], at[alive] + 1, end[alive], place[alive]
                state, place = self.targets[edge], place + self.skips[edge]
                over = at == end
                if over.any():
                    done = over & self.final[state]
                    out[lanes[done]] = place[done]
                    on = ~over
                    lanes, at, end, state, place = lanes[on], at[on], end[on], state[on], place[on]
        return out
