"""A minimal acyclic transducer from words to id sequences, as flat arrays for a memory map.

Words go in sorted, so the states behind what the next word shares are final and can be
looked up among those that are kept: equal suffixes are stored once. An edge writes the
ids that all words behind it still begin with; what is left stands at the last state.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np

from millrace.llm.bpe import gathered

_HEAD = 5


class _State:
    __slots__ = ("edges", "final", "rest")

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}  # byte -> [target, ids]
        self.final = False
        self.rest: tuple[int, ...] = ()

    def signature(self) -> tuple:
        return self.final, self.rest, tuple((b, t, ids) for b, (t, ids) in sorted(self.edges.items()))


def _shared(a: tuple | bytes, b: tuple | bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compiled(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> np.ndarray:
    """One int32 array that holds the transducer of the distinct words, of any order."""
    kept: dict[tuple, int] = {}
    states: list[tuple] = []

    def keep(state: _State) -> int:
        mark = state.signature()
        if mark not in kept:
            kept[mark] = len(states)
            states.append(mark)
        return kept[mark]

    path, last, longest = [_State()], b"", 0

    def close(down_to: int) -> None:
        for i in range(len(last), down_to, -1):
            path[i - 1].edges[last[i - 1]][0] = keep(path[i])
            path.pop()

    for word, ids in sorted(words):
        longest = max(longest, len(word))
        common = _shared(word, last)
        close(common)
        for i in range(1, common + 1):
            edge, state = path[i - 1].edges[word[i - 1]], path[i]
            n = _shared(edge[1], ids)
            late, edge[1], ids = edge[1][n:], edge[1][:n], ids[n:]
            if late:
                for e in state.edges.values():
                    e[1] = late + e[1]
                if state.final:
                    state.rest = late + state.rest
        for k in range(common, len(word)):
            path[k].edges[word[k]] = [-1, ids if k == common else ()]
            path.append(_State())
        path[-1].final = True
        if common == len(word):
            path[-1].rest = ids
        last = word
    close(0)
    root = keep(path[0])

    pool: list[int] = []
    at: dict[tuple[int, ...], int] = {}

    def place(ids: tuple[int, ...]) -> int:
        if ids not in at:
            at[ids] = len(pool)
            pool.extend(ids)
        return at[ids]

    edges = [((s << 8) | b, t, place(ids), len(ids)) for s, (_, _, out) in enumerate(states) for b, t, ids in out]
    ends = [(int(final), place(rest), len(rest)) for final, rest, _ in states]
    e, f = np.array(edges, np.int32).reshape(-1, 4), np.array(ends, np.int32).reshape(-1, 3)
    head = np.array([root, len(e), len(f), len(pool), longest], np.int32)
    return np.concatenate([head, e[:, 0], e[:, 1], e[:, 2], e[:, 3], f[:, 0], f[:, 1], f[:, 2], np.array(pool, np.int32)])


def as_file(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


class Lexicon:
    """Looks up many words at once, one byte of each in a step, in the array of ``compiled``."""

    def __init__(self, flat: np.ndarray):
        self.root, e, f, p, self.longest = (int(x) for x in flat[:_HEAD])
        ends = np.cumsum([_HEAD, e, e, e, e, f, f, f, p])
        self.key, self.target, self.out_at, self.out_n, self.final, self.rest_at, self.rest_n, self.pool = (flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """From a file that is mapped, not read: workers of a machine share its pages."""
        return cls(np.load(path, mmap_mode="r"))

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is known, ids of the known ones, offsets into them)."""
        size = np.diff(offsets)
        known = np.zeros(len(size), bool)
        if not len(self.key):
            return known, np.zeros(0, np.int64), np.zeros(1, np.int64)
        word = np.flatnonzero(size <= self.longest)
        state = np.full(len(word), self.root, np.int64)
        wrote: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = 0
        while len(word):
            over = size[word] == step
            if over.any():
                w, s = word[over], state[over]
                ok = self.final[s] == 1
                known[w[ok]] = True
                wrote.append((w[ok], self.rest_at[s[ok]], self.rest_n[s[ok]]))
                word, state = word[~over], state[~over]
            key = (state << 8) | raw[offsets[word] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            there = self.key[at] == key
            word, at = word[there], at[there]
            state = self.target[at].astype(np.int64)
            n = self.out_n[at]
            writes = n > 0
            wrote.append((word[writes], self.out_at[at[writes]], n[writes]))
            step += 1
        word, at, n = (np.concatenate(x) for x in zip(*wrote, strict=True)) if wrote else (np.zeros(0, np.int64),) * 3
        use = known[word]
        word, at, n = word[use], at[use].astype(np.int64), n[use].astype(np.int64)
        order = np.argsort(word, kind="stable")
        ids, _ = gathered(self.pool, at[order], n[order])
        per_word = np.bincount(word, weights=n, minlength=len(size)).astype(np.int64)[known]
        return known, ids.astype(np.int64), np.r_[0, np.cumsum(per_word)]
