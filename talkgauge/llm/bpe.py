"""Byte pair encoding by the last token of each prefix, for many words in step.

Every prefix of a word has exactly one last token in its encoding.  It is the longest token that ends
there and that may follow the last token of the prefix before it; whether two tokens may stand side by
side is a property of the pair alone, found by undoing their merges from the latest to the earliest.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np

_NONE = np.int64(1 << 40)
_SHIFT = 21


class IntMap:
    """A fixed map from non-negative int64 keys to int32 values with vectorised look-ups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(1.6 * len(keys)).bit_length())  # 30 to 60 % of the places are taken
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, -1, dtype=np.int32)
        keys, first = np.unique(np.asarray(keys, dtype=np.int64), return_index=True)
        values = np.asarray(values, dtype=np.int32)[first]
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last one stays
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that the map lacks."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Merges:
    """Tokens as strings of symbols, their merges and the automaton that finds them.

    ``tokens`` maps ids to symbol tuples, ``merges`` lists (left id, right id, merged id) by rank.
    Tokens that their own encoding never yields are left out of the automaton.
    """

    def __init__(self, tokens: dict[int, tuple[int, ...]], merges: Iterable[tuple[int, int, int]]):
        size = max(tokens, default=0) + 1
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.length = np.zeros(size, dtype=np.int64)
        pairs: dict[int, int] = {}
        reached = {t: s for t, s in tokens.items() if len(s) == 1}
        self._pairs = pairs
        for rank, (a, b, t) in enumerate(merges):
            if a in reached and b in reached and t not in reached and self.may_follow(a, b):
                self.left[t], self.right[t], self.rank[t] = a, b, rank
                pairs[a << _SHIFT | b] = rank
                reached[t] = tokens[t]
        for t, symbols in reached.items():
            self.length[t] = len(symbols)
        self.pairs = IntMap(np.array(list(pairs), dtype=np.int64), np.array(list(pairs.values()), dtype=np.int64))
        self._automaton(reached)
        self.memo_keys = np.full(1 << 19, -1, dtype=np.int64)
        self.memo = np.zeros(1 << 19, dtype=bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.memo_keys = np.full(1 << 19, -1, dtype=np.int64)
        self.memo = np.zeros(1 << 19, dtype=bool)

    def may_follow(self, a: int, b: int) -> bool:
        """The test for one pair."""
        limit = int(_NONE)
        rank, left, right, pairs = self.rank, self.left, self.right, self._pairs
        while True:
            if pairs.get(int(a) << _SHIFT | int(b), limit) < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], right[a]
            else:
                limit, b = rank[b] + 1, left[b]

    def _automaton(self, tokens: dict[int, tuple[int, ...]]) -> None:
        next_of: list[dict[int, int]] = [{}]
        token_at = [-1]
        for t, symbols in tokens.items():
            node = 0
            for s in symbols:
                if s not in next_of[node]:
                    next_of[node][s] = len(next_of)
                    next_of.append({})
                    token_at.append(-1)
                node = next_of[node][s]
            token_at[node] = t
        fail, out = [0] * len(next_of), list(token_at)
        self.shorter = np.full(len(self.rank), -1, dtype=np.int64)
        order = [0]
        for node in order:
            for s, child in next_of[node].items():
                order.append(child)
                if node:
                    f = fail[node]
                    while f and s not in next_of[f]:
                        f = fail[f]
                    fail[child] = next_of[f].get(s, 0)
                below = out[fail[child]]
                if token_at[child] >= 0:
                    self.shorter[token_at[child]] = below
                else:
                    out[child] = below
        self.fail = np.array(fail, dtype=np.int64)
        self.out = np.array(out, dtype=np.int64)
        keys = [n << _SHIFT | s for n, kids in enumerate(next_of) for s in kids]
        self.step_map = IntMap(np.array(keys, dtype=np.int64), np.array([k for kids in next_of for k in kids.values()]))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a, for many pairs; recent answers are remembered."""
        key = a << _SHIFT | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)
        known = self.memo_keys[slot] == key
        out = self.memo[slot]
        todo = np.flatnonzero(~known)
        if len(todo):
            fresh, back = np.unique(key[todo], return_inverse=True)
            valid = self._unmerge(fresh >> _SHIFT, fresh & ((1 << _SHIFT) - 1))
            out[todo] = valid[back]
            # one write of both values per slot, so that key and answer belong together
            self.memo_keys[slot[todo]] = -1
            order = np.unique(slot[todo], return_index=True)[1]
            self.memo_keys[slot[todo][order]] = key[todo][order]
            self.memo[slot[todo][order]] = out[todo][order]
        return out

    def _unmerge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        valid = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        a, b = a.copy(), b.copy()
        while len(live):
            rank = self.pairs.get(a << _SHIFT | b).astype(np.int64)
            crossed = (rank >= 0) & (rank < limit)
            valid[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            a, b, ra, rb, live = a[go], b[go], ra[go], rb[go], live[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a = np.where(undo_left, self.right[a], a)
            b = np.where(undo_left, b, self.left[b])
        return valid

    def steps(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The automaton's next nodes."""
        out = self.step_map.get(node << _SHIFT | symbol).astype(np.int64)
        left = np.flatnonzero((out < 0) & (node > 0))
        at = node[left]
        while len(left):
            at = self.fail[at]
            got = self.step_map.get(at << _SHIFT | symbol[left])
            out[left] = got
            more = (got < 0) & (at > 0)
            left, at = left[more], at[more]
        return np.maximum(out, 0)

    def last_tokens(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last token of every prefix of every word; -1 where a symbol belongs to no token.

        ``at`` holds the n + 1 offsets of the words among the symbols.
        """
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = at[:-1][order], sizes[order]
        last = np.full(len(symbols), -1, dtype=np.int64)
        node = np.zeros(len(order), dtype=np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        falling = -sizes
        for i in range(longest):
            n = int(np.searchsorted(falling, -i))  # words of more than i symbols
            here = starts[:n] + i
            node = self.steps(node[:n], symbols[here])
            token = self.out[node]
            open_ = np.flatnonzero(token >= 0)
            token = token[open_]
            while len(open_):
                before = i - self.length[token]  # index of the symbol before the token
                fits = before < 0
                inner = np.flatnonzero(~fits)
                prior = last[starts[open_[inner]] + before[inner]]
                free = prior < 0
                fits[inner[free]] = True
                bound = inner[~free]
                fits[bound] = self.compatible(prior[~free], token[bound])
                last[here[open_[fits]]] = token[fits]
                open_, token = open_[~fits], self.shorter[token[~fits]]
                have = token >= 0
                open_, token = open_[have], token[have]
        return last

    def encode(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row and the positions of their last symbols.

        A symbol outside all tokens gives the id -1.
        """
        last = self.last_tokens(symbols, at)
        ends = np.zeros(len(symbols), dtype=bool)
        position, floor = at[1:] - 1, at[:-1]
        live = position >= floor
        position, floor = position[live], floor[live]
        while len(position):
            ends[position] = True
            token = last[position]
            position = position - np.where(token >= 0, self.length[token], 1)
            live = position >= floor
            position, floor = position[live], floor[live]
        where = np.flatnonzero(ends)
        return last[where], where


def all_splits(tokens: dict[int, tuple[int, ...]], by_rank: Sequence[int]) -> Iterable[tuple[int, int, int]]:
    """Every way to join two tokens into a third, by the rank of the third."""
    ids = {s: t for t, s in tokens.items()}
    for t in by_rank:
        s = tokens[t]
        for k in range(1, len(s)):
            a, b = ids.get(s[:k]), ids.get(s[k:])
            if a is not None and b is not None:
                yield a, b, t
