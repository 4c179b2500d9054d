"""Double-array tries over byte strings, built and walked with whole-array steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SYMBOLS = 256
#: Slots per edge at the start; the array grows where keys do not fit.
ROOM = 1.7


@dataclass
class Trie:
    """State ``s`` goes to ``base[s] + symbol`` if ``check`` of that slot is ``s``; ``value`` is a key's number or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of them exist."""
        nxt = self.base[states] + symbols
        return nxt, self.check[nxt] == states


def _place(parent: np.ndarray, symbol: np.ndarray, nodes: int) -> tuple[np.ndarray, int]:
    """A base per node, so that no two edges share a slot: nodes of many edges first, proposals for all others at once."""
    rng = np.random.default_rng(0)
    used = np.zeros(int(ROOM * len(parent)) + 4 * SYMBOLS, bool)
    used[0] = True  # the root
    base = np.zeros(nodes, np.int64)
    degree = np.bincount(parent, minlength=nodes)
    first = np.concatenate([[0], np.cumsum(degree)[:-1]])  # edges come in order of their parents
    for least, most in ((65, 256), (17, 64), (5, 16), (2, 4), (1, 1)):
        todo = np.flatnonzero((degree >= least) & (degree <= most))
        while todo.size:
            now = todo[: max(1, len(used) // (8 * most))]
            sizes = degree[now]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            edge = np.arange(sizes.sum()) - np.repeat(starts, sizes) + np.repeat(first[now], sizes)
            offer = rng.integers(1, len(used) - SYMBOLS, len(now))
            slot = np.repeat(offer, sizes) + symbol[edge]
            taken = np.ones(len(slot), bool)
            taken[np.unique(slot, return_index=True)[1]] = False
            good = ~np.logical_or.reduceat(taken | used[slot], starts)
            base[now[good]] = offer[good]
            used[slot[np.repeat(good, sizes)]] = True
            todo = np.concatenate([now[~good], todo[len(now) :]])
            if good.mean() < 0.05:
                used = np.concatenate([used, np.zeros(len(used) // 4 + SYMBOLS, bool)])
    return base, len(used)


def build(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Trie:
    """The trie of the different keys ``flat[starts[i] : starts[i] + lengths[i]]``; key i has value i."""
    node = np.zeros(len(starts), np.int64)
    parents, symbols, nodes, level = [], [], 1, 0
    active = np.flatnonzero(lengths > 0)
    while active.size:
        edges, inverse = np.unique(node[active] * SYMBOLS + flat[starts[active] + level], return_inverse=True)
        parents.append(edges // SYMBOLS)
        symbols.append(edges % SYMBOLS)
        node[active] = nodes + inverse
        nodes += len(edges)
        level += 1
        active = active[lengths[active] > level]
    parent = np.concatenate([*parents, np.zeros(0, np.int64)])
    symbol = np.concatenate([*symbols, np.zeros(0, np.int64)])
    at, size = _place(parent, symbol, nodes)
    slot = np.zeros(nodes, np.int64)
    slot[1:] = at[parent] + symbol  # edge e leads to node e + 1
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    base[slot] = at
    check[slot[1:]] = slot[parent]
    value[slot[node]] = np.arange(len(starts))
    return Trie(base, check, value)


def of_numbers(columns: list[np.ndarray], width: int) -> Trie:
    """The trie of sequences of numbers, one column per place, each number as ``width`` bytes, highest first."""
    rows = len(columns[0])
    flat = np.empty((rows, len(columns), width), np.uint8)
    for i, column in enumerate(columns):
        for k in range(width):
            flat[:, i, k] = (column >> (8 * (width - 1 - k))) & 255
    length = len(columns) * width
    return build(flat.reshape(-1), np.arange(rows, dtype=np.int64) * length, np.full(rows, length))


def of_texts(keys: list[bytes]) -> Trie:
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return build(np.frombuffer(b"".join(keys) or b"\0", np.uint8), starts, lengths)
