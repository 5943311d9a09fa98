"""A compiled trie over bytes, stepped from every place of a batch of texts at once.

The trie is a double array: a state's child by byte b stands at ``base[state] + b`` and names its parent in ``check``. From each place all
texts' bytes are followed for as long as a state is left, and the last state that ends a token is kept: the longest token there.
Which places a token really begins at then depends on the tokens before. Texts lie one after another and no token
leaves its text, so that is one chain from the first byte on; it is followed through all blocks of the batch side by side.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa

#: Free places that are tried at a time for a state of several children.
TRIED = 512


class NoToken(ValueError):
    """A byte at which no token begins: its value, the text and the place in it."""

    def __init__(self, byte: int, text: int, place: int):
        super().__init__(f"no token for byte {byte} at {place}")
        self.byte, self.text, self.place = byte, text, place


class Trie:
    """Tokens (id -> bytes; of equal bytes the largest id, empty ones never) as a double array with a state 0 at the root."""

    def __init__(self, table: Mapping[int, bytes]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [0]
        for token, data in sorted(table.items()):
            state = 0
            for byte in data:
                state = children[state].setdefault(byte, len(children))
                if state == len(children):
                    children.append({})
                    ends.append(0)
            if data:
                ends[state] = token
        self._place(children, np.array(ends, dtype=np.int32))

    def _place(self, children: list[dict[int, int]], ends: np.ndarray) -> None:
        """States with most children first, each at the first free places that hold all of its children; those with one
        child fill what is left."""
        n = len(children)
        size = 2 * n + 1024
        free = np.ones(size, dtype=bool)
        base, at = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)  # of states: of its children, its own place
        free[0] = False
        open_ = 0
        for state in sorted((s for s in range(n) if len(children[s]) > 1), key=lambda s: -len(children[s])):
            letters = np.array(sorted(children[state]))
            low = open_
            while True:
                places = low + np.flatnonzero(free[low : low + 4 * TRIED])[:TRIED] - letters[0]
                places = places[(places > 0) & (places + letters[-1] < size)]
                fits = np.flatnonzero(free[places[:, None] + letters].all(axis=1)) if len(places) else places
                if len(fits):
                    break
                low += 4 * TRIED
                if low + 512 > size:
                    free, size = np.concatenate([free, np.ones(size, dtype=bool)]), 2 * size
            base[state] = places[fits[0]]
            free[base[state] + letters] = False
            at[[children[state][int(b)] for b in letters]] = base[state] + letters
            while open_ < size - 1 and not free[open_]:
                open_ += 1
        single = [s for s in range(n) if len(children[s]) == 1]
        if single:
            letter = np.array([next(iter(children[s])) for s in single])
            if (need := len(single) + 512) > free[256:].sum():
                free, size = np.concatenate([free, np.ones(need, dtype=bool)]), size + need
            places = 256 + np.flatnonzero(free[256:])[: len(single)]  # no base below zero
            free[places] = False
            base[single] = places - letter
            at[[next(iter(children[s].values())) for s in single]] = places
        used = int(np.flatnonzero(~free).max(initial=0)) + 257
        self.base, self.check, self.token = np.zeros(used, dtype=np.int32), np.full(used, -1, dtype=np.int32), np.zeros(used, dtype=np.int32)
        self.base[at], self.token[at] = base, ends
        for s, own in enumerate(children):
            for child in own.values():
                self.check[at[child]] = at[s]
        self._pairs()

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children by a byte; -1 where there is none."""
        to = self.base[state] + byte
        return np.where(self.check[to] == state, to, np.int32(-1))

    def _pairs(self) -> None:
        """What the first two bytes lead to, for all of them: the state (-1 if there is none), the longest token so far."""
        byte = np.arange(256, dtype=np.int32)
        one = self._step(np.zeros(256, dtype=np.int32), byte)
        self.single = np.where(one >= 0, self.token[one], 0).astype(np.int32)
        first, second = np.repeat(one, 256), np.tile(byte, 256)
        self.state = np.where(first >= 0, self._step(np.maximum(first, 0), second), np.int32(-1))
        token = np.where(self.state >= 0, self.token[self.state], 0).astype(np.int32)
        begun = np.repeat(self.single, 256)
        self.best, self.size = np.where(token > 0, token, begun), np.where(token > 0, 2, begun > 0).astype(np.int32)

    def longest(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the longest token that begins there (0 if there is none) and its length; ``left`` bytes are in its text."""
        pair = data << 8
        pair[:-1] |= data[1:]
        token, length, state = self.best[pair], self.size[pair], self.state[pair]
        last = np.flatnonzero(left == 1)
        token[last] = self.single[data[last]]
        length[last] = token[last] > 0
        place = np.flatnonzero((state >= 0) & (left > 2)).astype(np.int32)
        state, depth = state[place], 2
        while len(place):
            state = self._step(state, data[place + depth])
            depth += 1
            alive = np.flatnonzero(state >= 0)
            place, state = place[alive], state[alive]
            found = self.token[state]
            ends = np.flatnonzero(found)
            token[place[ends]], length[place[ends]] = found[ends], depth
            going = np.flatnonzero(left[place] > depth)
            if len(going) < len(place):
                place, state = place[going], state[going]
        return token, length

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text's begin. ``offsets``: of the texts' bytes, from 0 on."""
        n = len(data)
        if not n:
            return np.empty(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        data = data.astype(np.int32)
        left = (np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)).astype(np.int32)
        token, length = self.longest(data, left)
        begins = chain(np.arange(n, dtype=np.int32) + np.maximum(length, 1))
        ids = token[begins]
        if not ids.all():
            at = int(begins[np.flatnonzero(ids == 0)[0]])
            text = int(np.searchsorted(offsets, at, "right")) - 1
            raise NoToken(int(data[at]), text, at - int(offsets[text]))
        return ids, np.searchsorted(begins, offsets)


def chain(following: np.ndarray) -> np.ndarray:
    """The places that are met from 0 on by going from each to its ``following`` one, which is later; n is the end."""
    n = len(following)
    width = max(16, int(n**0.5))
    blocks = -(-n // width)
    padded = np.concatenate([following, np.full(blocks * width - n, blocks * width, dtype=following.dtype)])
    # rows are places in a block, columns are blocks: one step is one row
    to = np.ascontiguousarray(padded.reshape(blocks, width).T)
    out = to.copy()  # where the chain leaves the block that a place is in, from the last place on
    block = np.arange(blocks)
    begin, flat_out = block * width, out.reshape(-1)
    for step in range(width - 2, -1, -1):
        inside = to[step] - begin
        at = np.flatnonzero(inside < width)
        out[step, at] = flat_out[inside[at] * blocks + at]
    entry = np.full(blocks, n, dtype=np.int64)
    place = 0
    while place < n:
        entry[place // width] = place
        place = int(out[place % width, place // width])
    met = np.zeros(n, dtype=bool)
    at, last = entry, np.minimum(begin + width, n)
    while True:
        ok = np.flatnonzero(at < last)
        at, last = at[ok], last[ok]
        if not len(at):
            return np.flatnonzero(met)
        met[at] = True
        at = following[at]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column one after another, where each value begins and the last ends, and which are null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64), column.is_null().to_numpy(zero_copy_only=False)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], column.is_null().to_numpy(zero_copy_only=False)


def lists(ids: np.ndarray, starts: np.ndarray, nulls: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32), mask=np.append(nulls, False)), pa.array(ids, pa.int32()))


def encode_column(trie: Trie, column: pa.Array) -> pa.Array:
    """The ids of each text of a binary column; null for null."""
    data, offsets, nulls = flat(column)
    return lists(*trie.encode(data, offsets), nulls)
