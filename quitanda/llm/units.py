"""Token ids of texts, unit by unit: each distinct unit of text is encoded once and then looked up.

Texts are taken as bytes. Unit borders are found for a whole stretch of text at once, units are hashed
all at once, and a hash table kept in arrays has the ids of every unit met before. An entry takes
about 50 bytes, so a worker remembers millions of units. Hashes have 64 bits and include the length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from quitanda.llm.common import span_hashes

UNITS = 1_500_000  # remembered at most
STRETCH = 1 << 20  # bytes looked at together; a text is cut only where units end anyway


class Store:
    """Hash -> ids of units; forgets everything when it has become too large."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None, limit: int = UNITS):
        self.learn, self.limit = learn, limit
        self.forget()

    def forget(self):
        self.count, self.bits = 0, 16
        self.keys, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry number of each hash, or -1."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.value[slot], -1)
        live = np.flatnonzero((key != h) & (key != 0))
        slot = slot[live]
        while len(live):
            slot = slot + 1 & (1 << self.bits) - 1
            key = self.keys[slot]
            hit = key == h[live]
            out[live[hit]] = self.value[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], slot[on]
        return out

    def _place(self, h: np.ndarray, value: np.ndarray):
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of several in one slot the last stays
            placed = self.keys[slot] == h
            self.value[slot[placed]] = value[placed]
            h, value, slot = h[~placed], value[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def add(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        """New entries, all different."""
        n = self.count + len(h)
        if 2 * n > 1 << self.bits:
            keys, values = self.keys[self.keys != 0], self.value[self.keys != 0]
            self.bits = (2 * n).bit_length() + 1
            self.keys, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(keys, values)
        end = self.start[self.count]
        ends = end + np.cumsum(counts)
        if n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(self.start), len(h)), np.int64)])
        if end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[end:end + len(ids)] = ids
        self.start[self.count + 1:n + 1] = ends
        self._place(h, np.arange(self.count, n, dtype=np.int32))
        self.count = n

    def ids(self, raw: bytes, first: np.ndarray, end: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids per unit, all ids) of the units ``raw[first:end]``."""
        if self.count > self.limit:
            self.forget()
        h = span_hashes(np.frombuffer(raw, np.uint8), first, end, lower)
        h[h == 0] = 1
        at = self.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one = np.unique(h[missing], return_index=True)
            one = missing[one]
            ids, counts = self.learn([raw[a:b] for a, b in zip(first[one].tolist(), end[one].tolist())])
            self.add(new, ids, counts)
            at[missing] = self.find(h[missing])
        begin = self.start[at]
        size = self.start[at + 1] - begin
        upto = np.cumsum(size)
        return size, self.flat[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def stretches(texts: list[bytes], border: re.Pattern) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts together up to STRETCH bytes: (their numbers, their bytes); a longer text comes in parts that
    begin where ``border`` matches."""
    who, held, size = [], [], 0
    for n, text in enumerate(texts):
        at = 0
        while len(text) - at > STRETCH:
            cut = border.search(text, at + STRETCH)
            if cut is None:
                break
            if held:
                yield who, held
                who, held, size = [], [], 0
            yield [n], [text[at:cut.start()]]
            at = cut.start()
        part = text[at:] if at else text
        if held and size + len(part) > STRETCH:
            yield who, held
            who, held, size = [], [], 0
        who.append(n)
        held.append(part)
        size += len(part)
    if held:
        yield who, held


class UnitEncoder:
    """Encodes texts by their units.

    ``units(data, bounds)`` gives the first byte and the end of every unit of texts that lie one after
    the other between ``bounds``; ``odd`` matches texts that are encoded whole by ``whole``.
    """

    def __init__(self, store: Store, units, whole: Callable[[str], list[int]], odd: re.Pattern, border: re.Pattern, lower: bool):
        self.store, self.units, self.whole, self.odd, self.border, self.lower = store, units, whole, odd, border, lower

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids per text, all ids)."""
        counts, parts = np.zeros(len(texts), np.int64), []
        alone = {n: np.array(self.whole(t.decode()), np.uint32) for n, t in enumerate(texts) if self.odd.search(t)}
        for who, held in stretches([b"" if n in alone else t for n, t in enumerate(texts)], self.border):
            raw = b"".join(held)
            bounds = np.cumsum([0, *map(len, held)])
            first, end = self.units(np.frombuffer(raw, np.uint8), bounds)
            size, ids = self.store.ids(raw, first, end, self.lower)
            upto = np.r_[0, np.cumsum(size)][np.searchsorted(first, bounds)]
            counts[who] += np.diff(upto)  # a number stands once in a stretch
            cut = [(n, k) for k, n in enumerate(who) if n in alone]
            at = 0
            for n, k in cut:
                parts += [ids[at:upto[k]], alone[n]]
                at = upto[k]
                counts[n] = len(alone[n])
            parts.append(ids[at:])
        return counts, np.concatenate(parts) if parts else np.zeros(0, np.uint32)
