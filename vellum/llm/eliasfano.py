"""Elias-Fano sequences and an n-gram trie made of them, in numpy.

A trie level holds the ids of its nodes, siblings in ascending order, and where the children of each node
begin on the next level. Pointers are monotone; ids become so by adding the last value before their sibling
range. Both are Elias-Fano sequences, read by random access without decoding. Values (8 bits a node) lie
beside them. A trie can be written to one file and mapped from it.

A node is found by successor search relative to its context: the least sibling, within the context's range,
that is not less than the wanted id.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    _SELECT[_byte, : len(_ones)] = _ones


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers."""

    def __init__(self, low_bits: int, length: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.low_bits, self.length, self.low, self.high, self.before = low_bits, length, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits >> 6) + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros((int(place[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        ones = _POP[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
        return cls(bits, n, low, high, np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32 if n < 1 << 32 else np.uint64))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.before]

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at some places."""
        index = np.asarray(index, np.int64)
        word = np.searchsorted(self.before, index, side="right") - 1
        left = index - self.before[word].astype(np.int64)
        octets = self.high[word].view(np.uint8).reshape(-1, 8)
        until = np.cumsum(_POP[octets], axis=1, dtype=np.uint8)
        octet = (until <= left[:, None]).sum(1)
        row = np.arange(len(index))
        left = left - np.where(octet > 0, until[row, octet - 1], 0)
        place = word * 64 + octet * 8 + _SELECT[octets[row, octet], left]
        value = (place - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = index.astype(np.uint64) * np.uint64(self.low_bits)
            first, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = self.low[first] >> shift
            over = np.flatnonzero(shift + np.uint64(self.low_bits) > np.uint64(64))
            part[over] |= self.low[first[over] + 1] << (np.uint64(64) - shift[over])
            value |= part & np.uint64((1 << self.low_bits) - 1)
        return value

    def successor(self, start: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The least place in [start, end) whose value is not less than the wanted one; ``end`` if there is none."""
        start, end = np.array(start, np.int64), np.array(end, np.int64)
        open_ = np.flatnonzero(start < end)
        while len(open_):
            middle = (start[open_] + end[open_]) >> 1
            less = self.access(middle) < wanted[open_]
            start[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[start[open_] < end[open_]]
        return start


class Trie:
    """n-grams up to a fixed order with a byte for each node."""

    def __init__(self, ids: list[EliasFano], pointers: list[EliasFano], values: list[np.ndarray]):
        self.ids, self.pointers, self.values = ids, pointers, values

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """``levels[k]``: the (k + 1)-grams as distinct rows of ids in lexicographic order, and their values. Every n-gram's prefixes must be there."""
        ids, pointers, values = [], [], []
        parents = None
        for rows, value in levels:
            last = rows[:, -1].astype(np.uint64)
            if parents is None:
                starts = np.array([0, len(rows)])
            else:
                new = np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(1)]) if len(rows) else np.zeros(0, bool)
                groups = rows[new, :-1]
                owner = _find_rows(parents, groups)
                count = np.zeros(len(parents), np.int64)
                count[owner] = np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]]))
                starts = np.concatenate([[0], np.cumsum(count)])
                pointers.append(EliasFano.of(starts))
            # ids ascend within siblings; adding the last of each range before makes the level monotone
            ends = starts[1:][np.diff(starts) > 0]
            tops = last[ends - 1]
            base = np.concatenate([[np.uint64(0)], np.cumsum(tops, dtype=np.uint64)[:-1]]) if len(tops) else tops
            ids.append(EliasFano.of(last + np.repeat(base, np.diff(np.concatenate([[0], ends])))))
            values.append(np.asarray(value, np.uint8))
            parents = rows
        return cls(ids, pointers, values)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The node of each n-gram (rows of ids, all of one order), -1 where there is none."""
        n = len(grams)
        start, end = np.zeros(n, np.int64), np.full(n, self.ids[0].length, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(grams.shape[1]):
            base = np.zeros(n, np.uint64)
            inner = (start > 0) & (start < end)
            base[inner] = self.ids[level].access(start[inner] - 1)
            wanted = base + grams[:, level].astype(np.uint64)
            node = self.ids[level].successor(start, end, wanted)
            hit = np.flatnonzero(node < end)
            hit = hit[self.ids[level].access(node[hit]) == wanted[hit]]
            found = np.full(n, -1, np.int64)
            found[hit] = node[hit]
            start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if level + 1 < grams.shape[1]:
                start[hit], end[hit] = self.pointers[level].access(found[hit]).astype(np.int64), self.pointers[level].access(found[hit] + 1).astype(np.int64)
            node = found
        return node

    def tobytes(self) -> bytes:
        """The trie as one binary: the number of levels, each sequence's low bits and length, the size of each array, and the arrays, at multiples of 8."""
        parts = (*self.ids, *self.pointers)
        arrays = [a for part in parts for a in part.arrays()] + self.values
        head = np.array([len(self.ids), *(x for p in parts for x in (p.low_bits, p.length)), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64)
        whole = [np.array([len(head)], np.int64).tobytes(), head.tobytes()]
        for a in arrays:
            body = np.ascontiguousarray(a).tobytes()
            whole += [body, b"\0" * (-len(body) % 8)]
        return b"".join(whole)

    @classmethod
    def frombytes(cls, data: np.ndarray) -> Trie:
        """The trie in a uint8 array, which may be a mapped file; nothing is copied."""
        n = int(data[:8].view(np.int64)[0])
        head = data[8 : 8 + 8 * n].view(np.int64).tolist()
        levels, at = head[0], 8 + 8 * n
        parts = 2 * levels - 1
        shapes, sizes = head[1 : 1 + 2 * parts], head[1 + 2 * parts :]
        arrays = []
        for length, width in zip(sizes[::2], sizes[1::2], strict=True):
            arrays.append(data[at : at + length * width].view(f"u{width}"))
            at += length * width + -(length * width) % 8
        made = [EliasFano(shapes[2 * i], shapes[2 * i + 1], *arrays[3 * i : 3 * i + 3]) for i in range(parts)]
        return cls(made[:levels], made[levels:], arrays[3 * parts :])

    def mapped(self) -> Trie:
        """The same trie, read from a mapped file."""
        return map_trie(self.tobytes())

    def nbytes(self) -> int:
        return sum(a.nbytes for part in (*self.ids, *self.pointers) for a in part.arrays()) + sum(v.nbytes for v in self.values)


def map_trie(data: bytes) -> Trie:
    """The trie of a binary, read from a mapped file. The file has no name any more once this returns, so nothing is left behind."""
    handle, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
        whole = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)
    return Trie.frombytes(whole)


def _find_rows(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` rows in lexicographically sorted distinct ``rows``; all must be there."""
    kind = np.dtype([(f"f{i}", ">u8") for i in range(rows.shape[1])])
    as_keys = lambda a: np.ascontiguousarray(a.astype(">u8")).view(kind).ravel().view(f"V{8 * rows.shape[1]}")
    if rows.shape[1] == 1:
        at = np.searchsorted(rows[:, 0], wanted[:, 0])
    else:
        both = np.concatenate([rows, wanted])
        _, first = np.unique(as_keys(both), return_inverse=True)
        at = np.searchsorted(first[: len(rows)], first[len(rows) :])
    if len(wanted) and (at.max() >= len(rows) or (rows[at] != wanted).any()):
        raise ValueError("an n-gram without its prefix")
    return at
