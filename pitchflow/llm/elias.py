"""Elias-Fano sequences and the files of arrays that hold them, read in place by memory mapping.

A sequence of n growing integers below u keeps the lowest log2(u / n) bits of each packed, and the rest as one bit vector: a
one for each integer, a zero for each step of the upper part. A count of ones for every 64 bits makes select cheap. All
calls take and give whole numpy arrays.
"""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_64 = np.uint64(64)
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_1, _2, _4, _8, _56 = (np.uint64(k) for k in (1, 2, 4, 8, 56))
_PAIRS, _FOURS, _BYTES, _BYTE = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0xFF))
_IN_BYTE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[n] for b in range(256)] for n in range(8)], np.int64).ravel()


def _nth_one(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Position of the n-th (from 0) one of each 64-bit word: counts of ones up to each byte in one multiplication, then a
    table for the byte."""
    n = n.astype(np.uint64)
    ones = word - (word >> _1 & _PAIRS)
    ones = (ones & _FOURS) + (ones >> _2 & _FOURS)
    upto = (ones + (ones >> _4) & _BYTES) * _ONES
    at = np.bitwise_count((n * _ONES | _TOPS) - upto & _TOPS).astype(np.uint64) * _8
    at = np.minimum(at, _56)
    before = (upto << _8) >> at & _BYTE
    return at.astype(np.int64) + _IN_BYTE[((n - before) * np.uint64(256) + (word >> at & _BYTE)).astype(np.int64)]


class Sequence:
    """Growing integers (equal neighbours allowed), of ``values`` or of arrays made by ``arrays``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray, size: np.ndarray):
        self.low, self.high, self.rank = low, high, rank
        self.n, self.bits = int(size[0]), int(size[1])
        self.zeros = np.arange(len(rank)) * 64 - rank

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at // _64).astype(np.int64), at % _64
            part = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > _64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_64 - off[over]))
        upper = (values >> np.uint64(bits)).astype(np.int64)
        length = n + (top >> bits) + 1
        ones = np.zeros(-(-(length + 1) // 64) * 64, np.uint8)
        ones[upper + np.arange(n)] = 1
        high = np.packbits(ones, bitorder="little").view(np.uint64)
        rank = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=rank[1:])
        return cls(low, high, rank.astype(np.uint32) if n < 1 << 32 else rank, np.array([n, bits]))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.rank": self.rank, f"{name}.size": np.array([self.n, self.bits])}

    @classmethod
    def named(cls, arrays: dict[str, np.ndarray], name: str) -> Sequence:
        return cls(*(arrays[f"{name}.{k}"] for k in ("low", "high", "rank", "size")))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at // _64).astype(np.int64), at % _64
        rest = np.where(off > 0, self.low[word + 1] << ((_64 - off) % _64), np.uint64(0))
        return (self.low[word] >> off | rest) & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The i-th integers."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.rank, i, "right") - 1
        at = word * 64 + _nth_one(self.high[word], i - self.rank[word])
        return (at - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th integers and the ones after them."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.rank, i, "right") - 1
        off = _nth_one(self.high[word], i - self.rank[word]).astype(np.uint64)
        rest = self.high[word] >> off >> _1  # ones after it in this word
        after = word * 64 + off.astype(np.int64) + 1 + np.bitwise_count((rest & (~rest + _1)) - _1)
        far = np.flatnonzero(rest == 0)
        if len(far):
            beyond = np.searchsorted(self.rank, i[far] + 1, "right") - 1
            after[far] = beyond * 64 + _nth_one(self.high[beyond], i[far] + 1 - self.rank[beyond])
        bits = np.uint64(self.bits)
        one = (word * 64 + off.astype(np.int64) - i).astype(np.uint64) << bits | self._low(i)
        return one, (after - i - 1).astype(np.uint64) << bits | self._low(i + 1)

    def _group(self, h: np.ndarray) -> np.ndarray:
        """Place of the first integer whose upper part is at least h (h below the number of zeros): a select of the zero
        before its group."""
        zero = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, zero, "right") - 1
        return np.where(h > 0, word * 64 + _nth_one(~self.high[word], zero - self.zeros[word]) + 1 - h, 0)

    def _next_zero(self, at: np.ndarray) -> np.ndarray:
        """Position of the first zero at or after each position of the upper bits."""
        word, out = at >> 6, np.full(len(at), -1)
        free = ~self.high[word] >> (at & 63).astype(np.uint64)
        near = free != 0
        low = free[near]
        out[near] = at[near] + np.bitwise_count((low & (~low + _1)) - _1)
        far = np.flatnonzero(~near)  # not in this word
        if len(far):
            zero = self.zeros[word[far] + 1]
            beyond = np.searchsorted(self.zeros, zero, "right") - 1
            out[far] = beyond * 64 + _nth_one(~self.high[beyond], zero - self.zeros[beyond])
        return out

    def find(self, x: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Places of the integers ``x`` in a sequence of different ones, -1 where they are not (before place ``below``)."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1)
        upper = x >> np.uint64(self.bits)
        live = np.flatnonzero(upper < np.uint64(int(self.zeros[-1])))
        upper = upper[live].astype(np.int64)
        at = self._group(upper)
        end = self._next_zero(at + upper) - upper
        want = x[live] & np.uint64((1 << self.bits) - 1)
        on = np.flatnonzero(at < end)
        live, at, end, want = live[on], at[on], end[on] - 1, want[on]
        done: list[tuple] = []
        while len(live):  # halve each group; the last integer left is compared
            one = at == end
            done.append((live[one], at[one], want[one]))
            more = ~one
            live, at, end, want = live[more], at[more], end[more], want[more]
            middle = (at + end) >> 1
            left = self._low(middle) >= want
            at, end = np.where(left, at, middle + 1), np.where(left, middle, end)
        if done:
            live, at, want = (np.concatenate([d[k] for d in done]) for k in range(3))
            hit = self._low(at) == want
            out[live[hit]] = at[hit]
        return out if below is None else np.where(out < below, out, -1)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of a byte, what they stand for): at most 256 levels with as many values each, none above its value."""
    levels = np.unique(values)
    if len(levels) > 256:
        levels = np.unique(np.sort(values)[(np.arange(256) * len(values)) // 256])
    return (np.searchsorted(levels, values, "right") - 1).astype(np.uint8), levels


def write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write one file of arrays; the name it gets is new each time, so a task that runs again disturbs nothing."""
    store, path = fs.FileSystem.from_uri(folder)
    name, at, head = f"{name}-{uuid.uuid4().hex}", 0, {}
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    return name


def opened(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. A file of a store that cannot be mapped is fetched into a file without name
    first, which goes when it is no longer used."""
    store, path = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as own:
            with store.open_input_stream(f"{path}/{name}") as source:
                while part := source.read(1 << 24):
                    own.write(part)
            own.flush()
            data = np.memmap(own, np.uint8, "r")
    size = int.from_bytes(bytes(data[:8]), "little")
    head = json.loads(bytes(data[8 : 8 + size]))
    start = 8 + size
    return {k: np.asarray(data[start + at : start + at + n * np.dtype(t).itemsize].view(t)) for k, (t, n, at) in head.items()}
