"""Counting quotient filters that lose nothing, as numpy arrays.

A key of ``bits`` bits is put through an invertible permutation, so the permuted keys are spread
evenly whatever the keys are.  The high bits of a permuted key are its quotient, the rest is its
remainder.  The filter keeps the remainders in full, in the order of the permuted keys: quotient and
remainder give the permuted key back, and the inverse permutation the key.  So a counter belongs to
one key exactly, and two filters are merged like two sorted lists.

Stored form (``to_bytes``): for every quotient the length of its run in unary (about two bits a
key), the remainders in whole bytes, and a byte a count, 255 leading to a list of the large ones.
"""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
# odd multipliers of the rounds of the permutation
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Permutation:
    """An invertible permutation of the integers below ``2 ** bits`` (1 to 64 bits): a xor of the high half
    into the low half undoes itself, and a product with an odd number is undone by its inverse."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 64:
            raise ValueError(f"keys of {bits} bits: from 1 to 64 can be permuted")
        self.bits, self.shift, self.mask = bits, _U((bits + 1) // 2), _U(2**bits - 1)

    def _fold(self, x: np.ndarray) -> np.ndarray:
        return x ^ (x >> self.shift)

    def forward(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(_U)
        for m in _ODD:
            x = (self._fold(x) * _U(m)) & self.mask
        return self._fold(x)

    def backward(self, permuted: np.ndarray) -> np.ndarray:
        x = self._fold(permuted.astype(_U))
        for m in reversed(_ODD):
            x = self._fold((x * _U(pow(m, -1, 2**64))) & self.mask)
        return x


class Filter:
    """Sorted, different permuted keys of ``bits`` bits and their counts."""

    _HEAD = struct.Struct("<BBQ")

    def __init__(self, bits: int, keys: np.ndarray, counts: np.ndarray):
        self.bits, self.keys, self.counts = bits, keys, counts

    @classmethod
    def count(cls, bits: int, permuted: np.ndarray) -> Filter:
        keys, counts = np.unique(permuted, return_counts=True)
        return cls(bits, keys, counts.astype(_U))

    def __len__(self) -> int:
        return len(self.keys)

    def cut(self, part_bits: int):
        """The filter's slices by the first ``part_bits`` bits: ``(part, first position, slice)``; a slice
        leaves these bits out."""
        rest = _U(self.bits - part_bits)
        parts = self.keys >> rest if part_bits else np.zeros(len(self), _U)
        at = np.flatnonzero(np.diff(parts, prepend=_U(2**64 - 1)))
        for lo, hi in zip(at, [*at[1:], len(self)], strict=True):
            low = self.keys[lo:hi] & _U(2 ** int(rest) - 1)
            yield int(parts[lo]), int(lo), Filter(int(rest), low, self.counts[lo:hi])

    @staticmethod
    def merge(filters: list[Filter]) -> Filter:
        """One filter with the counts of all (sorted runs, which the stable sort merges)."""
        bits = filters[0].bits
        keys = np.concatenate([f.keys for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        return Filter(bits, keys[first], np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        n = len(self)
        # as many quotients as keys, about, and remainders of whole bytes
        quotient_bits = min(self.bits, max(1, n).bit_length())
        quotient_bits = max(0, self.bits - -(-(self.bits - quotient_bits) // 8) * 8)
        width = -(-(self.bits - quotient_bits) // 8)
        quotients = (self.keys >> _U(8 * width) if width < 8 else np.zeros(n, _U)).astype(np.int64)
        ones = np.zeros(n + 2**quotient_bits, np.uint8)
        ones[quotients + np.arange(n)] = 1
        remainders = self.keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        large = self.counts >= _U(255)
        return b"".join([self._HEAD.pack(self.bits, quotient_bits, n), np.packbits(ones).tobytes(), remainders.tobytes(),
                         np.minimum(self.counts, _U(255)).astype(np.uint8).tobytes(), self.counts[large].astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        bits, quotient_bits, n = cls._HEAD.unpack_from(data)
        at, width = cls._HEAD.size, -(-(bits - quotient_bits) // 8)
        size = -(-(n + 2**quotient_bits) // 8)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at)))
        at += size
        keys = np.zeros((n, 8), np.uint8)
        keys[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        keys = keys.reshape(-1).view("<u8").astype(_U)
        if width < 8:
            keys |= (ones - np.arange(n)).astype(_U) << _U(8 * width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(_U)
        large = np.frombuffer(data, "<u8", offset=at + n)
        counts[counts == 255] = large
        return cls(bits, keys, counts)
