"""Bits and checksums of one record: reading and writing most significant bit first, and CRCs.

For use inside Arrow passes, where a record's layout depends on its own bits; headers of a fixed
layout are columns (functions/scalars.py).
"""

from __future__ import annotations


class Truncated(ValueError):
    """A read past the end."""


class BitReader:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at = data, at
        self.end = 8 * len(data) if end is None else min(end, 8 * len(data))

    def peek(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.end:
            raise Truncated(f"{n} bits at {self.at} of {self.end}")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[first:last], "big")
        return word >> (8 * last - self.at - n) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.read(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def skip(self, n: int) -> None:
        if self.at + n > self.end:
            raise Truncated(f"skip of {n} bits at {self.at} of {self.end}")
        self.at += n

    def align(self) -> None:
        self.at = (self.at + 7) // 8 * 8

    def take(self, n: int) -> bytes:
        """n whole bytes from any bit on."""
        return self.read(8 * n).to_bytes(n, "big")

    @property
    def left(self) -> int:
        return self.end - self.at


class BitWriter:
    def __init__(self) -> None:
        self.value = self.n = 0

    def write(self, value: int, n: int) -> BitWriter:
        self.value, self.n = self.value << n | value & ((1 << n) - 1), self.n + n
        return self

    def put(self, data: bytes) -> BitWriter:
        return self.write(int.from_bytes(data, "big"), 8 * len(data))

    def bytes(self) -> bytes:
        """Padded with zero bits to a whole byte."""
        pad = -self.n % 8
        return (self.value << pad).to_bytes((self.n + pad) // 8, "big")


def crc(bits: int, n: int, polynomial: int, width: int, start: int) -> int:
    """Of the n low bits of ``bits``, first the highest; no reflection, no final mask."""
    top, mask, state = 1 << (width - 1), (1 << width) - 1, start
    for k in range(n - 1, -1, -1):
        carry = bool(state & top) ^ (bits >> k & 1)
        state = state << 1 & mask
        if carry:
            state ^= polynomial
    return state


def _table(polynomial: int, width: int) -> list[int]:
    return [crc(byte, 8, polynomial, width, 0) for byte in range(256)]


_BY_BYTE = {(0x8005, 16): _table(0x8005, 16), (0x07, 8): _table(0x07, 8)}


def crc_of(data: bytes, polynomial: int, width: int, start: int) -> int:
    """The same over whole bytes, by table."""
    if (table := _BY_BYTE.get((polynomial, width))) is None:
        table = _BY_BYTE[polynomial, width] = _table(polynomial, width)
    state, mask = start, (1 << width) - 1
    for b in data:
        state = (state << 8 & mask) ^ table[(state >> (width - 8) ^ b) & 0xFF]
    return state


def crc16(data: bytes) -> int:
    """Of protected frames: x^16 + x^15 + x^2 + 1, begun with ones."""
    return crc_of(data, 0x8005, 16, 0xFFFF)


def crc8_bits(bits: int, n: int) -> int:
    """Of a multiplex configuration: x^8 + x^2 + x + 1, begun with zeros."""
    return crc(bits, n, 0x07, 8, 0)
