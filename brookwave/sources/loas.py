"""The low-overhead stream: packets of a sync word, a multiplex configuration and access units.

A configuration holds until the next one (it is sticky), so a file is walked from its start; files
are walked in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from brookwave.sources.bitio import BitReader, BitWriter, Truncated, crc8_bits
from brookwave.sources.configs import read_config
from brookwave.sources.media import _arrow, _exploded

UNITS = "path string, packet int, sub_frame int, off long, mux_len int, use_same int, config binary, payload binary, error string"
SYNC = 0x2B7
#: Bits of a multiplex configuration up to which it is remembered, different lengths of these, and how many of a length.
LONGEST_HELD, MOST_LENGTHS, MOST_SEEN = 512, 4, 256


class Mux:
    """What a multiplex configuration says: one program, one layer."""

    def __init__(self, config: bytes, kind: int, fixed: int, sub_frames: int, other_bits: int, checked: bool | None) -> None:
        self.config, self.kind, self.fixed, self.sub_frames, self.other_bits, self.checked = config, kind, fixed, sub_frames, other_bits, checked


def sized(r: BitReader) -> int:
    """A number in as many bytes as its first two bits say, plus one."""
    return r.read(8 * (r.read(2) + 1))


def mux_config(r: BitReader) -> Mux:
    began = r.at
    version = r.read(1)
    if version and r.read(1):
        raise ValueError("version")
    if version:
        sized(r)  # buffer fullness
    if not r.read(1):
        raise ValueError("time framing")
    sub_frames = r.read(6)
    if r.read(4) or r.read(3):
        raise ValueError("programs")
    end = sized(r) + r.at if version else None
    start, probe = r.at, BitReader(r.data, r.at, end if end is not None else r.end)
    read_config(probe, {}, trailing=version == 1)  # version 0 gives no length: an extension would run into what follows
    if end is None:
        r.at = probe.at
    else:
        r.skip(end - r.at)
    n = r.at - start
    config = BitWriter().write(BitReader(r.data, start).read(n), n).bytes()
    kind, fixed = r.read(3), 0
    if kind == 0:
        r.skip(8)
    elif kind == 1:
        fixed = r.read(9)
    else:
        raise ValueError("length type")
    other = 0
    if r.read(1):
        if version:
            other = sized(r)
        else:
            while True:
                more = r.read(1)
                other = other << 8 | r.read(8)
                if not more:
                    break
    checked = None
    if r.read(1):
        n = r.at - began
        checked = crc8_bits(BitReader(r.data, began).read(n), n) == r.read(8)
        if not checked:
            raise ValueError("checksum")
    return Mux(config, kind, fixed, sub_frames, other, checked)


_SEEN: dict[int, dict[int, Mux]] = {}


def _remembered(r: BitReader) -> Mux:
    """mux_config, which depends on nothing but the bits that it takes: those seen before aren't parsed again."""
    for n, seen in _SEEN.items():
        if r.left >= n and (mux := seen.get(r.peek(n))):
            r.at += n
            return mux
    began = r.at
    mux = mux_config(r)
    n = r.at - began
    if n <= LONGEST_HELD and (n in _SEEN or len(_SEEN) < MOST_LENGTHS) and len(seen := _SEEN.setdefault(n, {})) < MOST_SEEN:
        seen[BitReader(r.data, began).peek(n)] = mux
    return mux


def payload_length(r: BitReader, mux: Mux) -> int:
    """In bits."""
    if mux.kind == 1:
        return 8 * (mux.fixed + 20)
    n = 0
    while True:
        part = r.read(8)
        n += part
        if part < 255:
            return 8 * n


def units_of(data: bytes) -> Iterator[tuple]:
    """(packet, sub-frame, offset, length, same, configuration, payload, error) of each access unit.

    Lost sync moves on by a byte; a faulty packet is an error row and the walk goes on behind it, a
    unit before the first configuration is an error row; a partial tail is dropped.
    """
    at, n, mux = 0, 0, None
    while at + 3 <= len(data):
        head = int.from_bytes(data[at : at + 3], "big")
        if head >> 13 != SYNC:
            at = data.find(b"\x56", at + 1)
            if at < 0:
                return
            continue
        size = head & 0x1FFF
        if at + 3 + size > len(data):
            return
        r = BitReader(data, 8 * (at + 3), 8 * (at + 3 + size))
        same, k = None, 0
        try:
            same = r.read(1)
            if not same:
                mux = _remembered(r)
            if mux is None:
                raise ValueError("no configuration")
            for k in range(mux.sub_frames + 1):
                bits = payload_length(r, mux)
                yield n, k, at, size, same, mux.config, r.take(bits // 8), None
            r.skip(mux.other_bits)
        except Truncated:
            yield n, k, at, size, same, None, None, "truncated"
        except ValueError as e:
            yield n, k, at, size, same, None, None, str(e)
        at, n = at + 3 + size, n + 1


def packet(config: bytes, config_bits: int, units: list[bytes]) -> bytes:
    """One packet with its configuration: length type 0, with as many sub-frames as units (1 to 64)."""
    if not 1 <= len(units) <= 64:
        raise ValueError("a packet holds 1 to 64 units")
    w = BitWriter().write(*_head(config, config_bits, len(units)))
    body = w.put(b"".join(x for u in units for x in (b"\xff" * (len(u) // 255), bytes((len(u) % 255,)), u))).bytes()
    if len(body) > 0x1FFF:
        raise ValueError("packet too long")
    return (SYNC << 13 | len(body)).to_bytes(3, "big") + body


@lru_cache(1024)
def _head(config: bytes, config_bits: int, n: int) -> tuple[int, int]:
    """The bits of a packet before the lengths of its units, and how many they are."""
    w = BitWriter().write(0, 1).write(0, 1).write(1, 1).write(n - 1, 6).write(0, 4).write(0, 3)
    w.write(int.from_bytes(config, "big") >> (8 * len(config) - config_bits), config_bits)
    w.write(0, 3).write(0xFF, 8).write(0, 1).write(0, 1)
    return w.value, w.n


def loas_units(files: DataFrame) -> DataFrame:
    """One row per access unit of (path, content) rows."""
    return files.select("path", "content").mapInArrow(_exploded(units_of, _arrow(UNITS)), UNITS)
