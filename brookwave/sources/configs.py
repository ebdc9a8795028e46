"""Audio specific configurations: parsed to a struct, and built.

A configuration is one short binary column (a few bytes a file), so both directions are Arrow UDFs
over bytes; results are columns like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brookwave.sources.bitio import BitReader, BitWriter, Truncated
from brookwave.sources.media import RATES

CONFIG = "object_type int, rate int, channels int, frame int, sbr boolean, ps boolean, output_rate int, elements int, error string"
#: Object types.
LC, SBR, LD, PS = 2, 5, 23, 29
#: Bytes of a configuration up to which what it says is remembered.
LONGEST_HELD = 64
#: Channels by channel configuration; None: given by an element list.
CHANNELS = (None, 1, 2, 3, 4, 5, 6, 8)


def object_type(r: BitReader) -> int:
    kind = r.read(5)
    return 32 + r.read(6) if kind == 31 else kind


def rate(r: BitReader) -> int:
    index = r.read(4)
    if index == 15:
        return r.read(24)
    if index >= len(RATES):
        raise ValueError("rate index")
    return RATES[index]


def element_list(r: BitReader) -> tuple[int, int]:
    """A program config element: (channels, elements). Pairs count twice, coupling elements not at all."""
    r.skip(4 + 2 + 4)
    front, side, back, lfe, data, coupling = r.read(4), r.read(4), r.read(4), r.read(2), r.read(3), r.read(4)
    for present in (4, 4, 3):  # mono, stereo and matrix mix-down
        if r.read(1):
            r.skip(present)
    channels = 0
    for _ in range(front + side + back):
        channels += 1 + r.read(1)
        r.skip(4)
    r.skip(4 * lfe + 4 * data + 5 * coupling)
    r.align()
    r.skip(8 * r.read(8))
    return channels + lfe, front + side + back + lfe


def parsed(data: bytes | None) -> dict | None:
    """The struct of a configuration; what it can't be read for is named in ``error``. Null: null."""
    if data is None:
        return None
    return dict(_parsed(data) if len(data) <= LONGEST_HELD else _parsed.__wrapped__(data))


@lru_cache(1024)
def _parsed(data: bytes) -> dict:
    """Files of one encoder have the same few bytes."""
    out = dict.fromkeys((x.split()[0] for x in CONFIG.split(", ")), None)
    try:
        read_config(BitReader(data), out)
    except Truncated:
        out["error"] = "truncated"
    except ValueError as e:
        out["error"] = str(e)
    return out


def read_config(r: BitReader, out: dict, trailing: bool = True) -> None:
    """Fills out; ``trailing``: whether what follows the core's own fields can be its extension."""
    kind, core, index = object_type(r), rate(r), r.read(4)
    sbr, ps, wide = kind in (SBR, PS), kind == PS, core
    if sbr:
        wide, kind = rate(r), object_type(r)
        if wide not in (core, 2 * core):
            raise ValueError("output rate")
    out.update(object_type=kind, rate=core, sbr=sbr, ps=ps, output_rate=wide)
    if kind not in (1, 2, 3, 4, LD):
        raise ValueError("object type")
    short = r.read(1)
    out["frame"] = (480 if short else 512) if kind == LD else (960 if short else 1024)
    if r.read(1):  # depends on a core coder
        r.skip(14)
    extension = r.read(1)
    if index >= len(CHANNELS):
        raise ValueError("channel configuration")
    out["channels"], out["elements"] = (element_list(r)) if index == 0 else (CHANNELS[index], (0, 1, 1, 2, 3, 3, 4, 5)[index])
    if extension:
        if kind == LD:
            r.skip(3)
        r.skip(1)
    # an extension may follow after the core's own configuration
    if trailing and not sbr and r.left >= 16 and r.peek(11) == 0x2B7:
        r.skip(11)
        if object_type(r) == SBR and r.left and r.read(1):
            wide = rate(r)
            if wide not in (core, 2 * core):
                raise ValueError("output rate")
            out.update(sbr=True, output_rate=wide)
            if r.left >= 12 and r.peek(11) == 0x548:
                r.skip(11)
                out["ps"] = bool(r.read(1))


def built(object_kind: int, core_rate: int, channels: int, sbr: bool = False, ps: bool = False) -> bytes:
    """2 bytes for a plain core; 4 with the extension named first."""
    index = CHANNELS.index(channels)
    w = BitWriter()
    if ps or sbr:
        w.write(PS if ps else SBR, 5).write(RATES.index(core_rate), 4).write(index, 4).write(RATES.index(2 * core_rate), 4)
        return w.write(object_kind, 5).write(0, 3).bytes()
    return w.write(object_kind, 5).write(RATES.index(core_rate), 4).write(index, 4).write(0, 3).bytes()


def configuration(data: Column) -> Column:
    """The struct CONFIG of a binary column."""
    schema = StructType.fromDDL(CONFIG)
    kinds = {"integer": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    arrow = pa.struct([(f.name, kinds[f.dataType.typeName()]) for f in schema])

    @F.arrow_udf(CONFIG)
    def parse(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            yield pa.array([parsed(x) for x in c.to_pylist()], arrow)

    return parse(data)
