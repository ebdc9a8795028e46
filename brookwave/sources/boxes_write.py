"""Access units to bytes: framed streams and files of boxes.

Files are made by one grouped Arrow pass per stream: a file is one value, and its index needs the
sizes of all its units in order. Streams in parallel; a stream over the size limit is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwave.sources.configs import built, parsed
from brookwave.sources.media import MOST_HELD, MOST_ROWS, flat

#: Limits of 32-bit offsets and of the number of units of a file.
MOST_BYTES, MOST_UNITS = (1 << 32) - 1, 1 << 20
#: Units of a file up to which the rest of its index is remembered.
FEW_UNITS = 1024
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def varint(n: int, width: int = 4) -> bytes:
    """Seven bits a byte, the high bit on all but the last."""
    return bytes((n >> 7 * k & 0x7F) | (0x80 if k else 0) for k in range(width - 1, -1, -1))


def descriptor(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return bytes([tag]) + varint(len(body)) + body


def decoder_config(config: bytes, peak: int, mean: int) -> bytes:
    """The descriptor tree that holds an audio configuration."""
    inner = descriptor(4, struct.pack(">BB", 0x40, 0x15), (6144).to_bytes(3, "big"), struct.pack(">II", peak, mean), descriptor(5, config))
    return descriptor(3, struct.pack(">HB", 0, 0), inner, descriptor(6, b"\x02"))


def movie(sizes: list[int], first: int, config: bytes, channels: int, rate: int, frame: int, priming: int, valid: int) -> bytes:
    """The index of a file: one track, one chunk per unit run, an edit that starts after the priming."""
    coded = len(sizes) * frame
    if priming < 0 or valid < 0 or priming + valid > coded:
        raise ValueError("more samples are presented than coded")
    mean = sum(sizes) * 8 * rate // coded if coded else 0
    peak = max(sizes, default=0) * 8 * rate // frame
    around = _index if len(sizes) <= FEW_UNITS else _index.__wrapped__
    head, middle, tail = around(len(sizes), first, config, channels, rate, frame, priming, valid)
    return b"".join((head, struct.pack(">II", peak, mean), middle, struct.pack(f">{len(sizes)}I", *sizes), tail))


@lru_cache(1024)
def _index(n: int, first: int, config: bytes, channels: int, rate: int, frame: int, priming: int, valid: int) -> tuple[bytes, bytes, bytes]:
    """An index around its rates and around its table of sizes: files of as many units share the rest."""
    coded = n * frame
    head = full_box(b"mvhd", 0, 0, struct.pack(">IIII", 0, 0, rate, valid), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    track = full_box(b"tkhd", 0, 7, struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, valid, 0, 0, 0x100, 0), MATRIX, bytes(8))
    edit = box(b"edts", full_box(b"elst", 0, 0, struct.pack(">IIiHH", 1, valid, priming, 1, 0)))
    media = full_box(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, rate, coded, 0x55C4, 0))
    handler = full_box(b"hdlr", 0, 0, struct.pack(">I4s12x", 0, b"soun"), b"\0")
    entry = box(b"mp4a", bytes(6), struct.pack(">H8xHHHHI", 1, channels, 16, 0, 0, min(rate, 0xFFFF) << 16), full_box(b"esds", 0, 0, decoder_config(config, 0, 0)))
    table = box(
        b"stbl", full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
        full_box(b"stts", 0, 0, struct.pack(">III", 1, n, frame) if n else struct.pack(">I", 0)),
        full_box(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, n, 1) if n else struct.pack(">I", 0)),
        full_box(b"stsz", 0, 0, struct.pack(">II", 0, n), bytes(4 * n)),
        full_box(b"stco", 0, 0, struct.pack(">II", 1, first) if n else struct.pack(">I", 0)),
    )
    reference = box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1)))
    information = box(b"minf", full_box(b"smhd", 0, 0, bytes(4)), reference, table)
    whole = box(b"moov", head, box(b"trak", track, edit, box(b"mdia", media, handler, information)))
    rates = whole.index(entry) + entry.index(b"esds") + 8 + len(decoder_config(config, 0, 0)) - len(descriptor(5, config)) - len(descriptor(6, b"\x02")) - 8
    table_at = whole.index(table) + table.rindex(b"stsz") + 16
    return whole[:rates], whole[rates + 8 : table_at], whole[table_at + 4 * n :]


#: Brand of a file of boxes.
BRAND = box(b"ftyp", b"M4A \0\0\2\0M4A mp42isom")


def m4a(units: Iterable[bytes], config: bytes, priming: int = 0, valid: int | None = None) -> bytes:
    """Brand, then media, then the index. The clock is that of the output: twice the core's with an extension."""
    units = list(units)
    facts = parsed(config)
    if facts is None or facts["error"]:
        raise ValueError("configuration")
    if len(units) > MOST_UNITS:
        raise ValueError("too many units")
    rate = facts["output_rate"]
    frame = facts["frame"] * rate // facts["rate"]
    brand = BRAND
    data = b"".join(units)
    if len(brand) + 8 + len(data) > MOST_BYTES:
        raise ValueError("file too long")
    valid = len(units) * frame - priming if valid is None else valid
    return brand + box(b"mdat", data) + movie([len(u) for u in units], len(brand) + 8, config, facts["channels"] * (2 if facts["ps"] and facts["channels"] == 1 else 1), rate, frame, priming, valid)


def payload_lists(units: DataFrame) -> DataFrame:
    """(stream_id, payloads): each stream's payloads in order of au_idx.

    Units that lie sorted by their stream, as behind a window, are put together as they come and not sorted twice more.
    """
    units.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    lists = units.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("au_idx", "payload"))).alias("units"))
    return lists.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("units.payload").alias("payloads"))


def bounds_of(lists: pa.Array) -> np.ndarray:
    """Where each list's values begin among all values, and where the last ends."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _in_batches(made: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of many small files, or of a large one: rows whose second value is the file."""
    rows, held = [], 0
    for row in made:
        rows.append(row)
        held += len(row[1] or b"")
        if len(rows) == MOST_ROWS or held > MOST_HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def files_of(units: DataFrame, build) -> DataFrame:
    """One row (path, content) per stream, built of the list of its payloads in order."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            data, ends = flat(b.column(1).flatten())
            ends, bounds = ends.tolist(), bounds_of(b.column(1)).tolist()
            for k, key in enumerate(b.column(0).to_pylist()):
                yield key, build([bytes(data[ends[i] : ends[i + 1]]) for i in range(bounds[k], bounds[k + 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(made(batches), ["path", "content"], [pa.string(), pa.binary()])

    return payload_lists(units).mapInArrow(run, "path string, content binary")


def _m4a_each(keys: list, lists: pa.Array, config: bytes, priming: int) -> Iterator[tuple]:
    """(key, content, error) of each list of units: m4a(), with the numbers of all lists of a batch computed together."""
    facts = parsed(config)
    data, ends = flat(lists.flatten())
    bounds, sizes = bounds_of(lists), np.diff(ends)
    starts, n = ends[bounds], np.diff(bounds)
    total = np.diff(starts)
    # what is beyond a limit, at fault or too long to remember goes the plain way, which says what is wrong
    plain, peak, mean = np.ones(len(n), bool), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    if facts is not None and not facts["error"]:
        rate = facts["output_rate"]
        frame = facts["frame"] * rate // facts["rate"]
        channels = facts["channels"] * (2 if facts["ps"] and facts["channels"] == 1 else 1)
        some = n > 0
        if some.any():
            peak[some] = np.maximum.reduceat(sizes, bounds[:-1][some]) * 8 * rate // frame
            mean[some] = total[some] * 8 * rate // (n[some] * frame)
        plain = (n == 0) | (n > FEW_UNITS) | (len(BRAND) + 8 + total > MOST_BYTES) | (priming < 0) | (priming > n * frame) | (peak > 0xFFFFFFFF)
    tables, rates, media = sizes.astype(">u4").tobytes(), np.stack([peak, mean], 1).astype(">u4").tobytes(), (8 + total).astype(">u4").tobytes()
    bounds, starts, n = bounds.tolist(), starts.tolist(), n.tolist()
    ends = ends.tolist() if plain.any() else None
    for k, (key, one) in enumerate(zip(keys, plain.tolist(), strict=True)):
        a, b = bounds[k], bounds[k + 1]
        if one:
            try:
                yield key, m4a((bytes(data[ends[i] : ends[i + 1]]) for i in range(a, b)), config, priming), None
            except ValueError as e:
                yield key, None, str(e)
            continue
        head, middle, tail = _index(n[k], len(BRAND) + 8, config, channels, rate, frame, priming, n[k] * frame - priming)
        yield key, b"".join((BRAND, media[4 * k : 4 * k + 4], b"mdat", data[starts[k] : starts[k + 1]], head, rates[8 * k : 8 * k + 8], middle, tables[4 * a : 4 * b], tail)), None


def m4a_files(units: DataFrame, core_rate: int, channels: int, object_type: int = 2, sbr: bool = False, priming: int = 0) -> DataFrame:
    """units: stream_id, au_idx, payload. One row (stream_id, content, error) per stream."""
    config = built(object_type, core_rate, channels, sbr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (row for b in batches for row in _m4a_each(b.column(0).to_pylist(), b.column(1), config, priming))
        return _in_batches(made, ["stream_id", "content", "error"], [pa.string(), pa.binary(), pa.string()])

    return payload_lists(units).mapInArrow(run, "stream_id string, content binary, error string")


def framed(header: Column, payload: Column) -> Column:
    """A unit behind its header."""
    return F.concat(header, payload)


def framed_streams(units: DataFrame, header: Column, payload: Column) -> DataFrame:
    """One row (stream_id, content, n) per stream: its framed units in order of au_idx, and how many they are.

    They are joined once, in a time that grows with their bytes; a null unit leaves no content.
    """
    units.sparkSession.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")  # as for payload_lists
    parts = units.select("stream_id", "au_idx", framed(header, payload).alias("unit"))
    content = F.when(F.count("unit") == F.count("*"), F.expr("listagg(unit) WITHIN GROUP (ORDER BY au_idx, unit)"))
    return parts.groupBy("stream_id").agg(content.alias("content"), F.count("*").alias("n"))
