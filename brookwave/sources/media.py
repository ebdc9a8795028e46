"""Media bytes as rows: sniffing as columns, frames and boxes by Arrow passes over whole files.

Framing is serial within a file and parallel over files. Size limits are filters on the metadata
column ``length``, so the bytes of a file over the limit are never read.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.functions.scalars import bits, word

#: Sampling rates by index.
RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
#: Rows of a batch, and bytes of the files that they come from.
MOST_ROWS, MOST_HELD = 4096, 8 << 20
#: Bytes of files whose frames are walked together, and files too few for that.
TOGETHER, FEW = 1 << 20, 32
#: Bytes before the payload by the bit of no check sum and the number of blocks; rates by all four bits.
_STARTS, _RATES = np.array([9, 11, 13, 15, 7, 7, 7, 7]), np.array(RATES + (0,) * 3)
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex", b"moof", b"traf", b"udta"}
_HEAD = struct.Struct(">I4s").unpack_from
FRAMES = "path string, au_idx int, off long, frame_len int, profile int, fs_index int, sample_rate int, ch_cfg int, n_rdb int, payload binary, error string"
TILES = "path string, frames long"
BOXES = "path string, pos long, size long, header_len int, type string, depth int, parent_pos long, error string"


def media_files(spark: SparkSession, path: str, most_bytes: int = 1 << 30) -> DataFrame:
    """path, length, content of files up to a size."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most_bytes)


def is_adts(content: Column) -> Column:
    w = word(content, 0, 7)
    return (F.length(content) >= 7) & (bits(w, 44, 12) == 0xFFF) & (bits(w, 41, 2) == 0) & (bits(w, 34, 4) != 15) & (bits(w, 13, 13) >= 7)


def is_latm(content: Column) -> Column:
    return (F.length(content) >= 3) & (bits(word(content, 0, 2), 5, 11) == 0x2B7)


def is_isobmff(content: Column) -> Column:
    return (F.length(content) >= 12) & (word(content, 0, 4) >= 8) & (F.hex(F.substring(content, 5, 4)) == "66747970") & F.hex(F.substring(content, 9, 4)).rlike("^([2-6][0-9A-F]|7[0-9A-E]){4}$")


def container(content: Column) -> Column:
    """adts, latm, isobmff or null, in the order of a probe."""
    return F.when(is_adts(content), "adts").when(is_latm(content), "latm").when(is_isobmff(content), "isobmff")


def frames_of(data: bytes, at: int = 0, n: int = 0) -> Iterator[tuple]:
    """(index, offset, header fields, payload, error) of each frame, from the n-th at ``at`` on.

    Lost sync moves on by a byte; any other fault of a header is an error row and the end; a partial
    tail is dropped.
    """
    while at + 7 <= len(data):
        w = int.from_bytes(data[at : at + 7], "big")
        if w >> 44 != 0xFFF:
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return
            continue
        size, rdb, bare = w >> 13 & 0x1FFF, (w & 3) + 1, w >> 40 & 1
        start = 7 if bare else 9 if rdb == 1 else 7 + 2 * rdb
        fault = "layer" if w >> 41 & 3 else "rate index" if (w >> 34 & 15) >= 13 else "length" if size < start else None
        if fault:
            yield n, at, size, w >> 38 & 3, w >> 34 & 15, None, w >> 30 & 7, rdb, None, fault
            return
        if at + size > len(data):
            return
        yield n, at, size, w >> 38 & 3, w >> 34 & 15, RATES[w >> 34 & 15], w >> 30 & 7, rdb, data[at + start : at + size], None
        at, n = at + size, n + 1


def tiles_of(data: bytes) -> Iterator[tuple]:
    """The number of frames, null if they don't tile the bytes: the one row of a file."""
    n = total = 0
    for _, _, size, *_, fault in frames_of(data):
        if not fault:
            n, total = n + 1, total + size
    yield (n if n and total == len(data) else None,)


def boxes_of(data: bytes, most_depth: int = 16, deepest: int | None = None) -> Iterator[tuple]:
    """(position, size, header length, type, depth, parent's position, error) of each box, parents first.

    ``deepest``: boxes below this depth are not asked for, and their parents not entered.
    """
    todo = [(0, len(data), 0, None)]
    while todo:
        at, end, depth, parent = todo.pop()
        if at + 8 > end:
            continue
        (size, kind), head = _HEAD(data, at), 8
        if size == 1:
            if at + 16 > end:
                yield at, 1, 8, kind.decode("latin-1"), depth, parent, "truncated"
                continue
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = end - at
        fault = "size" if size < head else "truncated" if at + size > end else "depth" if depth >= most_depth else None
        yield at, size, head, kind.decode("latin-1"), depth, parent, fault
        if fault:
            continue
        todo.append((at + size, end, depth, parent))
        if kind in CONTAINERS and (deepest is None or depth < deepest):
            todo.append((at + head, at + size, depth + 1, at))


def flat(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """(bytes of a binary column, where each value begins and the last ends); a null has no bytes."""
    values = values.fill_null(b"") if values.null_count else values
    wide = pa.types.is_large_binary(values.type)
    _, ends, data = values.buffers()
    if not len(values):
        return memoryview(b""), np.zeros(1, np.int64)
    return memoryview(data or b""), np.frombuffer(ends, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)


def contents(values: pa.Array) -> Iterator[bytes]:
    """Values of a binary column one by one, a null as none."""
    data, ends = flat(values)
    ends = ends.tolist()
    return (bytes(data[a:b]) for a, b in pairwise(ends))


def _exploded(rows_of, schema: list[tuple[str, pa.DataType]]):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], names=[x for x, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # of many small files, or of a piece of a large one
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), contents(b.column(1)), strict=True):
                for r in rows_of(content):
                    rows.append((path, *r))
                    if len(rows) == MOST_ROWS:
                        yield batch(rows)
                        rows, held = [], 0
                held += len(content)
                if rows and held > MOST_HELD:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))]


def _heads(data: bytes) -> np.ndarray:
    """The eight bytes from each byte on as a number; the seven of a header are its upper ones."""
    return np.ndarray(len(data), ">u8", data + bytes(8), strides=(1,))


def places_of(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """(rows of each file, place of each row in the data, fault of a file's last row) of files that lie behind each other.

    The rows are those of frames_of. A step takes the next frame of every file; a file that has lost its sync or has a
    fault, and the last few that go on, are left to frames_of.
    """
    heads, file, at, end, n = _heads(data), np.arange(len(ends) - 1), ends[:-1], ends[1:], 0
    found, left = [], []
    while True:
        whole = at + 7 <= end
        file, at, end = file[whole], at[whole], end[whole]
        if len(file) < FEW:
            left.append((file, at, n))
            break
        w = heads[at].astype(np.uint64).view(np.int64) >> 8 & 0xFFFFFFFFFFFFFF
        size = w >> 13 & 0x1FFF
        plain = (w >> 44 == 0xFFF) & (w >> 41 & 3 == 0) & ((w >> 34 & 15) < len(RATES)) & (size >= _STARTS[w >> 38 & 4 | w & 3])
        if not plain.all():
            left.append((file[~plain], at[~plain], n))
        whole = plain & (at + size <= end)
        file, at, end = file[whole], at[whole], end[whole]
        found.append((file, at, np.full(len(file), n)))
        at, n = at + size[whole], n + 1
    rest, faults = array("q"), {}
    for files, places, n in left:
        for k, place in zip(files.tolist(), places.tolist(), strict=True):
            begin = int(ends[k])
            for index, off, *_, fault in frames_of(data[begin : ends[k + 1]], place - begin, n):
                rest.extend((k, begin + off, index))
                if fault:
                    faults[k] = fault
    found.append(np.frombuffer(rest, np.int64).reshape(-1, 3).T)
    file, at, n = (np.concatenate(c) for c in zip(*found, strict=True))
    counts = np.bincount(file, minlength=len(ends) - 1)
    placed = np.empty(len(at), np.int64)
    placed[(np.cumsum(counts) - counts)[file] + n] = at
    return counts, placed, faults


def _frames_together(paths: pa.Array, data: bytes, ends: np.ndarray) -> pa.RecordBatch:
    counts, place, faults = places_of(data, ends)
    file, last = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    w = _heads(data)[place].astype(np.uint64).view(np.int64) >> 8 & 0xFFFFFFFFFFFFFF
    size, start, index = w >> 13 & 0x1FFF, _STARTS[w >> 38 & 4 | w & 3], w >> 34 & 15
    bad = np.zeros(len(w), bool)
    bad[[last[k] - 1 for k in faults]] = True
    held = np.concatenate([[0], np.cumsum(np.where(bad, 0, size - start))])
    picked = np.frombuffer(data, np.uint8)[np.repeat(place + start - held[:-1], np.diff(held)) + np.arange(held[-1])]
    payload = pa.Array.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(held.astype(np.int32)), pa.py_buffer(picked)])
    error = pa.nulls(len(w), pa.string())
    if faults:
        payload = pc.if_else(pa.array(~bad), payload, pa.scalar(None, pa.binary()))
        error = pa.array([faults[k] if b else None for k, b in zip(file.tolist(), bad.tolist(), strict=True)], pa.string())
    fields = (np.arange(len(w)) - (last - counts)[file], place - ends[file], size, w >> 38 & 3, index)
    columns = [paths.take(pa.array(file)), *fields, pa.array(_RATES[index], pa.int32(), mask=bad), w >> 30 & 7, (w & 3) + 1, payload, error]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype())) for c, (_, k) in zip(columns, _arrow(FRAMES), strict=True)], names=[x for x, _ in _arrow(FRAMES)])


def _tiles_together(paths: pa.Array, data: bytes, ends: np.ndarray) -> pa.RecordBatch:
    counts, place, faults = places_of(data, ends)
    file, last = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    size = (_heads(data)[place] >> 21 & 0x1FFF).astype(np.int64)
    size[[last[k] - 1 for k in faults]] = 0
    counts[list(faults)] -= 1
    tiled = (counts > 0) & (np.bincount(file, size, len(counts)) == np.diff(ends))
    return pa.RecordBatch.from_arrays([paths, pa.array(counts, pa.int64(), mask=~tiled)], names=["path", "frames"])


def _together(made, rows_of, ddl: str):
    """Files of a batch together, up to so many bytes; a few long ones each by itself."""
    alone = _exploded(rows_of, _arrow(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (data, ends), i = flat(b.column(1)), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + TOGETHER, "right")) - 1)
                if j - i < FEW:
                    yield from alone(iter([b.slice(i, j - i)]))
                else:
                    yield made(b.column(0).slice(i, j - i), bytes(data[ends[i] : ends[j]]), ends[i : j + 1] - ends[i])
                i = j

    return run


def adts_frames(files: DataFrame) -> DataFrame:
    """One row per frame of (path, content) rows."""
    return files.select("path", "content").mapInArrow(_together(_frames_together, frames_of, FRAMES), FRAMES)


def boxes(files: DataFrame, deepest: int | None = None) -> DataFrame:
    """One row per box of (path, content) rows, down to a depth (null: all)."""
    return files.select("path", "content").mapInArrow(_exploded(partial(boxes_of, deepest=deepest), _arrow(BOXES)), BOXES)


def exact_frames(files: DataFrame) -> DataFrame:
    """path and the number of frames, null if they don't tile the whole file."""
    return files.select("path", "content").mapInArrow(_together(_tiles_together, tiles_of, TILES), TILES)
