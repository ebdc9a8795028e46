"""Files of boxes as tables: tracks, their sample tables, edits and configurations, and access units.

``tracks`` reads the index of each file once and gives one row per track with its run-length tables
as arrays; places of units follow from a track's tables in one more pass over its row, without a shuffle
(operators/timeline.py has the same as window sums on flat tables), and units are substrings of the file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookwave.sources.media import CONTAINERS, MOST_HELD, MOST_ROWS, boxes_of, contents

TRACK = (
    "path string, track int, handler string, timescale long, duration long, movie_timescale long, config binary, edit_start long, edit_duration long, edits int, "
    "stts array<struct<count:long,delta:long>>, stsc array<struct<first:long,per:long>>, sizes array<long>, size_of_all long, n_sizes long, chunks array<long>, error string, usable boolean"
)
NAMES = [x.split(" ")[0] for x in TRACK.split(", ")]
UNITS = "path string, track int, au_idx long, offset long, size long"
MOST_DESCRIPTORS = 16
#: Bytes of an index up to which what it says is remembered, and layouts of indices of one length.
LONGEST_HELD, MOST_FORMS = 1 << 14, 4
#: Boxes of a track that are read.
READ = {"hdlr", "mdhd", "elst", "stts", "stsc", "stco", "co64", "stsz", "stsd"}


def varint_at(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position): seven bits a byte, four bytes at most."""
    value = 0
    for k in range(4):
        if at + k >= len(data):
            raise ValueError("descriptor")
        value = value << 7 | data[at + k] & 0x7F
        if not data[at + k] & 0x80:
            return value, at + k + 1
    raise ValueError("descriptor")


def audio_config(data: bytes) -> bytes | None:
    """The configuration inside a descriptor tree (3 holds 4 holds 5)."""
    return next((data[at : at + size] for tag, at, size in _descriptors(data) if tag == 5), None)


def _descriptors(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(tag, start, size) of each descriptor on the way to a configuration."""
    at = 0
    for _ in range(MOST_DESCRIPTORS):
        if at >= len(data):
            return
        tag = data[at]
        size, at = varint_at(data, at + 1)
        if at + size > len(data):
            raise ValueError("descriptor")
        yield tag, at, size
        if tag == 3:
            flags = data[at + 2]
            at += 3 + 2 * bool(flags & 0x80) + 2 * bool(flags & 0x20)
            if flags & 0x40:
                at += 1 + data[at]
        elif tag == 4:
            at += 13
        else:
            at += size


def _table(body: bytes, width: int, head: int = 4) -> list[tuple]:
    """Rows of ``width`` 32-bit numbers, as many as the box says and has."""
    n = struct.unpack_from(">I", body, head)[0]
    if head + 4 + n * 4 * width > len(body):
        raise ValueError("table longer than its box")
    flat = struct.unpack_from(f">{n * width}I", body, head + 4)
    return [flat[k : k + width] for k in range(0, len(flat), width)]


def _clock(body: bytes) -> tuple[int, int]:
    """(timescale, duration) of a header in either version."""
    return struct.unpack_from(">IQ", body, 20) if body[0] == 1 else struct.unpack_from(">II", body, 12)


def _read(kind: str, body: bytes, t: dict) -> None:
    if kind == "hdlr":
        t["handler"] = body[8:12].decode("latin-1")
    elif kind == "mdhd":
        t["timescale"], t["duration"] = _clock(body)
    elif kind == "elst":
        n, wide = struct.unpack_from(">I", body, 4)[0], body[0] == 1
        t["edits"] = n
        if n:
            t["edit_duration"], t["edit_start"] = struct.unpack_from(">Qq" if wide else ">Ii", body, 8)
            if n > 1 or t["edit_start"] < 0 or struct.unpack_from(">hh", body, 24 if wide else 16) != (1, 0):
                raise ValueError("edit list")
    elif kind == "stts":
        t["stts"] = _table(body, 2)
    elif kind == "stsc":
        t["stsc"] = [x[:2] for x in _table(body, 3)]
    elif kind == "stco":
        t["chunks"] = [x[0] for x in _table(body, 1)]
    elif kind == "co64":
        t["chunks"] = [a << 32 | b for a, b in _table(body, 2)]
    elif kind == "stsz":
        t["size_of_all"], t["n_sizes"] = struct.unpack_from(">II", body, 4)
        t["sizes"] = [] if t["size_of_all"] else [x[0] for x in _table(body, 1, 8)]
    elif kind == "stsd":
        at = body.find(b"esds", 8)
        if body[12:16] == b"mp4a" and at > 0:
            t["config"] = audio_config(body[at + 8 : at - 4 + struct.unpack_from(">I", body, at - 4)[0]])


def tracks_of(path: str, data: bytes) -> Iterator[dict]:
    """A dictionary of TRACK per track; what is wrong with a track is in its ``error``."""
    movie, t, n, bound = None, None, 0, 0
    for at, size, head, kind, _, _, fault in boxes_of(data):
        if t and at >= bound:
            yield t
            t = None
        if kind == "mvhd" and not fault:
            movie = _clock(data[at + head : at + size])[0]
        if kind == "trak":
            t = dict.fromkeys(NAMES) | {"path": path, "track": n, "movie_timescale": movie, "edits": 0}
            n, bound = n + 1, at + size
        elif t and kind in READ and not t["error"]:
            try:
                _read(kind, data[at + head : at + size], t)
            except (ValueError, struct.error, IndexError) as e:
                t["error"] = str(e) if type(e) is ValueError else f"{kind} too short"
    if t:
        yield t


class Remembered:
    """What was said of bytes, for others that differ from them only in places that it doesn't depend on."""

    def __init__(self, most: int = 1024) -> None:
        self.most, self.n, self.forms = most, 0, {}

    def of(self, data: bytes):
        for form, said in self.forms.get(len(data), {}).items():
            if (found := said.get(form.unpack(data))) is not None:
                return found
        return None

    def add(self, data: bytes, places: list[tuple[int, int]], said) -> None:
        """``places``: (start, length) of what ``said`` doesn't depend on, in order."""
        if len(data) > LONGEST_HELD:
            return
        if self.n >= self.most:
            self.n, self.forms = 0, {}
        at, layout = 0, ">"
        for start, length in places:
            layout, at = f"{layout}{start - at}s{length}x", start + length
        forms = self.forms.setdefault(len(data), {})
        form = next((f for f in forms if f.format == f"{layout}{len(data) - at}s"), None) or struct.Struct(f"{layout}{len(data) - at}s")
        if form in forms or len(forms) < MOST_FORMS:
            forms.setdefault(form, {})[form.unpack(data)] = said
            self.n += 1


def unread(index: bytes) -> list[tuple[int, int]]:
    """(start, length) of what no fact of an index but its tables of sizes depends on: entries of these, and rates beside configurations."""
    out = []
    for at, size, head, kind, _, _, fault in boxes_of(index):
        body, end = at + head, at + size
        if fault:
            continue
        if kind == "stsz" and end - body >= 12:
            of_all, n = struct.unpack_from(">II", index, body + 4)
            if n and not of_all and body + 12 + 4 * n <= end:
                out.append((body + 12, 4 * n))
        elif kind == "stsd" and (esds := index.find(b"esds", body + 8, end)) > 0:
            tree = index[esds + 8 : min(end, esds - 4 + struct.unpack_from(">I", index, esds - 4)[0])]
            try:
                out += [(esds + 8 + x + 5, 8) for tag, x, _ in _descriptors(tree) if tag == 4 and x + 13 <= len(tree)][:1]
            except (ValueError, IndexError):
                pass  # nothing of it is left out
    return sorted(out)


def tracks(files: DataFrame) -> DataFrame:
    """One row per track of (path, content) rows; ``usable``: the first sound track of its file that has a configuration and no fault."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    kinds |= {f"array<struct<{a}:long,{b}:long>>": pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for a, b in (("count", "delta"), ("first", "per"))}
    schema = [(n, kinds[k]) for n, k in re.findall(r"(\w+) (array<struct<.*?>>|[\w<>]+)", TRACK)]

    at_sizes = NAMES.index("sizes")

    def facts_of(content: bytes) -> list[tuple]:
        """(what a track's row says but its path and sizes, its sizes as bytes or null)."""
        index = _lone_index(content)
        if index and (said := _SEEN.of(index)):
            facts, at, length = said
            return [(facts, index[at : at + length])]
        found, out = False, []
        for t in tracks_of("", content):
            t["usable"] = not found and t["handler"] == "soun" and t["config"] is not None and not t["error"]
            found = found or t["usable"]
            for c, (a, b) in (("stts", ("count", "delta")), ("stsc", ("first", "per"))):
                t[c] = None if t[c] is None else [{a: x, b: y} for x, y in t[c]]
            sizes = None if t["sizes"] is None else struct.pack(f">{len(t['sizes'])}I", *t["sizes"])
            out.append((tuple(t[n] for n in NAMES if n not in ("path", "sizes")), sizes))
        if index and len(out) == 1 and t["sizes"] and not t["error"]:
            places = unread(index)
            tables = [x for x in places if index[x[0] - 16 : x[0] - 12] == b"stsz"]
            if len(tables) == 1 and index[tables[0][0] : sum(tables[0])] == out[0][1]:
                _SEEN.add(index, places, (out[0][0], *tables[0]))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        different = {id(r[1]): r[1] for r in rows}
        place = {k: n for n, k in enumerate(different)}
        which = pa.array([place[id(r[1])] for r in rows], pa.int64())
        columns = [pa.array(c, k).take(which) for c, (n, k) in zip(zip(*different.values(), strict=True), (x for x in schema if x[0] not in ("path", "sizes")), strict=True)]
        ends = np.cumsum([0, *(len(r[2] or b"") // 4 for r in rows)])
        values = np.frombuffer(b"".join(r[2] or b"" for r in rows), ">u4").astype(np.int64)
        sizes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([r[2] is None for r in rows]))
        columns.insert(at_sizes - 1, sizes)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *columns], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0  # of many small files, or of a large one
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), contents(b.column(1)), strict=True):
                rows += [(path, *x) for x in facts_of(content)]
                held += len(content)
                if rows and (len(rows) >= MOST_ROWS or held > MOST_HELD):
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.select("path", "content").mapInArrow(run, TRACK)


_SEEN = Remembered()


def _lone_index(data: bytes) -> bytes | None:
    """The index of a file, if what its tracks say can lie in nothing else."""
    index = None
    for at, size, _, kind, _, _, fault in boxes_of(data, deepest=0):
        if kind == "mvhd" or kind.encode("latin-1") in CONTAINERS:
            if fault or kind != "moov" or index:
                return None
            index = data[at : at + size]
    return index


def first_usable(found: DataFrame) -> DataFrame:
    """The first sound track of each file that has a configuration and no fault."""
    return found.where("usable")


def chunk_counts(found: DataFrame) -> DataFrame:
    """(path, track, chunk, offset, n): a run of the chunk table holds up to the next run's first chunk."""
    runs = F.filter(F.col("stsc"), lambda s: s["first"] <= F.col("chunk") + 1)
    rows = found.select("path", "track", "stsc", F.posexplode("chunks").alias("chunk", "offset"))
    return rows.select("path", "track", "chunk", "offset", F.element_at(runs, -1)["per"].alias("n"))


def _placed(chunks: list[int] | None, stsc: list[dict] | None, sizes: list[int] | None, size_of_all: int | None, n_sizes: int | None) -> Iterator[tuple]:
    """(au_idx, offset, size) of a track's units: a run of the chunk table holds up to the next run's first chunk."""
    sizes = repeat(size_of_all, n_sizes or 0) if size_of_all else iter(sizes or ())
    runs, run, n = stsc or [], 0, 0
    rising = all(x["first"] <= y["first"] for x, y in pairwise(runs))
    for chunk, at in enumerate(chunks or (), 1):
        if rising:
            while run < len(runs) and runs[run]["first"] <= chunk:
                run += 1
            per = runs[run - 1]["per"] if run else 0
        else:  # of faulty tables the last run that begins
            per = next((x["per"] for x in reversed(runs) if x["first"] <= chunk), 0)
        for size in islice(sizes, per):
            yield n, at, size
            n, at = n + 1, at + size


def units(found: DataFrame) -> DataFrame:
    """(path, track, au_idx, offset, size) of every access unit, in one pass over the tracks: a track's tables lie in its row."""
    schema = [("path", pa.string()), ("track", pa.int32()), ("au_idx", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), schema, strict=True)], names=[n for n, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path, track, *tables in zip(*b.columns, strict=True):
                path, track = path.as_py(), track.as_py()
                for x in _placed(*(t.as_py() for t in tables)):
                    rows.append((path, track, *x))
                    if len(rows) == MOST_ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return found.select("path", "track", "chunks", "stsc", "sizes", "size_of_all", "n_sizes").mapInArrow(run, UNITS)


def with_payloads(files: DataFrame, placed: DataFrame) -> DataFrame:
    """units with their bytes; null where a unit lies outside its file.

    The files' bytes meet their units as one array per file, so that a file is shuffled once and not once a unit.
    """
    lists = placed.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("track", "au_idx", "offset", "size"))).alias("units"))
    rows = files.select("path", "content").join(lists, "path").select("path", "content", F.explode("units").alias("u"))
    whole = F.col("u.offset") + F.col("u.size") <= F.length("content")
    return rows.select("path", "u.track", "u.au_idx", F.when(whole, F.substring("content", (F.col("u.offset") + 1).cast("int"), F.col("u.size").cast("int"))).alias("payload"))


def presented(found: DataFrame) -> DataFrame:
    """(path, track, coded, priming, valid): samples coded, before the edit, and in it.

    The edit's clock is the movie's; its samples are floored, and never more than are left.
    """
    coded = F.aggregate(F.coalesce("stts", F.array()), F.lit(0).cast("long"), lambda s, x: s + x["count"] * x["delta"])
    start = F.coalesce("edit_start", F.lit(0).cast("long"))
    length = F.floor(F.col("edit_duration").cast("decimal(20,0)") * F.col("timescale") / F.col("movie_timescale")).cast("long")
    rows = found.withColumn("coded", coded).withColumn("priming", F.least(start, F.col("coded")))
    left = F.col("coded") - F.col("priming")
    return rows.select("path", "track", "coded", "priming", F.when(F.coalesce(F.col("edit_duration"), F.lit(0)) > 0, F.least(length, left)).otherwise(left).alias("valid"))


def seek_target(seconds: Column, rate: Column, frame: int, warm_up: int = 1) -> Column:
    """The unit to start decoding from, so that the sample at ``seconds`` is whole."""
    return F.greatest(F.floor(seconds * rate / frame).cast("long") - warm_up, F.lit(0).cast("long"))
