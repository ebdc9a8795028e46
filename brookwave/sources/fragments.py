"""Fragmented files of boxes: recognised, written, and resolved to samples.

A fragment's base, clock and sequence depend on the fragments before it, so a file is walked serially
in one Arrow pass, files in parallel; samples leave in batches, and a fault is an error row and the end.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import pairwise, repeat

from pyspark.sql import DataFrame

from brookwave.sources.boxes_write import FEW_UNITS, box, full_box, movie
from brookwave.sources.configs import parsed
from brookwave.sources.media import CONTAINERS, _arrow, _exploded, boxes_of
from brookwave.sources.movies import tracks_of

SAMPLES = "path string, fragment int, sample int, off long, size long, dts long, dur long, error string"
#: Flags of a fragment header and of a run.
OWN_BASE, OWN_DESCRIPTION, OWN_DURATION, OWN_SIZE, EMPTY, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x10000, 0x20000
OFFSET, FIRST_FLAGS, DURATIONS, SIZES, FLAGS, COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
#: Bytes of an index up to which what it says is remembered.
LONGEST_HELD = 1 << 14
ENCRYPTED = {"saiz", "saio", "senc"}


class Fault(Exception):
    """What a fragmented file can't be resolved for."""


def is_fragmented(data: bytes) -> bool:
    """Whether a fragment, or an index that announces fragments, comes before the first fault.

    An index that the bytes cut short counts if the box that announces fragments is in them.
    """
    inside = None
    for at, size, head, kind, depth, parent, fault in boxes_of(data, deepest=1):
        if depth == 0:
            if kind == "moof" and not fault:
                return True
            inside = at if kind == "moov" else None
            if fault:
                return inside is not None and fault == "truncated" and any(x[3] == "mvex" and x[4] == 0 for x in boxes_of(data[at + head :], deepest=0))
        elif depth == 1 and parent == inside and kind == "mvex" and size >= 8:
            return True
    return False


def _optional(body: bytes, at: int, flags: int, fields: Iterable[tuple[int, str]]) -> tuple[list, int]:
    """The values of the fields whose flag is set, null for others, and where they end."""
    out = []
    for flag, form in fields:
        if flags & flag:
            out.append(struct.unpack_from(form, body, at)[0])
            at += struct.calcsize(form)
        else:
            out.append(None)
    return out, at


def fragment_header(body: bytes) -> dict:
    """track, base, description, duration, size (null where the flag is off), empty, from_moof."""
    flags, track = struct.unpack_from(">II", body)
    (base, description, duration, size), _ = _optional(body, 8, flags, [(OWN_BASE, ">Q"), (OWN_DESCRIPTION, ">I"), (OWN_DURATION, ">I"), (OWN_SIZE, ">I")])
    return {"track": track, "base": base, "description": description, "duration": duration, "size": size, "empty": bool(flags & EMPTY), "from_moof": bool(flags & FROM_MOOF)}


def decode_time(body: bytes) -> int:
    """A fragment's first time in either version."""
    if body[0] > 1:
        raise Fault("decode time")
    return struct.unpack_from(">Q" if body[0] else ">I", body, 4)[0]


def run(body: bytes) -> tuple[int | None, Iterator[tuple]]:
    """(offset of the data or null, (duration, size) of each sample, null where not given)."""
    if body[0] > 1:
        raise Fault("run")
    flags, count = struct.unpack_from(">II", body)
    (offset, _), at = _optional(body, 8, flags, [(OFFSET, ">i"), (FIRST_FLAGS, ">I")])

    given = [f for f in (DURATIONS, SIZES, FLAGS, COMPOSITION) if flags & f]
    duration, size, shift = (given.index(f) if f in given else None for f in (DURATIONS, SIZES, COMPOSITION))

    def samples():
        if not given:
            yield from repeat((None, None), count)
            return
        whole = min(count, (len(body) - at) // (4 * len(given)))
        for x in struct.iter_unpack(f">{len(given)}I", body[at : at + 4 * len(given) * whole]):
            if shift is not None and x[shift]:
                raise Fault("composition offset")
            yield None if duration is None else x[duration], None if size is None else x[size]
        if whole < count:
            raise struct.error("run")

    return offset, samples()


def init_of(data: bytes) -> dict:
    """Of the first index: the track's config, clocks and edit, its id, and default duration and size."""
    index = next(((at, size) for at, size, _, kind, depth, _, fault in boxes_of(data, deepest=0) if kind == "moov" and not fault), None)
    if index is None:
        raise Fault("no index")
    moov = data[index[0] : index[0] + index[1]]
    return dict(_init_of(moov) if len(moov) <= LONGEST_HELD else _init_of.__wrapped__(moov))


@lru_cache(256)
def _init_of(moov: bytes) -> dict:
    """Fragmented files of one encoder often have the same index."""
    ids, defaults = {}, {}
    place = -1
    for at, size, head, kind, _, _, fault in boxes_of(moov):
        body = moov[at + head : at + size]
        if fault:
            raise Fault(fault)
        if kind == "trak":
            place += 1
        elif kind == "tkhd":
            ids[place] = struct.unpack_from(">I", body, 20 if body[0] == 1 else 12)[0]
        elif kind == "trex":
            track, _, duration, length = struct.unpack_from(">IIII", body, 4)
            defaults.setdefault(track, (duration, length))
    usable = [t for t in tracks_of("", moov) if t["handler"] == "soun" and t["config"] is not None and t["track"] in ids]
    if len(usable) != 1:
        raise Fault("number of audio tracks")
    t = usable[0]
    if t["error"]:
        raise Fault(t["error"])
    duration, length = defaults.get(ids[t["track"]], (0, 0))
    return t | {"id": ids[t["track"]], "default_duration": duration, "default_size": length}


class Shape:
    """A fragment of one run whose samples give their sizes alone: all its bytes but number, base, time and sizes, and what they say."""

    def __init__(self, whole: bytes, places: list[tuple[str, int, int]]) -> None:
        """``places``: (kind, start, end) of the boxes in it; ValueError if it is no such fragment."""
        at = {kind: (a, b) for kind, a, b in places}
        if sorted(x[0] for x in places) != ["mfhd", "tfdt", "tfhd", "traf", "trun"]:
            raise ValueError("shape")
        header, times, runs = (whole[slice(*at[k])] for k in ("tfhd", "tfdt", "trun"))
        self.head = fragment_header(header)
        flags, self.n = struct.unpack_from(">II", runs)
        own, wide = self.head["base"] is not None, times[0] == 1
        if times[0] > 1 or len(times) != (12 if wide else 8) or not self.n or flags != OFFSET | SIZES or len(runs) != 12 + 4 * self.n or at["mfhd"][1] - at["mfhd"][0] != 8:
            raise ValueError("shape")
        self.offset = struct.unpack_from(">i", runs, 8)[0]
        fields = [(at["mfhd"][0] + 4, "I", 4), *([(at["tfhd"][0] + 8, "Q", 8)] if own else []), (at["tfdt"][0] + 4, "Q" if wide else "I", 8 if wide else 4), (at["trun"][0] + 12, f"{self.n}I", 4 * self.n)]
        layout, done = ">", 0
        for start, form, length in fields:
            if start < done:
                raise ValueError("shape")
            layout, done = f"{layout}{start - done}s{form}", start + length
        if done != len(whole):
            raise ValueError("shape")
        self.form, self.own = struct.Struct(layout), own
        self.fixed = self._fixed(self.form.unpack(whole))

    def _fixed(self, x: tuple) -> tuple:
        return (x[0], x[2], x[4], x[6]) if self.own else (x[0], x[2], x[4])

    def read(self, data: bytes, at: int) -> tuple | None:
        """(number, base or null, time, sizes) of a fragment of this shape."""
        x = self.form.unpack_from(data, at)
        if self._fixed(x) != self.fixed:
            return None
        return (x[1], x[3], x[5], x[7:]) if self.own else (x[1], None, x[3], x[5:])


class Layouts:
    """Where the boxes in a box lie, remembered by its size and the headers of all of them, on which alone that depends."""

    def __init__(self, most: int = 256, of_size: int = 4) -> None:
        self.most, self.of_size, self.n, self.known, self.shapes = most, of_size, 0, {}, {}

    def shaped(self, data: bytes, at: int, size: int) -> tuple[Shape, tuple] | None:
        for shape in self.shapes.get(size, ()):
            if read := shape.read(data, at):
                return shape, read
        return None

    def inside(self, data: bytes, at: int, size: int) -> list[tuple[str, bytes]] | None:
        """(kind, bytes) of each box in the one at a place; null if one is at fault."""
        for form, heads, places in self.known.get(size, ()):
            if form.unpack_from(data, at) == heads:
                return [(kind, data[at + a : at + b]) for kind, a, b in places]
        whole = data[at : at + size]
        found = list(boxes_of(whole))
        if any(x[6] for x in found):
            return None
        if size <= LONGEST_HELD and all(x[2] == 8 and whole[x[0] : x[0] + 4] != bytes(4) for x in found):
            if self.n >= self.most:
                self.n, self.known, self.shapes = 0, {}, {}
            if len(forms := self.known.setdefault(size, [])) < self.of_size:
                form = struct.Struct(">" + "".join(f"{b[0] - a[0] - 8}x8s" for a, b in pairwise([(-8,), *found])))
                forms.append((form, form.unpack_from(whole), [(x[3], x[0] + 8, x[0] + x[1]) for x in found[1:]]))
                self.n += 1
            if len(shapes := self.shapes.setdefault(size, [])) < self.of_size:
                with suppress(ValueError, struct.error, IndexError):
                    shapes.append(Shape(whole, [(x[3], x[0] + 8, x[0] + x[1]) for x in found[1:]]))
        return [(x[3], whole[x[0] + x[2] : x[0] + x[1]]) for x in found[1:]]


_LAYOUTS = Layouts()


def _fragments(data: bytes, top: list[tuple], index: int) -> Iterator[tuple[int, int, list[tuple[str, bytes]] | None, tuple[Shape, tuple] | None]]:
    """(position, end, boxes in it with their bytes, or the shape that it has) of each fragment. ``index``: the place of the index, whose boxes have no fault."""
    held = None
    for at, size, _, kind, _, _, fault in top:
        if fault:
            raise Fault(fault)
        if held:
            yield held
        held = None
        if at != index and kind.encode("latin-1") in CONTAINERS:
            if kind == "moof" and (shaped := _LAYOUTS.shaped(data, at, size)):
                held = (at, at + size, None, shaped)
                continue
            if (parts := _LAYOUTS.inside(data, at, size)) is None:
                raise Fault(next(x[6] for x in boxes_of(data[at : at + size]) if x[6]))
            held = (at, at + size, parts, None) if kind == "moof" else None
    if held:
        yield held


class Resolver:
    """What is known before a fragment: the index's facts, the clock, where data ended, the last number, fragments so far.

    A base is the fragment's own, else its position if it says so, else where the data before ended, else its position.
    """

    def __init__(self, init: dict, clock: int = 0, ended: int | None = None, last: int | None = None, done: int = 0) -> None:
        self.init, self.clock, self.ended, self.last, self.done, self.sample = init, clock, ended, last, done, 0

    def state(self) -> tuple:
        return self.clock, self.ended, self.last, self.done

    def _header(self, parts: list[tuple[str, bytes]]) -> dict:
        kinds = [x for x, _ in parts]
        if kinds.count("traf") != 1 or "tfhd" not in kinds:
            raise Fault("track fragments")
        if ENCRYPTED & set(kinds):
            raise Fault("encrypted")
        for number in (struct.unpack_from(">I", body, 4)[0] for kind, body in parts if kind == "mfhd"):
            if self.last is not None and number != (self.last + 1) % (1 << 32):
                raise Fault("sequence")
            self.last = number
        head = fragment_header(next(b for x, b in reversed(parts) if x == "tfhd"))
        if head["track"] != self.init["id"]:
            raise Fault("another track")
        if head["description"] not in (None, 1):
            raise Fault("sample description")
        for kind, body in parts:
            self.clock = decode_time(body) if kind == "tfdt" else self.clock
        return head

    def quick(self, position: int, shape: Shape, read: tuple, media: tuple[int, int] | None) -> list[tuple] | None:
        """Samples of a fragment of a known shape; null, and nothing done, if there can be a fault: samples() tells it."""
        number, base, clock, sizes = read
        head = shape.head
        duration = self.init["default_duration"] if head["duration"] is None else head["duration"]
        if self.last is not None and number != (self.last + 1) % (1 << 32) or head["track"] != self.init["id"] or head["description"] not in (None, 1) or not (duration or head["empty"]):
            return None
        at = shape.offset + (base if base is not None else position if head["from_moof"] or self.ended is None else self.ended)
        if media is None or at < media[0] or at + sum(sizes) > media[1]:
            return None
        done, out = self.done, []
        for k, size in enumerate(sizes):
            out.append((done, k, at, size, clock, duration, None))
            at, clock = at + size, clock + duration
        self.clock, self.ended, self.last, self.done, self.sample = clock, at, number, done + 1, len(sizes)
        return out

    def samples(self, position: int, parts: list[tuple[str, bytes]], media: tuple[int, int] | None) -> Iterator[tuple]:
        """Samples of a fragment at a position, which must lie in the media behind it."""
        self.sample = 0
        head = self._header(parts)
        base = head["base"] if head["base"] is not None else position if head["from_moof"] or self.ended is None else self.ended
        duration = self.init["default_duration"] if head["duration"] is None else head["duration"]
        length = self.init["default_size"] if head["size"] is None else head["size"]
        at = None
        for body in (b for x, b in parts if x == "trun"):
            offset, samples = run(body)
            for place, (own_duration, own_size) in enumerate(samples):
                if place == 0 and (offset is not None or at is None):
                    at = base + (offset or 0)
                d, s = duration if own_duration is None else own_duration, length if own_size is None else own_size
                if not d and not head["empty"]:
                    raise Fault("duration")
                if media is None or at < media[0] or at + s > media[1]:
                    raise Fault("outside the media")
                yield self.done, self.sample, at, s, self.clock, d, None
                at, self.clock, self.sample = at + s, self.clock + d, self.sample + 1
            at = base if at is None else at
        self.ended = self.ended if at is None else at
        self.done += 1


def samples_of(data: bytes) -> Iterator[tuple]:
    """(fragment, sample, offset, size, dts, duration, error) of each sample; a sample lies in the media box behind its fragment."""
    walk = None
    try:
        walk = Resolver(init_of(data))
        top = list(boxes_of(data, deepest=0))
        media = [(at + head, at + size) for at, size, head, kind, *_ in top if kind == "mdat"]
        behind = 0
        for position, end, parts, shaped in _fragments(data, top, next(x[0] for x in top if x[3] == "moov" and not x[6])):
            while behind < len(media) and media[behind][0] < end:
                behind += 1
            holds = media[behind] if behind < len(media) else None
            if shaped and (rows := walk.quick(position, *shaped, holds)) is not None:
                yield from rows
                continue
            yield from walk.samples(position, _LAYOUTS.inside(data, position, end - position) if parts is None else parts, holds)
        if not walk.done:
            raise Fault("no fragments")
    except (Fault, struct.error, IndexError, ValueError) as e:
        yield (walk.done if walk else 0), (walk.sample if walk else 0), None, None, None, None, str(e) if isinstance(e, Fault) else "too short"


def fragment_samples(files: DataFrame) -> DataFrame:
    """One row per sample of (path, content) rows of fragmented files. Null contents have no index."""
    return files.select("path", "content").mapInArrow(_exploded(samples_of, _arrow(SAMPLES)), SAMPLES)


def init_bytes(config: bytes, duration: int = 0, size: int = 0) -> bytes:
    """Brand and an index without samples that announces fragments of track 1."""
    facts = parsed(config)
    rate = facts["output_rate"]
    moov = movie([], 0, config, facts["channels"], rate, facts["frame"] * rate // facts["rate"], 0, 0)
    return box(b"ftyp", b"iso6\0\0\0\0iso6mp41") + box(b"moov", moov[8:], box(b"mvex", full_box(b"trex", 0, 0, struct.pack(">IIIII", 1, 1, duration, size, 0))))


def fragment_bytes(units: list[bytes], number: int, position: int, time: int, duration: int | None, own_base: bool) -> bytes:
    """One fragment and its media; without a duration the index's default holds. ``position``: where it begins in its file."""
    layout, (a, b, c, d) = (_form if len(units) <= FEW_UNITS else _form.__wrapped__)(len(units), duration, own_base)
    sizes, data = [*map(len, units)], b"".join(units)
    head = layout.pack(a, number, b, position, c, time, d, *sizes, 8 + len(data), b"mdat") if own_base else layout.pack(a, number, b, c, time, d, *sizes, 8 + len(data), b"mdat")
    return head + data


@lru_cache(1024)
def _form(n: int, duration: int | None, own_base: bool) -> tuple[struct.Struct, tuple[bytes, ...]]:
    """The layout of a fragment of n units, and its bytes around number, position, time and sizes."""
    whole = _fragment(n, duration, own_base)
    time = len(whole) - 4 * n - 20 - 8
    a, b, c, d = whole[:20], whole[24:48], whole[56 if own_base else 48 : time], whole[time + 8 : time + 28]
    return struct.Struct(f">{len(a)}sI{len(b)}s{'Q' if own_base else ''}{len(c)}sQ{len(d)}s{n}II4s"), (a, b, c, d)


def _fragment(n: int, duration: int | None, own_base: bool) -> bytes:
    """A fragment of n units without its media; number, position, time and sizes are 0."""
    number = position = time = 0
    fields = (struct.pack(">Q", position) if own_base else b"") + (b"" if duration is None else struct.pack(">I", duration))
    flags = (OWN_BASE if own_base else FROM_MOOF) | (0 if duration is None else OWN_DURATION)
    head = full_box(b"tfhd", 0, flags, struct.pack(">I", 1), fields) + full_box(b"tfdt", 1, 0, struct.pack(">Q", time))
    sizes = bytes(4 * n)
    about = full_box(b"mfhd", 0, 0, struct.pack(">I", number))
    length = 8 + len(about) + 8 + len(head) + 20 + len(sizes)
    runs = full_box(b"trun", 0, OFFSET | SIZES, struct.pack(">Ii", n, length + 8), sizes)
    return box(b"moof", about, box(b"traf", head, runs))
