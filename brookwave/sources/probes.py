"""What a file is, before any of it is decoded: container, profile, rates, channels, length and trim.

A probe reads a few headers of a file, so it is one Arrow pass with a row per file; what can't be said is an
error, not a lost row. Lengths and trims carry their certainty: exact or unknown.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from brookwave.sources.bitio import BitReader, Truncated
from brookwave.sources.configs import LC, LD, parsed
from brookwave.sources.fragments import Fault, init_of, is_fragmented
from brookwave.sources.loas import SYNC, mux_config
from brookwave.sources.media import RATES, _arrow, _exploded, boxes_of, frames_of
from brookwave.sources.movies import Remembered, tracks_of, unread

PROBE = "path string, container string, profile string, rate int, output_rate int, channels int, duration string, samples long, trim string, priming long, remainder long, error string"
FACTS = [x.split()[0] for x in PROBE.split(", ")[1:]]
#: Channels by channel configuration of a frame header; the comment's owner and name.
CHANNELS = (None, 1, 2, 3, 4, 5, 6, 8)
OWNER, NAME = b"com.apple.iTunes", b"iTunSMPB"


def delay_of(text: bytes) -> tuple[int, int, int] | None:
    """(priming, remainder, source) of a gapless comment: a zero, then fields of 8, 8 and 16 hexadecimal digits."""
    fields = re.split(rb"[ \t\n\x0c\r]+", text.split(b"\0")[0].strip(b" \t\n\x0c\r"))
    if len(fields) < 4 or not all(re.fullmatch(rb"[0-9A-Fa-f]{%d}" % n, x) for n, x in zip((8, 8, 8, 16), fields, strict=False)):
        return None
    zero, *delay = (int(x, 16) for x in fields[:4])
    return None if zero else tuple(delay)


def only(found: list):
    """The value of a lone comment; several, even unusable ones, say nothing."""
    return found[0] if len(found) == 1 else None


def comments_of_tag(body: bytes, major: int) -> Iterator[tuple | None]:
    """The value of each gapless comment among a tag's frames, null where it is unusable."""
    at = 0
    while at + 10 <= len(body):
        kind, raw, flags = body[at : at + 4], body[at + 4 : at + 8], body[at + 9]
        if major == 4 and max(raw) > 0x7F:
            raise Fault("tag")
        size = sum(b << 7 * k for k, b in enumerate(reversed(raw))) if major == 4 else int.from_bytes(raw, "big")
        at += 10
        if at + size > len(body):
            raise Fault("tag")
        frame, at = body[at : at + size], at + size
        text = {b"TXXX": frame[1:], b"COMM": frame[4:]}.get(kind)
        if flags or text is None or frame[:1] not in (b"\0", b"\x03"):
            continue
        name, ended, value = text.partition(b"\0")
        if ended and name == NAME:
            yield delay_of(value)


def leading_tag(data: bytes) -> tuple[str, int, tuple | None]:
    """(absent, need or ready; size with header and footer; the delay that its one comment gives)."""
    if not data or not b"ID3".startswith(data[:3]):
        return "absent", 0, None
    if len(data) < 10:
        return "need", 0, None
    major, flags, raw = data[3], data[5], data[6:10]
    if major not in (3, 4) or max(raw) > 0x7F:
        return "absent", 0, None
    body = sum(b << 7 * k for k, b in enumerate(reversed(raw)))
    total = 10 + body + (10 if major == 4 and flags & 0x10 else 0)
    if len(data) < total:
        return "need", 0, None
    try:
        delay = None if flags & 0xC0 else only(list(comments_of_tag(data[10 : 10 + body], major)))
    except Fault:
        delay = None
    return "ready", total, delay


def _inside(data: bytes, kind: str) -> Iterator[bytes]:
    """The contents of the boxes of a kind that lie directly in the bytes, up to the first fault."""
    for at, size, head, k, depth, _, fault in boxes_of(data, deepest=0):
        if fault:
            return
        if depth == 0 and k == kind:
            yield data[at + head : at + size]


def _item(data: bytes) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {"mean": [], "name": [], "data": []}
    for k, found in out.items():
        found += _inside(data, k)
    return out


def delay_of_index(moov: bytes) -> tuple[int, int, int] | None:
    """The delay that the one gapless item of an index (with its header) gives."""
    found = []
    for body in _inside(moov, "moov"):
        for meta in (m for u in _inside(body, "udta") for m in _inside(u, "meta") if m[:4] == bytes(4)):
            for item in (i for x in _inside(meta[4:], "ilst") for i in _inside(x, "----")):
                parts = _item(item)
                if not any(x[4:] == OWNER for x in parts["mean"]) or not any(x[4:] == NAME for x in parts["name"]):
                    continue
                sound = all(len(x) == 1 for x in parts.values()) and parts["mean"][0][:4] == parts["name"][0][:4] == bytes(4) and parts["data"][0][:4] == b"\0\0\0\1"
                found.append(delay_of(parts["data"][0][8:]) if sound else None)
    return only(found)


def converted(n: int, rate: int, clock: int) -> int:
    """Units of a clock as samples, which must come out whole."""
    if not clock or n * rate % clock:
        raise Fault("clock")
    return n * rate // clock


def shown(duration: int, rate: int, clock: int, available: int | None) -> int:
    """An edit's length in samples, floored; what is available if the excess is less than a tick and than a millisecond."""
    if not clock:
        raise Fault("clock")
    samples = duration * rate // clock
    excess = 0 if available is None else duration * rate - available * clock
    return available if available is not None and available < samples and excess * max(clock, 1000) < rate * clock else samples


def of_config(data: bytes) -> dict:
    """Profile, rates and channels of a configuration."""
    facts = parsed(data)
    if facts["error"]:
        raise Fault(facts["error"])
    profile = "he-aac-v2" if facts["ps"] else "he-aac" if facts["sbr"] else "ld" if facts["object_type"] == LD else "lc"
    return {"profile": profile, "rate": facts["rate"], "output_rate": facts["output_rate"], "channels": 2 if facts["ps"] else facts["channels"], "frame": facts["frame"] * facts["output_rate"] / facts["rate"]}


def _exact(samples: int, priming: int, remainder: int) -> dict:
    return {"duration": "exact", "samples": samples, "trim": "exact", "priming": priming, "remainder": remainder}


def _adts(data: bytes, delay: tuple | None) -> dict:
    kind, rate, mode = (data[2] >> 6) + 1, RATES[data[2] >> 2 & 15] if (data[2] >> 2 & 15) < len(RATES) else None, (data[2] & 1) << 2 | data[3] >> 6
    if kind != LC:
        raise Fault("object type")
    if rate is None:
        raise Fault("rate index")
    out = {"container": "adts", "profile": "lc", "rate": rate, "output_rate": rate, "channels": CHANNELS[mode]}
    if delay:
        frames = total = 0
        for _, _, size, *_, fault in frames_of(data):
            frames, total = frames + 1, total + (0 if fault else size)
        if frames and total == len(data) and sum(delay) in (1024 * frames, 2048 * frames):
            out |= _exact(delay[2], delay[0], delay[1])
    return out


def _latm(data: bytes) -> dict:
    size = int.from_bytes(data[:3], "big") & 0x1FFF
    if len(data) < 3 + size:
        raise Fault("need more")
    r = BitReader(data[3 : 3 + size])
    if r.read(1):
        raise Fault("no configuration")
    return {"container": "latm"} | of_config(mux_config(r).config)


_SEEN = Remembered()


def _movie(data: bytes) -> dict:
    """Of the index alone where it is the only box of its kind, no fault lies before it and fragments come behind one that announces them."""
    index = said = None
    for at, size, _, kind, _, _, fault in boxes_of(data, deepest=0):
        if kind in ("moof", "moov") and (fault or kind == "moof" or index):
            return _whole_movie(data)
        if fault:
            break
        if kind == "moov":
            index = data[at : at + size]
            said = _SEEN.of(index)
            if said[1] if said else is_fragmented(index):
                break
    if index is None:
        return _whole_movie(data)
    if said is None:
        said = _whole_movie(index), is_fragmented(index)
        _SEEN.add(index, unread(index), said)
    return said[0]


def _whole_movie(data: bytes) -> dict:
    if is_fragmented(data):
        t = init_of(data)
        out = {"container": "m4a"} | of_config(t["config"])
        if t["edits"]:
            out |= {"trim": "exact", "priming": converted(t["edit_start"], out["output_rate"], t["timescale"]), "remainder": 0}
            if t["edit_duration"]:
                out |= {"duration": "exact", "samples": shown(t["edit_duration"], out["output_rate"], t["movie_timescale"], None)}
        return out
    index = next((data[at : at + size] for at, size, _, kind, depth, _, fault in boxes_of(data, deepest=0) if kind == "moov" and not fault), None)
    if index is None:
        raise Fault("no index")
    t = next((t for t in tracks_of("", index) if t["handler"] == "soun" and t["config"] is not None and not t["error"]), None)
    if t is None:
        raise Fault("no audio track")
    out = {"container": "m4a"} | of_config(t["config"])
    rate, clock = out["output_rate"], t["timescale"]
    if t["edits"]:
        length = t["duration"]
        priming = converted(t["edit_start"], rate, clock)
        available = (length - t["edit_start"]) * rate // clock if length and t["edit_start"] <= length else None
        samples = shown(t["edit_duration"], rate, t["movie_timescale"], available)
        return out | _exact(samples, priming, max(available - samples, 0) if available is not None else 0)
    delay = delay_of_index(index)
    coded = sum(x[0] for x in t["stts"] or [])
    if delay and coded and sum(delay) == coded * out["frame"]:
        return out | _exact(delay[2], delay[0], delay[1])
    return out | ({"duration": "exact", "samples": converted(t["duration"], rate, clock)} if t["duration"] and clock else {})


def probed(data: bytes) -> Iterator[tuple]:
    """The one row of a file."""
    out: dict = {}
    try:
        kind, size, delay = leading_tag(data)
        if kind == "need" and len(data) >= 3:
            raise Fault("not audio")
        data = data[size:]
        if len(data) >= 7 and data[0] == 0xFF and data[1] & 0xF6 == 0xF0 and data[2] >> 2 & 15 != 15 and int.from_bytes(data[3:6], "big") >> 5 & 0x1FFF >= 7:
            out = _adts(data, delay)
        elif len(data) >= 3 and int.from_bytes(data[:2], "big") >> 5 == SYNC:
            out = _latm(data)
        elif len(data) >= 12 and data[4:8] == b"ftyp":
            out = _movie(data)
        else:
            raise Fault("not audio" if size or len(data) >= 8 else "need more")
    except Fault as e:
        out = {"error": str(e)}
    except (Truncated, ValueError, IndexError, struct.error) as e:
        out = {"error": str(e) or "truncated"}
    out = {"duration": "unknown", "trim": "unknown"} | out if "error" not in out else out
    yield tuple(map(out.get, FACTS))


def probes(files: DataFrame) -> DataFrame:
    """One row per file of (path, content) rows; null and empty contents need more bytes."""
    return files.select("path", "content").mapInArrow(_exploded(probed, _arrow(PROBE)), PROBE)
