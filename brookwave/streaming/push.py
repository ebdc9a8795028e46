"""Push framing: chunks of streams in, whole frames, packets or fragments' samples out, with a bounded buffer per stream.

Any way of cutting a stream into chunks gives the same rows. State is what no frame has used up
yet, at most ``most_bytes``; a stream that goes over it, or has a faulty header, emits an error row and ends.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brookwave.sources.fragments import Fault, Resolver, init_of
from brookwave.sources.loas import SYNC, units_of
from brookwave.sources.media import boxes_of, frames_of

OUT = "stream_id string, au_idx long, off long, frame_len int, error string"
STATE = "buffer binary, taken long, frames long, failed boolean"


def advanced(buffer: bytes, taken: int, frames: int, most_bytes: int) -> tuple[list[tuple], bytes, int, int, bool]:
    """Frames that are complete in the buffer, and what remains."""
    rows, at, failed = [], 0, False
    for n, off, size, *_, error in frames_of(buffer):
        rows.append((frames + n, taken + off, size, error))
        failed, at = failed or error is not None, off + size
    done = frames + len(rows) - failed
    if not failed and len(buffer) - at > most_bytes:
        rows.append((done, taken + at, 0, "buffer"))
        failed = True
    return rows, buffer[at:], taken + at, done, failed


def push_frames(chunks: DataFrame, most_bytes: int = 1 << 16) -> DataFrame:
    """chunks: stream_id, seq, chunk. A streaming DataFrame of frames."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, taken, frames, failed = state.get if state.exists else (b"", 0, 0, False)
        new = pd.concat(list(parts)).sort_values("seq")
        rows = []
        for chunk in [] if failed else new["chunk"]:
            more, buffer, taken, frames, failed = advanced(bytes(buffer) + bytes(chunk), taken, frames, most_bytes)
            rows += more
            if failed:
                break
        state.update((b"" if failed else bytes(buffer), taken, frames, failed))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["stream_id", "au_idx", "off", "frame_len", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


UNIT_OUT = "stream_id string, packet long, sub_frame int, off long, size int, error string"
SAMPLE_OUT = "stream_id string, fragment long, sample int, off long, size long, dts long, dur long, error string"
HELD = "held binary"


class Packets:
    """Packets of one stream. The last packet with a configuration is kept, as the configuration holds for those behind it."""

    def __init__(self, most_bytes: int) -> None:
        self.most, self.buffer, self.primer, self.taken, self.packets, self.failed = most_bytes, b"", b"", 0, 0, False

    def push(self, chunk: bytes) -> Iterator[tuple]:
        """(packet, sub-frame, offset, size, error) of what the chunk completes."""
        if self.failed:
            return
        self.buffer += chunk
        end, primer = self._whole(), self.primer
        shift, first = self.taken - len(primer), self.packets - bool(primer)
        for n, k, at, size, same, _, payload, error in units_of(primer + self.buffer[:end]):
            if at < len(primer):
                continue
            if same == 0 and error is None:
                self.primer = (primer + self.buffer)[at : at + 3 + size]
            self.packets = first + n + 1
            yield first + n, k, shift + at, None if payload is None else len(payload), error
        self.taken, self.buffer = self.taken + end, self.buffer[end:]
        if len(self.buffer) > self.most:
            self.failed, self.buffer = True, b""
            yield self.packets, None, self.taken, None, "buffer"

    def _whole(self) -> int:
        """Bytes up to the first packet that is not complete; without sync all but what could begin one."""
        at, data = 0, self.buffer
        while at + 3 <= len(data):
            head = int.from_bytes(data[at : at + 3], "big")
            if head >> 13 != SYNC:
                at += 1
            elif at + 3 + (head & 0x1FFF) > len(data):
                break
            else:
                at += 3 + (head & 0x1FFF)
        return at

    def finish(self) -> Iterator[tuple]:
        """A begun packet at the end of the stream is an error."""
        if self.buffer and not self.failed:
            yield self.packets, None, self.taken, None, "truncated"


class Fragments:
    """Samples of one fragmented stream, emitted as the media of their fragment is complete. Needs its index first."""

    def __init__(self, most_bytes: int) -> None:
        self.most, self.buffer, self.taken, self.init, self.moof, self.known, self.failed = most_bytes, b"", 0, None, None, (0, None, None, 0), False

    def push(self, chunk: bytes) -> Iterator[tuple]:
        """(fragment, sample, offset, size, dts, duration, error) of what the chunk completes."""
        if self.failed:
            return
        self.buffer += chunk
        walk = None
        try:
            while len(self.buffer) >= 8:
                size, head = struct.unpack_from(">I", self.buffer)[0], 8
                if size == 1:
                    if len(self.buffer) < 16:
                        break
                    size, head = struct.unpack_from(">Q", self.buffer, 8)[0], 16
                if size < head:
                    raise Fault("size")
                if len(self.buffer) < size:
                    break
                kind, whole = self.buffer[4:8], self.buffer[:size]
                if kind == b"moov" and self.init is None:
                    self.init = init_of(whole)
                elif kind == b"moof":
                    if self.init is None:
                        raise Fault("no index")
                    self.moof = self.taken, [(k, whole[at + h : at + s]) for at, s, h, k, depth, _, _ in boxes_of(whole) if depth]
                elif kind == b"mdat" and self.moof:
                    walk = Resolver(self.init, *self.known)
                    yield from walk.samples(*self.moof, (self.taken + head, self.taken + size))
                    self.known, self.moof = walk.state(), None
                self.buffer, self.taken = self.buffer[size:], self.taken + size
            if len(self.buffer) > self.most:
                raise Fault("buffer")
        except (Fault, struct.error, IndexError, ValueError) as e:
            self.failed, self.buffer = True, b""
            yield walk.done if walk else self.known[3], walk.sample if walk else 0, None, None, None, None, str(e) if isinstance(e, Fault) else "too short"

    def finish(self) -> Iterator[tuple]:
        """A begun box, a fragment without media, or a stream without an index is an error at the end."""
        fault = "truncated" if self.buffer or self.moof else "no index" if self.init is None else None
        if fault and not self.failed:
            yield self.known[3], 0, None, None, None, None, fault


def _pushed(chunks: DataFrame, reader, schema: str) -> DataFrame:
    """Chunks through a reader per stream. The reader is the state, so a restart goes on where the checkpoint is."""
    names = [x.split()[0] for x in schema.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(bytes(state.get[0])) if state.exists else reader()
        rows = []
        for chunk in pd.concat(list(parts)).sort_values("seq")["chunk"]:
            rows += held.finish() if chunk is None else held.push(bytes(chunk))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=names).astype(object)

    return chunks.groupBy("stream_id").applyInPandasWithState(step, schema, HELD, "append", GroupStateTimeout.NoTimeout)


def push_packets(chunks: DataFrame, most_bytes: int = 1 << 16) -> DataFrame:
    """chunks: stream_id, seq, chunk (null: the stream's end). A streaming DataFrame of access units in packets."""
    return _pushed(chunks, lambda: Packets(most_bytes), UNIT_OUT)


def push_fragments(chunks: DataFrame, most_bytes: int = 1 << 26) -> DataFrame:
    """chunks: stream_id, seq, chunk (null: the stream's end). A streaming DataFrame of samples of fragmented streams."""
    return _pushed(chunks, lambda: Fragments(most_bytes), SAMPLE_OUT)
