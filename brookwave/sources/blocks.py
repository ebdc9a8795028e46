"""Raw data blocks: entropy coding, channel streams, and spectra from them.

What the standard tabulates and a stream doesn't carry is a parameter, ``Coding``: the codebooks, the borders of
the scale bands, and how far noise shaping reaches. ``ruled`` makes codebooks by a rule, for tests and queries;
streams of other writers need the books of the standard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from brookwave.operators import kernels as K
from brookwave.sources.bitio import BitReader, BitWriter, Truncated

ONLY_LONG, START, SHORT, STOP = range(4)
SINGLE, PAIR, COUPLED, LOW, DATA, PROGRAM, FILL, END = range(8)
ZERO, RESERVED, NOISE, OUT_OF_PHASE, IN_PHASE = 0, 12, 13, 14, 15
# Fixed values of ISO/IEC 14496-3: values in a codeword, whether they carry their signs, the largest magnitude.
BOOKS = {1: (4, True, 1), 2: (4, True, 1), 3: (4, False, 2), 4: (4, False, 2), 5: (2, True, 4), 6: (2, True, 4), 7: (2, False, 7), 8: (2, False, 7), 9: (2, False, 12), 10: (2, False, 12), 11: (2, False, 16)}
SCALE_ZERO, NOISE_OFFSET, NOISE_SEED = 60, 90, 0x1F2E3D4C
# Fixed values of the same: borders of the scale bands at 44.1 and 48 kHz.
LONG_44 = (0, 4, 8, 12, 16, 20, 24, 28, 32, 36, 40, 48, 56, 64, 72, 80, 88, 96, 108, 120, 132, 144, 160, 176, 196, 216, 240, 264, 292, 320, 352, 384, 416, 448, 480, 512, 544, 576, 608, 640, 672, 704, 736, 768, 800, 832, 864, 896, 928, 1024)
SHORT_44 = (0, 4, 8, 12, 16, 20, 28, 36, 44, 56, 68, 80, 96, 112, 128)


class Refused(ValueError):
    """Bits that no block of this kind has."""


@dataclass(frozen=True)
class Book:
    """A prefix code: (length, code) of each index."""

    codes: tuple[tuple[int, int], ...]

    @cached_property
    def _met(self) -> dict[tuple[int, int], int]:
        return {c: i for i, c in enumerate(self.codes)}

    @cached_property
    def _lengths(self) -> list[int]:
        return sorted({n for n, _ in self.codes})

    def read(self, bits: BitReader) -> int:
        have = min(bits.left, self._lengths[-1])
        word = bits.peek(have)
        for n in self._lengths:
            if n > have:
                break
            index = self._met.get((n, word >> (have - n)))
            if index is not None:
                bits.at += n
                return index
        if have < self._lengths[-1]:
            raise Truncated(f"codeword at {bits.at} of {bits.end}")
        raise Refused("no codeword")

    def write(self, out: BitWriter, index: int) -> None:
        n, code = self.codes[index]
        out.write(code, n)


@dataclass(frozen=True)
class Coding:
    scale: Book
    spectral: tuple[Book, ...]  # books 1 to 11
    long: tuple[int, ...] = LONG_44
    short: tuple[int, ...] = SHORT_44
    shaped: tuple[int, int] = (42, 14)  # bands that noise shaping reaches, long and short

    @property
    def frame(self) -> int:
        return self.long[-1]


def gamma(count: int) -> Book:
    """Index i as the Elias gamma code of i + 1: shorter for smaller ones, 2 floor(log2(i + 1)) + 1 bits."""
    return Book(tuple((2 * i.bit_length() - 1, i) for i in range(1, count + 1)))


def ruled(long: tuple[int, ...] = LONG_44, short: tuple[int, ...] = SHORT_44, shaped: tuple[int, int] = (42, 14)) -> Coding:
    """A coding with books by rule: scale steps and tuples have gamma codes of their indices."""
    return Coding(gamma(2 * SCALE_ZERO + 1), tuple(gamma((2 * m + 1 if s else m + 1) ** d) for d, s, m in BOOKS.values()), long, short, shaped)


@dataclass(frozen=True)
class Mode:
    sequence: int
    shape: int
    bands: int
    groups: tuple[int, ...] = (1,)


@dataclass
class Channel:
    mode: Mode
    gain: int
    books: list[list[int]]
    scales: list[list[int]]
    pulse: tuple[int, list[int], list[int]] | None = None
    shaping: list[tuple[int, list[tuple]]] = field(default_factory=list)
    quant: np.ndarray | None = None  # windows by bins


@dataclass
class Element:
    kind: int
    tag: int
    channels: list[Channel]
    mask: list[list[bool]] | None = None  # by group and band
    per_band: bool = False


# --- tuples


def tuple_index(book: int, values: tuple[int, ...]) -> int | None:
    """The place of a tuple in its book, None where the book has none; magnitudes above 15 are escapes of book 11."""
    d, signed, most = BOOKS[book]
    digits = [v + most if signed else min(abs(v), 16) if book == 11 else abs(v) for v in values]
    base = 2 * most + 1 if signed else most + 1
    if any(not 0 <= x < base for x in digits) or book == 11 and max(map(abs, values)) > 8191:
        return None
    index = 0
    for x in digits:
        index = index * base + x
    return index


def tuple_bits(coding: Coding, book: int, values: tuple[int, ...]) -> int | None:
    """What a tuple costs: codeword, signs and escapes."""
    index = tuple_index(book, values)
    if index is None:
        return None
    signs = 0 if BOOKS[book][1] else sum(v != 0 for v in values)
    escapes = sum(2 * (abs(v).bit_length() - 5) + 5 for v in values if abs(v) > 15) if book == 11 else 0
    return coding.spectral[book - 1].codes[index][0] + signs + escapes


def band_bits(coding: Coding, values: list[int]) -> list[int | None]:
    """What the values of a band cost under each of the books 1 to 11."""
    costs = []
    for book, (d, _, _) in BOOKS.items():
        each = [tuple_bits(coding, book, tuple(values[k : k + d])) for k in range(0, len(values), d)]
        costs.append(None if None in each else sum(each))
    return costs


def write_tuple(coding: Coding, book: int, values: tuple[int, ...], out: BitWriter) -> None:
    index = tuple_index(book, values)
    if index is None:
        raise Refused(f"book {book} has no {values}")
    coding.spectral[book - 1].write(out, index)
    if not BOOKS[book][1]:
        for v in values:
            if v:
                out.write(v < 0, 1)
    if book == 11:
        for v in values:
            if abs(v) > 15:
                more = abs(v).bit_length() - 5
                out.write((1 << more) - 1 << 1, more + 1).write(abs(v) - (1 << more + 4), more + 4)


def read_tuple(coding: Coding, book: int, bits: BitReader) -> list[int]:
    d, signed, most = BOOKS[book]
    index, base, values = coding.spectral[book - 1].read(bits), 2 * most + 1 if signed else most + 1, []
    for _ in range(d):
        index, digit = divmod(index, base)
        values.append(digit - most if signed else digit)
    values.reverse()
    if signed:
        return values
    signs = [-1 if v and bits.read(1) else 1 for v in values]
    if book == 11:
        values = [_escaped(bits) if v == 16 else v for v in values]
    return [s * v for s, v in zip(signs, values, strict=True)]


def _escaped(bits: BitReader) -> int:
    more = 4
    while bits.read(1):
        more += 1
        if more > 12:
            raise Refused("escape of more than 13 bits")
    return (1 << more) + bits.read(more)


# --- parts of a channel


def read_mode(bits: BitReader, coding: Coding) -> Mode:
    bits.skip(1)
    sequence, shape = bits.read(2), bits.read(1)
    if sequence == SHORT:
        bands, joined = bits.read(4), bits.read(7)
        groups = [1]
        for k in range(6, -1, -1):
            if joined >> k & 1:
                groups[-1] += 1
            else:
                groups.append(1)
        found = Mode(sequence, shape, bands, tuple(groups))
    else:
        found = Mode(sequence, shape, bits.read(6))
        if bits.read(1):
            raise Refused("prediction in a low complexity stream")
    if found.bands >= len(coding.short if sequence == SHORT else coding.long):
        raise Refused("more bands than there are")
    return found


def read_books(bits: BitReader, mode: Mode) -> list[list[int]]:
    """Sections: a book for each band of each group."""
    wide = 3 if mode.sequence == SHORT else 5
    out = []
    for _ in mode.groups:
        row: list[int] = []
        while len(row) < mode.bands:
            book, n = bits.read(4), 0
            if book == RESERVED:
                raise Refused("reserved book")
            while (step := bits.read(wide)) == (1 << wide) - 1:
                n += step
            row += [book] * (n + step)
            if len(row) > mode.bands:
                raise Refused("section beyond the bands")
        out.append(row)
    return out


def read_scales(bits: BitReader, coding: Coding, books: list[list[int]], gain: int) -> list[list[int]]:
    """Scales, places of intensity and energies of noise, each a running sum of its own."""
    scale, place, energy, first = gain, 0, gain - NOISE_OFFSET - 256, True
    out = []
    for row in books:
        found = []
        for book in row:
            if book == ZERO:
                found.append(0)
            elif book == NOISE and first:
                energy, first = energy + bits.read(9), False
                found.append(energy)
            else:
                step = coding.scale.read(bits) - SCALE_ZERO
                if book == NOISE:
                    energy += step
                    found.append(energy)
                elif book >= OUT_OF_PHASE:
                    place += step
                    found.append(place)
                else:
                    scale += step
                    if not 0 <= scale < 256:
                        raise Refused("scale beyond a byte")
                    found.append(scale)
        out.append(found)
    return out


def read_shaping(bits: BitReader, mode: Mode) -> list[tuple[int, list[tuple]]]:
    """By window: bits of a coefficient, and filters of (bands, order, downwards, shortened, coefficients)."""
    short = mode.sequence == SHORT
    out = []
    for _ in range(sum(mode.groups)):
        filters, fine = [], 3
        n = bits.read(1 if short else 2)
        if n:
            fine += bits.read(1)
        for _ in range(n):
            bands, order = bits.read(4 if short else 6), bits.read(3 if short else 5)
            if order > (7 if short else 12):
                raise Refused("shaping of too high an order")
            down, less = (bits.read(1), bits.read(1)) if order else (0, 0)
            filters.append((bands, order, down, less, [bits.signed(fine - less) for _ in range(order)]))
        out.append((fine, filters))
    return out


def spans(mode: Mode, coding: Coding) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(group, band, first window, windows, first bin, end) in the order of the bits."""
    borders, at = coding.short if mode.sequence == SHORT else coding.long, 0
    for g, n in enumerate(mode.groups):
        for b in range(mode.bands):
            yield g, b, at, n, borders[b], borders[b + 1]
        at += n


def windows(mode: Mode, coding: Coding) -> tuple[int, int]:
    return (8, coding.short[-1]) if mode.sequence == SHORT else (1, coding.long[-1])


def read_channel(bits: BitReader, coding: Coding, mode: Mode | None) -> Channel:
    gain = bits.read(8)
    mode = mode or read_mode(bits, coding)
    books = read_books(bits, mode)
    out = Channel(mode, gain, books, read_scales(bits, coding, books, gain))
    if bits.read(1):
        if mode.sequence == SHORT:
            raise Refused("pulses in short windows")
        n, start = bits.read(2) + 1, bits.read(6)
        pairs = [(bits.read(5), bits.read(4)) for _ in range(n)]
        if start >= len(coding.long):
            raise Refused("pulse beyond the bands")
        out.pulse = coding.long[start], [p[0] for p in pairs], [p[1] for p in pairs]
    if bits.read(1):
        out.shaping = read_shaping(bits, mode)
    if bits.read(1):
        raise Refused("gain control in a low complexity stream")
    quant = np.zeros(windows(mode, coding), int)
    for g, b, w, n, lo, hi in spans(mode, coding):
        book = books[g][b]
        if ZERO < book < RESERVED:
            values: list[int] = []
            while len(values) < n * (hi - lo):
                values += read_tuple(coding, book, bits)
            quant[w : w + n, lo:hi] = np.reshape(values, (n, hi - lo))
    out.quant = K.with_pulses(quant[0], *out.pulse)[None] if out.pulse else quant
    return out


# --- blocks


def fill_count(bits: BitReader) -> int:
    n = bits.read(4)
    return n + bits.read(8) - 1 if n == 15 else n


def read_block(payload: bytes, coding: Coding) -> list[Element]:
    """The elements of a block up to its end mark; data and fill are passed over, coupling and programs refused."""
    bits, out = BitReader(payload), []
    while (kind := bits.read(3)) != END:
        if kind == FILL:
            bits.skip(8 * fill_count(bits))
            continue
        if kind in (COUPLED, PROGRAM):
            raise Refused("coupling element" if kind == COUPLED else "program element")
        tag = bits.read(4)
        if kind == DATA:
            aligned, n = bits.read(1), bits.read(8)
            n += bits.read(8) if n == 255 else 0
            if aligned:
                bits.align()
            bits.skip(8 * n)
        elif kind == PAIR:
            out.append(_read_pair(bits, coding, tag))
        else:
            out.append(Element(kind, tag, [read_channel(bits, coding, None)]))
    return out


def _read_pair(bits: BitReader, coding: Coding, tag: int) -> Element:
    mode = mask = None
    kind = 0
    if bits.read(1):
        mode, kind = read_mode(bits, coding), bits.read(2)
        if kind == 3:
            raise Refused("reserved mask")
        if kind:
            mask = [[kind == 2 or bool(bits.read(1)) for _ in range(mode.bands)] for _ in mode.groups]
    return Element(PAIR, tag, [read_channel(bits, coding, mode), read_channel(bits, coding, mode)], mask, kind == 1)


def write_channel(out: BitWriter, coding: Coding, c: Channel, common: bool) -> None:
    out.write(c.gain, 8)
    if not common:
        write_mode(out, c.mode)
    most = (1 << (3 if c.mode.sequence == SHORT else 5)) - 1
    for row in c.books:
        at = 0
        while at < len(row):
            n = next((k for k in range(at, len(row)) if row[k] != row[at]), len(row)) - at
            out.write(row[at], 4)
            for _ in range(n // most):
                out.write(most, most.bit_length())
            out.write(n % most, most.bit_length())
            at += n
    scale, place, energy, first = c.gain, 0, c.gain - NOISE_OFFSET - 256, True
    for row, values in zip(c.books, c.scales, strict=True):
        for book, v in zip(row, values, strict=True):
            if book == NOISE and first:
                out.write(v - energy, 9)
                energy, first = v, False
            elif book == NOISE:
                coding.scale.write(out, v - energy + SCALE_ZERO)
                energy = v
            elif book >= OUT_OF_PHASE:
                coding.scale.write(out, v - place + SCALE_ZERO)
                place = v
            elif book:
                coding.scale.write(out, v - scale + SCALE_ZERO)
                scale = v
    out.write(0, 1).write(bool(c.shaping), 1)
    short = c.mode.sequence == SHORT
    for fine, filters in c.shaping:
        out.write(len(filters), 1 if short else 2)
        if filters:
            out.write(fine - 3, 1)
        for bands, order, down, less, coefficients in filters:
            out.write(bands, 4 if short else 6).write(order, 3 if short else 5)
            if order:
                out.write(down, 1).write(less, 1)
            for k in coefficients:
                out.write(k, fine - less)
    out.write(0, 1)
    for g, b, w, n, lo, hi in spans(c.mode, coding):
        book = c.books[g][b]
        if ZERO < book < RESERVED:
            d, values = BOOKS[book][0], c.quant[w : w + n, lo:hi].ravel().tolist()
            for k in range(0, len(values), d):
                write_tuple(coding, book, tuple(values[k : k + d]), out)


def write_mode(out: BitWriter, mode: Mode) -> None:
    out.write(mode.sequence, 3).write(mode.shape, 1)
    if mode.sequence == SHORT:
        joined = [k > 0 for n in mode.groups for k in range(n)][1:]
        out.write(mode.bands, 4).write(sum(j << 6 - k for k, j in enumerate(joined)), 7)
    else:
        out.write(mode.bands, 6).write(0, 1)


def write_block(elements: list[Element], coding: Coding) -> bytes:
    """A block of elements without pulses."""
    out = BitWriter()
    for e in elements:
        out.write(e.kind, 3).write(e.tag, 4)
        if e.kind == PAIR:
            common = e.channels[0].mode == e.channels[1].mode
            out.write(common, 1)
            if common:
                write_mode(out, e.channels[0].mode)
                out.write(0 if e.mask is None else 1 if e.per_band else 2, 2)
                for used in (u for row in e.mask for u in row) if e.per_band else ():
                    out.write(used, 1)
            for c in e.channels:
                write_channel(out, coding, c, common)
        else:
            write_channel(out, coding, e.channels[0], False)
    return out.write(END, 3).bytes()


# --- spectra


def rescaled(c: Channel, coding: Coding) -> np.ndarray:
    """Integers to a spectrum: the sign, the magnitude to 4/3, two to a quarter of the scale less 100."""
    out = np.zeros(windows(c.mode, coding))
    for g, b, w, n, lo, hi in spans(c.mode, coding):
        if ZERO < c.books[g][b] < RESERVED:
            q = c.quant[w : w + n, lo:hi]
            out[w : w + n, lo:hi] = np.sign(q) * np.abs(q) ** (4 / 3) * 2 ** ((c.scales[g][b] - 100) / 4)
    return out


def draws_of(elements: list[Element], coding: Coding) -> int:
    """How many noise numbers a block takes; bands that both channels of a pair share take theirs once."""
    return sum(
        n * (hi - lo)
        for e in elements
        for k, c in enumerate(e.channels)
        for g, b, _, n, lo, hi in spans(c.mode, coding)
        if c.books[g][b] == NOISE and not (k and _shared(e, g, b))
    )


def _shared(e: Element, g: int, b: int) -> bool:
    return bool(e.mask and e.mask[g][b] and all(c.books[g][b] == NOISE for c in e.channels))


def jumped(state: int, n: int) -> int:
    """The generator's state after n numbers, by squaring its step."""
    if n < 0:
        raise ValueError("no state before the first")
    a, c, total_a, total_c = 1664525, 1013904223, 1, 0
    while n:
        if n & 1:
            total_a, total_c = total_a * a & 0xFFFFFFFF, (total_c * a + c) & 0xFFFFFFFF
        a, c, n = a * a & 0xFFFFFFFF, (c * a + c) & 0xFFFFFFFF, n >> 1
    return (state * total_a + total_c) & 0xFFFFFFFF


def spectra(elements: list[Element], coding: Coding, state: int = NOISE_SEED) -> tuple[list[np.ndarray], int]:
    """A spectrum, windows by bins, of every channel, and the noise's state after.

    Sums and differences first, then noise, the place of intensity, and shaping. Noise is drawn channel by channel in
    the order of the bits; a band that is noise in both channels of a pair and in the mask has one vector for both.
    """
    out = []
    for e in elements:
        x = [rescaled(c, coding) for c in e.channels]
        if e.mask:
            left, right = e.channels
            for g, b, w, n, lo, hi in spans(left.mode, coding):
                if e.mask[g][b] and right.books[g][b] < RESERVED and left.books[g][b] != NOISE:
                    m, s = x[0][w : w + n, lo:hi].copy(), x[1][w : w + n, lo:hi].copy()
                    x[0][w : w + n, lo:hi], x[1][w : w + n, lo:hi] = m + s, m - s
        drawn: dict[int, tuple[int, int]] = {}
        for k, c in enumerate(e.channels):
            for g, b, w, n, lo, hi in spans(c.mode, coding):
                if c.books[g][b] == NOISE:
                    shared = _shared(e, g, b)
                    for v in range(w, w + n):
                        # a shared vector is drawn again from the state that the left channel began it with
                        begun = drawn[v, lo] if k and shared else state
                        x[k][v, lo:hi], after = K.noise(begun, hi - lo, 2.0 ** (c.scales[g][b] / 2))
                        if k and shared:
                            continue
                        drawn[v, lo], state = begun, after
        if e.kind == PAIR:
            c = e.channels[1]
            for g, b, w, n, lo, hi in spans(c.mode, coding):
                if c.books[g][b] >= OUT_OF_PHASE:
                    sign = 1 if c.books[g][b] == IN_PHASE else -1
                    if e.per_band and e.mask[g][b]:
                        sign = -sign
                    x[1][w : w + n, lo:hi] = sign * 0.5 ** (c.scales[g][b] / 4) * x[0][w : w + n, lo:hi]
        out += [shaped(y, c, coding) for y, c in zip(x, e.channels, strict=True)]
    return out, state


def shaped(x: np.ndarray, c: Channel, coding: Coding) -> np.ndarray:
    """Each window's filters over their bands, from the top band down, as recurrences along the bins."""
    if not c.shaping:
        return x
    short = c.mode.sequence == SHORT
    borders, reach = (coding.short, coding.shaped[1]) if short else (coding.long, coding.shaped[0])
    out = x.copy()
    for w, (fine, filters) in enumerate(c.shaping):
        top = len(borders) - 1
        for bands, order, down, _, coefficients in filters:
            low = max(0, top - bands)
            lo, hi = (borders[min(k, reach, c.mode.bands)] for k in (low, top))
            if order and hi > lo:
                steps = np.array(coefficients, float)
                half = 1 << fine - 1
                a = K.step_up(np.sin(steps / np.where(steps >= 0, half - 0.5, half + 0.5) * np.pi / 2))
                row = out[w, lo:hi][:: -1 if down else 1]
                out[w, lo:hi] = K.all_pole(row[None], a[None])[0][:: -1 if down else 1]
            top = low
    return out


# --- samples


def half(shape: int, n: int, short: bool) -> np.ndarray:
    return K.kbd_window(n, 6.0 if short else 4.0) if shape else K.sine_window(n)


def halves(x: np.ndarray, mode: Mode, before: int) -> tuple[np.ndarray, np.ndarray]:
    """A spectrum to its windowed halves: the first is added to the second of the block before."""
    m = x.size
    s, edge = m // 8, (m - m // 8) // 2
    if mode.sequence == SHORT:
        out = np.zeros(2 * m)
        blocks, rise, fall = K.imdct(x), half(mode.shape, s, True), half(mode.shape, s, True)[::-1]
        for k, block in enumerate(blocks):
            at = edge + k * s
            out[at : at + 2 * s] += block * np.concatenate([half(before, s, True) if k == 0 else rise, fall])
        return out[:m], out[m:]
    flat, none = np.ones(edge), np.zeros(edge)
    rise = np.concatenate([none, half(before, s, True), flat]) if mode.sequence == STOP else half(before, m, False)
    fall = np.concatenate([flat, half(mode.shape, s, True)[::-1], none]) if mode.sequence == START else half(mode.shape, m, False)[::-1]
    y = K.imdct(x)[0]
    return y[:m] * rise, y[m:] * fall


@dataclass(frozen=True)
class Held:
    """What a block leaves to the next: each channel's second half and the shape of its window."""

    halves: tuple[np.ndarray, ...] = ()
    shapes: tuple[int, ...] = ()
    noise: int = NOISE_SEED


def block_planes(payload: bytes, coding: Coding, held: Held) -> tuple[list[np.ndarray], Held]:
    """A block's planes in the order of its channels; a channel that wasn't there begins with silence and a sine."""
    elements = read_block(payload, coding)
    found, noise = spectra(elements, coding, held.noise)
    modes = [c.mode for e in elements for c in e.channels]
    planes, seconds = [], []
    for k, (x, mode) in enumerate(zip(found, modes, strict=True)):
        first, second = halves(x, mode, held.shapes[k] if k < len(held.shapes) else 0)
        planes.append(first + held.halves[k] if k < len(held.halves) else first)
        seconds.append(second)
    return planes, Held(tuple(seconds), tuple(m.shape for m in modes), noise)
