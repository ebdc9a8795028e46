"""Scalar functions as columns: all of them stay inside generated code, but for what ``let`` binds, which is interpreted in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG = 1024


def word(content: Column, at: int | Column, size: int) -> Column:
    """Big-endian unsigned number of up to seven bytes from byte ``at`` (0 is the first)."""
    return F.conv(F.hex(F.substring(content, at + 1, size) if isinstance(at, int) else content.substr(at + 1, F.lit(size))), 16, 10).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bits(value: Column, shift: int, n: int) -> Column:
    """n bits of a number, above ``shift`` lower ones."""
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << n) - 1))


def sign_extended(value: Column, n: int) -> Column:
    return F.when(bits(value, n - 1, 1) == 1, value - (1 << n)).otherwise(value)


def syncsafe(n: Column) -> Column:
    """28 bits as four groups of seven."""
    return sum((F.shiftleft(bits(n, 7 * k, 7), 8 * k) for k in range(1, 4)), bits(n, 0, 7))


def unsyncsafe(n: Column) -> Column:
    """The inverse; null if one of the groups has its high bit set."""
    clean = n.bitwiseAND(F.lit(0x80808080)) == 0
    return F.when(clean, sum((F.shiftleft(bits(n, 8 * k, 7), 7 * k) for k in range(1, 4)), bits(n, 0, 7)))


def adts_header(content: Column) -> dict[str, Column]:
    """Fields of the 56-bit header at the start of the bytes."""
    w = word(content, 0, 7)
    absent, n_rdb = bits(w, 40, 1) == 1, bits(w, 0, 2) + 1
    return {
        "sync": bits(w, 44, 12), "mpeg2": bits(w, 43, 1) == 1, "layer": bits(w, 41, 2), "protection_absent": absent, "profile": bits(w, 38, 2), "fs_index": bits(w, 34, 4),
        "ch_cfg": bits(w, 30, 3), "frame_len": bits(w, 13, 13), "fullness": bits(w, 2, 11), "n_rdb": n_rdb,
        "payload_offset": F.when(absent, 7).when(n_rdb <= 1, 9).otherwise(7 + 2 * n_rdb),
    }


def adts_bytes(profile: Column, fs_index: Column, ch_cfg: Column, frame_len: Column, fullness: Column, n_rdb: Column, bare: Column | None = None) -> Column:
    """The seven bytes of a header; ``bare``: whether no check sum follows them (it is the caller's to add)."""
    sync = F.lit(0xFFF1 << 40) if bare is None else F.when(bare, F.lit(0xFFF1 << 40)).otherwise(F.lit(0xFFF0 << 40))
    high = sync.bitwiseOR(F.shiftleft(profile.cast("long"), 38)).bitwiseOR(F.shiftleft(fs_index.cast("long"), 34)).bitwiseOR(F.shiftleft(ch_cfg.cast("long"), 30))
    low = F.shiftleft(frame_len.cast("long"), 13).bitwiseOR(F.shiftleft(fullness.cast("long"), 2)).bitwiseOR(n_rdb.cast("long") - 1)
    return F.unhex(F.lpad(F.hex(high.bitwiseOR(low)), 14, "0"))


def lc_config(fs_index: Column, ch_cfg: Column) -> Column:
    """The two bytes of an LC configuration: object type 2, rate index, channels."""
    return F.unhex(F.lpad(F.hex(F.lit(2 << 11).bitwiseOR(F.shiftleft(fs_index.cast("long"), 7)).bitwiseOR(F.shiftleft(ch_cfg.cast("long"), 3))), 4, "0"))


def rescaled(value: Column, rate: Column, timescale: Column) -> Column:
    """value * rate / timescale, floored, by way of 38 digits."""
    wide = value.cast("decimal(19,0)") * rate.cast("decimal(10,0)")
    return ((wide - wide % timescale.cast("decimal(10,0)")) / timescale.cast("decimal(10,0)")).cast("long")


def converted(value: Column, to: Column, source: Column) -> Column:
    """The exact rescale, null where it isn't whole."""
    wide = value.cast("decimal(19,0)") * to.cast("decimal(10,0)")
    return F.when(wide % source.cast("decimal(10,0)") == 0, (wide / source.cast("decimal(10,0)")).cast("long"))


def rounded_tail(duration: Column, rate: Column, timescale: Column, samples: Column) -> Column:
    """Whether a declared duration exceeds the samples by less than one tick and less than 1 ms."""
    d, r, t, s = (c.cast("decimal(18,0)") for c in (duration, rate, timescale, samples))
    over = d * r - s * t
    return (over > 0) & (over < r) & (over * 1000 < r * t)


def delay_lc(samples: Column) -> Column:
    return F.struct(F.lit(LONG).cast("long").alias("priming"), ((LONG - samples % LONG) % LONG).cast("long").alias("remainder"), samples.cast("long").alias("source"))


def achieved_bps(size: Column, samples: Column, rate: Column) -> Column:
    """0, not null, where it is undefined."""
    return F.when((samples == 0) | (rate == 0), 0.0).otherwise(8.0 * size * rate / samples)


def bark(f: Column) -> Column:
    return 13.0 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500.0, 2))


def absolute_threshold_db(f: Column) -> Column:
    """Hearing threshold in dB SPL; the frequency is held to 20 Hz .. 24 kHz."""
    k = F.greatest(F.least(f / 1000.0, F.lit(24.0)), F.lit(0.02))
    return 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, 2)) + 0.001 * F.pow(k, 4)


def inverse_quantised(q: Column) -> Column:
    return F.signum(q) * F.pow(F.abs(q).cast("double"), F.lit(4.0 / 3.0))


def scale_gain(sf: Column) -> Column:
    return F.pow(F.lit(2.0), 0.25 * (sf - 100))


def quantiser_gain(sf: Column) -> Column:
    return F.pow(F.lit(2.0), -0.1875 * (sf - 100))


def scale_for_peak(peak: Column, target: Column) -> Column:
    return F.round(100 + 4 * F.log2(peak) - 16.0 / 3.0 * F.log2(target)).cast("long")


def noise_index(energy: Column) -> Column:
    return F.when(energy <= 1e-20, 0).otherwise(F.round(2 * F.log2(energy))).cast("long")


def lcg(state: Column) -> Column:
    """The next state modulo 2**32."""
    return (state * 1664525 + 1013904223).bitwiseAND(F.lit(0xFFFFFFFF))


def fnv1a(content: Column) -> Column:
    """64-bit FNV-1a of bytes as 16 hex digits, in two halves of 32 bits, as a 64-bit product would overflow."""
    text = F.hex(content)
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(acc, i):
        byte = F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        lo = acc["lo"].bitwiseXOR(byte)
        product = lo * 435
        mask = F.lit(0xFFFFFFFF)
        return F.struct((acc["hi"] * 435 + F.shiftleft(lo, 8) + F.shiftright(product, 32)).bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    places = F.when(F.length(content) > 0, F.sequence(F.lit(0), F.length(content) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda a: F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0")))


def hex_field(text: Column, width: int) -> Column:
    """The number in a field of exactly so many hex digits, else null."""
    return F.when(text.rlike(f"^[0-9A-Fa-f]{{{width}}}$"), F.conv(text, 16, 10).cast("long"))


def gapless_fields(text: Column) -> Column:
    """priming, remainder and source of a gapless comment: a zero, then fields of 8, 8 and 16 digits."""
    names = (("zero", 8), ("priming", 8), ("remainder", 8), ("source", 16))
    found = let(F.split(F.trim(text), r"\s+"), lambda f: F.struct(*(hex_field(F.get(f, F.lit(k)), n).alias(x) for k, (x, n) in enumerate(names))))
    return let(found, lambda x: F.when((x["zero"] == 0) & x["priming"].isNotNull() & x["remainder"].isNotNull() & x["source"].isNotNull(), F.struct(*(x[n].alias(n) for n, _ in names[1:]))))


def gapless_comment(priming: Column, remainder: Column, source: Column) -> Column:
    fixed = [F.lit("00000000")] * 8
    return F.concat(F.lit(" "), F.array_join(F.array(F.lit("00000000"), F.lpad(F.hex(priming), 8, "0"), F.lpad(F.hex(remainder), 8, "0"), F.lpad(F.hex(source), 16, "0"), *fixed), " "))
