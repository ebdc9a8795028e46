"""Options of reading and writing, their validation, and predicates on what streams and encoders declare.

Options are plain values on the driver; what is checked row by row is a column. Verdicts name the first
thing that forbids a combination, or are "ok".
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of state of a channel's filterbank, of its band replication, and of parametric stereo.
FILTERBANK_STATE, REPLICATION_STATE, STEREO_STATE = (1024 + 2048) * 4, 320 * 8 + 32 * 64 * 16 + 1280 * 8 + 128 * 64 * 16 + 8 * 32 * 16 + 40 * 64 * 16, 2 * 32 * 64 * 16
#: Channel configurations by number of planes, and what each lists, in order.
SURROUND = {3: 3, 4: 4, 5: 5, 6: 6, 8: 7}
LABELS = {
    1: ("FrontCenter",),
    2: ("FrontLeft", "FrontRight"),
    3: ("FrontLeft", "FrontRight", "FrontCenter"),
    4: ("FrontLeft", "FrontRight", "FrontCenter", "BackCenter"),
    5: ("FrontLeft", "FrontRight", "FrontCenter", "BackLeft", "BackRight"),
    6: ("FrontLeft", "FrontRight", "FrontCenter", "Lfe", "BackLeft", "BackRight"),
    7: ("FrontLeft", "FrontRight", "FrontCenter", "Lfe", "BackLeft", "BackRight", "SideLeft", "SideRight"),
}
HIGHEST_QUALITY = 10


@dataclass(frozen=True)
class ReadOptions:
    """How streams are read: speech by default, one plane and the caps of a lecture."""

    split_channels: bool = False
    max_seconds: float = 7200.0
    max_rate: int = 192_000
    max_counted_rate: int = 48_000
    max_output_bytes: int = 1 << 32
    max_metadata_bytes: int = 16 << 20

    @classmethod
    def speech(cls) -> ReadOptions:
        return cls()

    @classmethod
    def audio(cls) -> ReadOptions:
        return replace(cls(), split_channels=True)

    @classmethod
    def unbounded(cls) -> ReadOptions:
        return cls(True, math.inf, (1 << 32) - 1, (1 << 32) - 1, (1 << 63) - 1, (1 << 63) - 1)

    def validated(self) -> ReadOptions:
        """Itself, or ValueError for limits that make no sense; an endless duration is the explicit lack of one."""
        d = self.max_seconds
        wrong = "seconds" if math.isnan(d) or d < 0 else "rate" if self.max_rate <= 0 else "counted rate" if self.max_counted_rate <= 0 and math.isfinite(d) else "budget" if min(self.max_output_bytes, self.max_metadata_bytes) <= 0 else None
        if wrong:
            raise ValueError(f"invalid limit: {wrong}")
        return self


def limits_verdict(seconds: Column, rate: Column, counted_rate: Column, budget: Column) -> Column:
    """The same check of rows of limits."""
    endless = seconds == math.inf
    return F.when(F.isnan(seconds) | (seconds < 0), "seconds").when(rate <= 0, "rate").when((counted_rate <= 0) & ~endless, "counted rate").when(budget <= 0, "budget").otherwise("ok")


def mode_verdict(he: Column, ps: Column, ld: Column, cbr: Column, lookahead: Column, quality: Column, adts: Column, lc_tools: Column) -> Column:
    """Which rule a combination of an encoder's modes breaks."""
    varies = quality.isNotNull()
    return (
        F.when(cbr & (he | ps | ld | varies), "cbr").when(varies & (quality > HIGHEST_QUALITY), "quality").when(varies & he, "quality he").when(ps & ~he, "ps")
        .when(ld & adts, "ld adts").when(ld & (he | ps | lookahead | varies), "ld mode").when(ld & lc_tools, "ld tools").otherwise("ok")
    )


def config_for(planes: Column) -> Column:
    """The channel configuration of surround planes, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SURROUND.items() for x in kv)), planes.cast("int"))


def planes_verdict(planes: Column, cbr: Column, ld: Column, he: Column, lookahead: Column) -> Column:
    few = planes.isin(1, 2)
    return F.when(cbr & ~few, "cbr").when(ld & ~few, "ld").when(few, "ok").when(config_for(planes).isNull(), "count").when(he | lookahead, "mode").otherwise("ok")


def labels_of(config: Column) -> Column:
    """Labels of a default configuration in order, empty for others."""
    known = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.element_at(known, config.cast("int")), F.array().cast("array<string>"))


def workspace_bytes(channels: Column, he: Column, ps: Column) -> Column:
    each = F.lit(FILTERBANK_STATE) + F.when(he, REPLICATION_STATE).otherwise(0)
    return channels.cast("long") * each + F.when(ps, STEREO_STATE).otherwise(0)


def warm_up_units(sbr: Column) -> Column:
    """Units decoded before a seek target: none with band replication, which is replayed from the start."""
    return F.when(sbr, 0).otherwise(2).cast("long")


def rates_agree(core: Column, output: Column) -> Column:
    return (output == core) | (output == 2 * core)


def supported(object_type: Column, config: Column) -> Column:
    return object_type.isin(1, 2, 3, 4, 5, 23, 29) & (config <= 7)


def is_format_class(kind: Column) -> Column:
    """Errors that say: not this format."""
    return kind.isin("not_aac", "format")


def truncated_at(error: Column, at: Column) -> Column:
    """The error struct (kind, at) with an offset where it is a truncation without one."""
    return F.struct(error["kind"].alias("kind"), F.when((error["kind"] == "truncated") & error["at"].isNull(), at).otherwise(error["at"]).alias("at"))


def plane_verdict(planes: Column) -> Column:
    """Whether planes are there, of one length and finite."""
    sizes = F.array_distinct(F.transform(planes, F.size))
    finite = F.forall(planes, lambda p: F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < math.inf)))
    return F.when((F.size(planes) <= 0) | (F.element_at(sizes, 1) == 0), "empty").when(F.size(sizes) > 1, "lengths").when(~finite, "not finite").otherwise("ok")


def frame_samples(frame: Column, core: Column, output: Column) -> Column:
    """Decoded samples of a unit: 0, not null, where the rates don't divide."""
    return F.when((core == 0) | ((frame * output) % F.nullif(core, F.lit(0)) != 0), F.lit(0)).otherwise(F.floor(frame * output / F.nullif(core, F.lit(0)))).cast("long")


def armed(priming: Column, source: Column, remainder: Column, frames: Column, per_frame: Column) -> Column:
    """Whether a tag's counts add up to what the frames hold."""
    return priming + source + remainder == frames * per_frame
