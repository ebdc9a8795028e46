"""Limits and rates as columns: planned sizes against budgets, and what a rate allows.

A product that overflows is null and counts as too much; a plan equal to its budget is within it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that a channel may take in a frame of 1024 samples; the largest fullness that says nothing.
FRAME_BITS, FRAME = 6144, 1024
MOST_FULLNESS = 0x7FE
#: The core rates of a doubled rate.
CORE_RATES = (8000, 11025, 12000, 16000, 22050, 24000)


def pcm_bytes(channels: Column, samples: Column) -> Column:
    """Bytes of 32-bit planes, null beyond 64 bits."""
    return F.try_multiply(F.try_multiply(channels.cast("long"), samples.cast("long")), F.lit(4).cast("long"))


def within(planned: Column, most) -> Column:
    return F.coalesce(planned <= most, F.lit(False))


def output_verdict(channels: Column, samples: Column, most_channels: int, most_bytes: int) -> Column:
    """What forbids an output, first the channels, then its size; else ok."""
    return F.when(~within(channels, most_channels), "channels").when(~within(pcm_bytes(channels, samples), most_bytes), "output").otherwise("ok")


def index_verdict(entries: Column, entry_bytes: Column, most_entries: int, most_bytes: int) -> Column:
    """What forbids an index, first its entries, then its bytes; else ok."""
    planned = F.try_multiply(entries.cast("long"), entry_bytes.cast("long"))
    return F.when(~within(entries, most_entries), "entries").when(~within(planned, most_bytes), "bytes").otherwise("ok")


def max_frames(seconds: Column, rate: Column, most_rate: int) -> Column:
    """Samples of a duration at a rate no higher than the cap: 0 unless positive, the largest long if endless."""
    most = F.lit((1 << 63) - 1)
    frames = seconds * F.least(rate, F.lit(max(1, most_rate)))
    return F.when(F.isnan(seconds) | (seconds <= 0), F.lit(0).cast("long")).when(frames >= float(1 << 63), most).otherwise(F.floor(frames).cast("long"))


def max_bitrate_bps(rate: Column, channels: Column) -> Column:
    return F.least(F.floor(F.lit(FRAME_BITS) * channels.cast("long") * rate / FRAME).cast("long"), F.lit((1 << 32) - 1))


def fullness_words(saved_bits: Column, channels: Column) -> Column:
    """The reservoir in words of 32 bits per channel."""
    each = F.floor(saved_bits / F.greatest(channels, F.lit(1)))
    return F.least(F.floor(each / 32), F.lit(MOST_FULLNESS)).cast("long")


def core_rate(rate: Column) -> Column:
    """Half of the rate where that is a core rate, else null."""
    return F.when((rate % 2 == 0) & F.floor(rate / 2).isin(*CORE_RATES), F.floor(rate / 2).cast("long"))
