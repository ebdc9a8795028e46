"""Leading tags with a gapless comment: written, recognised, read and peeled, as columns on binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brookwave.functions.scalars import gapless_comment, gapless_fields, let, syncsafe, unsyncsafe, word

#: Identifier, major versions and the comment's name; samples of delay of the doubled rate.
IDENTIFIER, MAJORS, NAME = "494433", (3, 4), "iTunSMPB"


def tag_bytes(priming: Column, remainder: Column, source: Column) -> Column:
    """A tag of version 4 with one text frame that holds the comment."""
    body = F.concat(F.unhex(F.lit("03")), F.encode(F.lit(NAME), "utf-8"), F.unhex(F.lit("00")), F.encode(gapless_comment(priming, remainder, source), "utf-8"))
    number = lambda n: F.unhex(F.lpad(F.hex(let(n, syncsafe)), 8, "0"))
    frame = lambda b: F.concat(F.encode(F.lit("TXXX"), "utf-8"), number(F.length(b)), F.unhex(F.lit("0000")), b)
    whole = lambda f: F.concat(F.unhex(F.lit("494433040000")), number(F.length(f)), f)
    return let(let(body, frame), whole)


def tag_state(content: Column) -> Column:
    """(kind, size): absent, need or ready; a tag's size with its header and footer."""
    head = F.hex(F.substring(content, 1, 3))
    begun = (F.length(content) > 0) & F.lit(IDENTIFIER).startswith(head)
    fields = F.struct(word(content, 3, 1).alias("major"), word(content, 5, 1).alias("flags"), let(word(content, 6, 4), unsyncsafe).alias("size"))

    def of(x: Column) -> Column:
        known = x["major"].isin(*MAJORS) & x["size"].isNotNull()
        total = 10 + x["size"] + F.when((x["major"] == 4) & (x["flags"].bitwiseAND(F.lit(16)) != 0), 10).otherwise(0)
        kind = (
            F.when(~begun, "absent").when(F.length(content) < 10, "need").when(F.coalesce(known, F.lit(False)) == F.lit(False), "absent").when(F.length(content) < total, "need").otherwise("ready")
        )
        return let(kind, lambda k: F.struct(k.alias("kind"), F.when(k == "ready", total.cast("long")).alias("size")))

    return let(fields, of)


def peeled(content: Column, state: Column | None = None) -> Column:
    """The bytes behind a whole leading tag, or all of them. ``state``: the content's tag_state, if it is known."""
    size = (tag_state(content) if state is None else state)["size"]
    return F.when(size.isNotNull(), F.substring(content, (size + 1).cast("int"), F.greatest(F.length(content) - size.cast("int"), F.lit(0)))).otherwise(content)


def first_comment(content: Column, state: Column | None = None) -> Column:
    """The gapless fields of a tag that its first text frame holds, as this module writes it. ``state`` as for peeled."""
    state = tag_state(content) if state is None else state
    named = F.substring(content, 22, 8) == F.encode(F.lit(NAME), "utf-8")
    text = F.decode(F.substring(content, 31, 200), "ISO-8859-1")  # what follows the tag can be any bytes
    return F.when((state["kind"] == "ready") & (F.substring(content, 11, 4) == F.encode(F.lit("TXXX"), "utf-8")) & named, gapless_fields(F.regexp_extract(text, "^ [0-9A-Fa-f ]{0,107}", 0)))


def of_several(count: Column, first: Column) -> Column:
    """(kind, value) of tags met: one counts, of several none does."""
    return F.struct(F.when(count == 0, "missing").when(count == 1, "single").otherwise("ambiguous").alias("kind"), F.when(count == 1, first).alias("value"))


def available_samples(duration: Column, start: Column, rate: Column, timescale: Column) -> Column:
    """Samples after an edit's start; null for a duration of 0 or one that ends before the start."""
    wide = (duration - start).cast("decimal(19,0)") * rate.cast("decimal(10,0)")
    return F.when((duration > 0) & (start <= duration), ((wide - wide % timescale.cast("decimal(10,0)")) / timescale.cast("decimal(10,0)")).cast("long"))


def capped_samples(samples: Column, available: Column, rounded: Column) -> Column:
    """A declared length, or what is available if the length exceeds it by rounding alone."""
    return F.when(available.isNotNull() & (available < samples) & rounded, available).otherwise(samples)


def delay_doubled(samples: Column, priming: int, lookahead: int = 8, core: int = 1024) -> Column:
    """(priming, remainder, source) at a doubled rate: content units, one to drain at least, and as many as cover both."""
    content = F.ceil(F.ceil((samples + lookahead) / 2) / core)
    units = F.greatest(content + 1, F.ceil((priming + samples) / (2 * core)))
    return F.struct(F.lit(priming).cast("long").alias("priming"), (units * 2 * core - priming - samples).cast("long").alias("remainder"), samples.cast("long").alias("source"))
