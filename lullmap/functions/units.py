"""Levels, sizes, durations and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, and seconds of time allowed per second of length.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
SECONDS_PER_SECOND = 6


def db_to_amplitude(c: Column) -> Column:
    """Linear amplitude of a level in dB."""
    return F.pow(F.lit(10.0), c / F.lit(20.0))


def fmt_bytes(c: Column) -> Column:
    """Bytes with one decimal in 1024-steps; negative counts as 0."""
    size = F.greatest(F.lit(0.0), c.cast("double"))
    text = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(SIZE_UNITS))):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**power), 1))
        fits = size < F.lit(1024.0 ** (power + 1))
        text = shown if unit == SIZE_UNITS[-1] else F.when(fits, shown).otherwise(text)
    return F.when(c.isNotNull(), text)


def fmt_speed(c: Column) -> Column:
    """Bytes per second; unknown or negative is ``?``."""
    return F.when(c >= 0, F.concat(fmt_bytes(F.floor(c)), F.lit("/s"))).otherwise("?")


def _parts(seconds: Column) -> dict[str, Column]:
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return {
        "d": div(seconds, 86_400),
        "h": div(seconds % 86_400, 3600),
        "m": div(seconds % 3600, 60),
        "s": seconds % 60,
    }


def fmt_elapsed(c: Column) -> Column:
    """``1d 2h 3m 4s`` from the largest unit in use down to seconds; negative counts as 0."""
    p = _parts(F.greatest(F.lit(0), c.cast("long")))
    seen, texts = F.lit(False), []
    for unit in ("d", "h", "m"):
        seen = seen | (p[unit] > 0)
        texts.append(F.when(seen, F.concat(p[unit].cast("string"), F.lit(unit))))
    texts.append(F.concat(p["s"].cast("string"), F.lit("s")))
    return F.when(c.isNotNull(), F.concat_ws(" ", *texts))


def fmt_clock(c: Column) -> Column:
    """``HH:MM:SS``, with days in front from 24 h; unknown or negative is ``?``."""
    p = _parts(c.cast("long"))
    clock = F.format_string("%02d:%02d:%02d", p["h"], p["m"], p["s"])
    days = F.when(p["d"] > 0, p["d"].cast("string"))
    return F.when(c >= 0, F.concat_ws(":", days, clock)).otherwise("?")


def fmt_hm(c: Column) -> Column:
    """``3h29m``, ``59m29s`` or ``45m`` of the rounded seconds; unknown is ``?``."""
    p = _parts(F.bround(c.cast("double")).cast("long"))
    h, m, s = p["d"] * 24 + p["h"], p["m"], p["s"]
    text = (
        F.when(h > 0, F.format_string("%dh%02dm", h, m))
        .when(s > 0, F.format_string("%dm%02ds", m, s))
        .otherwise(F.format_string("%dm", m))
    )
    return F.when(c.isNotNull(), text).otherwise("?")


def parse_ratio(c: Column) -> Column:
    """``30000/1001`` or a plain number as a double; not positive or unreadable is null."""
    fields = F.split(F.trim(c), "/", 2)
    top = fields[0].try_cast("double")
    rest = F.get(fields, F.lit(1))
    bottom = F.when(rest.isNull(), F.lit(1.0)).otherwise(rest.try_cast("double"))
    ratio = F.try_divide(top, F.when(bottom > 0, bottom))
    return F.when((ratio > 0) & ~F.isnan(ratio), ratio)


def scaled_limit(base: Column, length: Column) -> Column:
    """Time limit that grows with the length: at least ``base``, 6 per unit of length."""
    return F.greatest(base.cast("double"), F.greatest(F.lit(0.0), length) * SECONDS_PER_SECOND)
