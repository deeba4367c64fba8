"""Failure classes of text output and exit codes, from marker rules held as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker groups in the order they are tried.
TEXT_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    (
        "unavailable",
        (
            "video unavailable",
            "this video is unavailable",
            "this video is no longer available",
            "video is private",
            "this video is private",
            "has been removed",
        ),
    ),
    ("disk", ("no space left", "disk full", "errno 28")),
    (
        "busy",
        (
            "winerror 32",
            "being used by another process",
            "resource busy",
            "device or resource busy",
            "errno 16",
        ),
    ),
    ("permission", ("permission denied", "errno 13")),
)
GENERIC = "generic"
KILLED_CODES = (-9, 137)
MEMORY_MARKERS = (
    "out of memory",
    "cannot allocate memory",
    "malloc failed",
    "mmap failed",
    "not enough space",
    "error splitting input into thread",
)


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    """True where the lower-case text holds one of the markers."""
    found = F.lit(False)
    for marker in markers:
        found = found | F.lower(c).contains(marker)
    return F.coalesce(found, F.lit(False))


def classify_text(c: Column, rules=TEXT_RULES) -> Column:
    """Name of the first rule with a marker in the text, else ``generic``."""
    named = F.lit(GENERIC)
    for name, markers in reversed(rules):
        named = F.when(contains_any(c, markers), F.lit(name)).otherwise(named)
    return named


def generic_message(c: Column, chars: int | None = None) -> Column:
    """The text that no rule knows, whole or its leading ``chars`` for a narrow display."""
    shown = c if chars is None else F.substring(c, 1, chars)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown error")).otherwise(shown)


def out_of_memory(code: Column, text: Column) -> Column:
    """Whether an exit looks like memory exhaustion; success or still running never does."""
    ended = F.coalesce(code != 0, F.lit(False))
    return ended & (code.isin(*KILLED_CODES) | contains_any(text, MEMORY_MARKERS))
