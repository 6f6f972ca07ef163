"""Values, keys and the level-skip rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tephra.plans.log import VALUE_BYTES


def normalize_value(value: Column, most: int = VALUE_BYTES) -> Column:
    """At most `most` bytes of UTF-8, cut before a character that would not fit."""
    raw = F.encode(value, "UTF-8")
    # a continuation byte is 10xxxxxx: the cut goes back to where a character begins
    def fits(n: int) -> Column:
        return ~F.coalesce(F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int").between(128, 191), F.lit(False))

    cut = F.when(fits(most), F.substring(raw, 1, most))
    for back in (1, 2, 3):
        cut = cut.when(fits(most - back), F.substring(raw, 1, most - back))
    return F.when(F.octet_length(value) <= most, value).otherwise(F.decode(cut, "UTF-8"))


def format_value(key: Column) -> Column:
    return F.format_string("v%.6f", key.cast("double"))


def skip_level(key: Column, level: Column, has_model: Column | bool = True, cap: int = 55) -> Column:
    """The arithmetic level-skip rule: it hashes the key and knows nothing of the level's rows.

    Keys that exist are skipped too, so reads through it are lossy.
    """
    base = F.when(F.lit(has_model) if isinstance(has_model, bool) else has_model, 40).otherwise(45)
    return F.pmod((key * 1000).cast("long") + level.cast("long") * 117, F.lit(100)) < F.least(base + level * 3, F.lit(cap))


def interpolated_page(key: Column, low: Column, high: Column, pages: Column) -> Column:
    """Linear guess of a key's page, clamped to the run."""
    guess = F.floor((key - low) / F.nullif(high - low, F.lit(0.0)) * pages)
    return F.least(F.greatest(F.coalesce(guess, F.lit(0)), F.lit(0)), pages - 1).cast("long")


def duration(seconds: float) -> str:
    """1.50s, 2m 5.0s or 1h 2m 5.0s."""
    if seconds < 60:
        return f"{seconds:.2f}s"
    minutes, rest = divmod(seconds, 60)
    hours, minutes = divmod(int(minutes), 60)
    return (f"{hours}h " if hours else "") + f"{minutes}m {rest:.1f}s"
