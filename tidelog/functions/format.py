"""Values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import label

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30


def nbytes(n: Column) -> Column:
    """X4, rounded as C's printf rounds: to even where a size lies halfway. Null for null."""
    of = lambda unit, bits, digits: F.concat(_rounded(n, bits, digits), F.lit(f" {unit}"))
    return F.when(n >= GIB, of("GiB", 30, 2)).when(n >= MIB, of("MiB", 20, 1)).when(n >= KIB, of("KiB", 10, 1)).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit(" B")))


def _rounded(n: Column, bits: int, digits: int) -> Column:
    """n / 2 ** bits with 1 or 2 digits. Java rounds halves up, so it is done in whole numbers."""
    # of what a double holds of n, as C divides doubles; the next one below 2 ** 63 fits into a bigint
    of = F.least(n.cast("double"), F.lit(float((1 << 63) - 1024))).cast("bigint")
    scaled = of.bitwiseAND(F.lit((1 << bits) - 1)) * 10**digits
    down, rest, half = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1)), 1 << (bits - 1)
    up = F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    near = down + up
    whole = F.shiftright(of, bits) + F.when(near == 10**digits, 1).otherwise(0)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((near % 10**digits).cast("string"), digits, "0"))


def duration(ns: Column) -> Column:
    """X5."""
    s = _div(ns, 1_000_000_000)
    d, h, m, r = _div(s, 86400), _div(s % 86400, 3600), _div(s % 3600, 60), s % 60
    return F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, r)).when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def _div(a: Column, n: int) -> Column:
    """Of whole numbers, exactly: a double doesn't hold all nanoseconds."""
    return F.call_function("div", a, F.lit(n).cast("bigint"))


def timestamp(ns: Column) -> Column:
    """X3, in the session's time zone."""
    return F.date_format(F.timestamp_micros(_div(ns, 1000)), "yyyy-MM-dd HH:mm:ss")


def ratio(delta: Column, size: Column) -> Column:
    """Percent; 0 for an empty file."""
    return F.when(size > 0, 100.0 * delta / size).otherwise(F.lit(0.0))


def log_line(ns: Column, event_type: Column, path: Column, size: Column) -> Column:
    """SC13: a record as a line, its time to the millisecond."""
    at = F.date_format(F.timestamp_micros(_div(ns, 1000)), "yyyy-MM-dd HH:mm:ss.SSS")
    return F.format_string("[%s] %-8s %s (%d B)", at, label(event_type), path, size)
