"""Expressions that name a time or a version."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of units, and their seconds.
UNITS = (("sec", 1), ("min", 60), ("hour", 3600), ("day", 86400), ("week", 604800))
NS = 1_000_000_000
#: Numbers after @ below this are seconds, others nanoseconds.
SECONDS_BELOW = 10_000_000_000


def parse_time(expr: str | None, now_ns: int) -> int | None:
    """Nanoseconds; None if it isn't a time."""
    if not expr or expr == "now":
        return now_ns
    if m := re.match(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})", expr):
        try:
            return int(datetime(*map(int, m.groups()), tzinfo=timezone.utc).timestamp()) * NS
        except ValueError:
            return None
    if m := re.match(r"\s*([+-]?\d+)\s*(\S+)", expr):
        for unit, seconds in UNITS:
            if m[2].startswith(unit):
                return max(0, now_ns - abs(int(m[1])) * seconds * NS)
    return None


def time_expr(expr: Column, now_ns: int) -> Column:
    """X1 for a column, in the session's time zone."""
    n = F.try_to_number(F.regexp_extract(expr, r"^\s*[+-]?(\d{1,12})\s*\S", 1), F.lit("999999999999"))
    unit = F.regexp_extract(expr, r"^\s*[+-]?\d+\s*([a-z]+)", 1)
    seconds = F.lit(None).cast("bigint")
    for name, size in UNITS:
        seconds = F.when(unit.startswith(name), F.lit(size).cast("bigint")).otherwise(seconds)
    stamp = F.unix_micros(F.try_to_timestamp(F.regexp_extract(expr, r"^\s*(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss"))) * 1000
    back = n.cast("bigint") * seconds * NS
    ago = F.when(back.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.lit(now_ns) - back))
    return F.when(expr.isNull() | (expr == "") | (expr == "now"), F.lit(now_ns)).otherwise(F.coalesce(stamp, ago))


def is_integer(arg: Column) -> Column:
    """Whether all of it is a whole number of 64 bits; white space may lead."""
    return F.coalesce(arg.rlike(r"^\s*[+-]?[0-9]+\z"), F.lit(False)) & F.trim(arg).try_cast("bigint").isNotNull()


@dataclass(frozen=True)
class Target:
    """A revision, or the last at a time (None: the latest of all)."""

    revision: int | None = None
    until: int | None = None


def resolve(expr: str | None, now_ns: int, tags: dict[str, int] | None = None, revisions: int | None = None) -> Target:
    """X2. ``revisions``: how many the file has, if known; with one, ``prev`` is the first."""
    text = (expr or "").strip()
    low = text.lower()
    if not text or low in ("prev", "previous"):
        return Target(revision=-2 if revisions is None or revisions > 1 else 1)
    if low in ("now", "head", "latest", "last"):
        return Target(revision=-1)
    if low in ("first", "initial"):
        return Target(revision=1)
    if low.startswith("tag:"):
        if text[4:] not in (tags or {}):
            raise ValueError(f"no such tag: {text[4:]}")
        return Target(until=tags[text[4:]])
    if re.fullmatch(r"@\d+", text):
        n = int(text[1:])
        return Target(until=n * NS if n < SECONDS_BELOW else n)
    if re.fullmatch(r"[+-]?\d+", text):
        return Target(revision=int(text))
    if (at := parse_time(text, now_ns)) is None:
        raise ValueError(f"neither a version nor a time: {text}")
    return Target(until=at)
