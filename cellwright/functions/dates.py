"""Dates and times written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.functions.text import full, half_width, once, trim_blank

# The shapes that are worth parsing, that count as dates, and that hold a time.
# (Anything may follow, and precede a time, so finding the start is enough.)
GATE = r"\A(?:[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]{8}|[0-9]{4}年|[0-9]{4})"
LIKE = r"\A[0-9]{4}[-/.年][0-9]{1,2}"
HAS_TIME = r"[0-9]:[0-9]{2}"

# the time: hours:minutes, then seconds of which six decimals count, then an offset that is dropped (wall clock stays)
_TIME = r"(?:(?:[Tt]|\x20)?\x20*(\d{1,2}:\d{1,2})(?::(\d{1,2}(?:\.\d{1,6})?)\d*)?\x20*(?:[Zz]|[+-]\d{2}:?\d{2})?)?"
_YEAR_FIRST = full(r"(\d{4})(?:([-/.])(\d{1,2})\2(\d{1,2})|年(\d{1,2})月(\d{1,2})日)" + _TIME)
_YEAR_LAST = full(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})" + _TIME)
_COMPACT = full(r"(\d{4})(\d{2})(\d{2})")
_STRPTIME = {"%Y": "y", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%f": "SSSSSS", "%y": "yy", "%%": "%"}


def java_pattern(strptime: str) -> str:
    """A strptime format as a pattern of Spark: letters are quoted, and digits that touch get fixed widths."""
    tight = "%Y%m" in strptime or "%m%d" in strptime or "%H%M" in strptime
    names = _STRPTIME | {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"} if tight else _STRPTIME
    parts = re.split(r"(%.|[^\W\d_]+)", strptime)
    return "".join(names.get(x, f"'{x}'" if x.isalpha() else x) for x in parts)


def _iso(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, pattern, to), r"[\x20:]+\z", "").try_cast("timestamp_ntz")


def parse(c: Column, day_first: bool = True, formats: tuple[str, ...] | list[str] = ()) -> Column:
    """The wall-clock time as TIMESTAMP_NTZ, or null: own formats first, then year-month-day in all its spellings, then the order of `day_first`.

    One pattern turns a spelling into ISO form, which is cast; so a text that fits no pattern costs no exception.
    """
    d, m = ("$1", "$3") if day_first else ("$3", "$1")

    def value(c: Column) -> Column:
        known = (
            F.when(c.rlike(_YEAR_FIRST), _iso(c, _YEAR_FIRST, "$1-$3$5-$4$6 $7:$8"))
            .when(c.rlike(_COMPACT), _iso(c, _COMPACT, "$1-$2-$3"))
            .when(c.rlike(_YEAR_LAST), _iso(c, _YEAR_LAST, f"$4-{m}-{d} $5:$6"))
        )
        own = [F.try_to_timestamp(c, F.lit(java_pattern(f))).cast("timestamp_ntz") for f in formats]
        return F.coalesce(*own, known) if own else F.when(c.rlike(GATE), known)

    return once(trim_blank(half_width(c)), value)


def truncate(c: Column, granularity: str) -> Column:
    """To the day or the minute; other granularities keep all."""
    if granularity == "date":
        return c.cast("date").cast("timestamp_ntz")
    return F.date_trunc("minute", c).cast("timestamp_ntz") if granularity == "minute" else c


def seconds_apart(a: Column, b: Column) -> Column:
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / 1e6
