"""Row keys: the key expression, uniqueness, detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.config import Config, KeyOptions, NumericOptions
from cellwright.functions import numbers, text
from cellwright.models import ColumnProfile

# Names that suggest a key.
_NAMES = [
    re.compile(r"^(id|pk|uuid|guid)$", re.I),
    re.compile(r"(_id|_key|_no|_code|_sn|编号|号码|单号|序号|主键|编码|代码)$", re.I),
    re.compile(r"^(id_|key_|code_|no_)", re.I),
    re.compile(r"号$"),
]


def named_like_key(column: str) -> bool:
    return any(p.search(column) for p in _NAMES)


def part(c: Column, o: KeyOptions) -> Column:
    """One column's share of the key, normalised."""
    if o.fullwidth_to_halfwidth:
        c = text.half_width(c)
    if o.trim:
        c = text.strip_space(c)
    if o.numeric_normalize:
        n = numbers.parse(c, NumericOptions())
        c = F.coalesce(F.when(n == F.floor(n), F.format_string("%.0f", n)).otherwise(n.cast("string")), c)
    return F.lower(c) if o.case_insensitive else c


def key(columns: list[str], o: KeyOptions) -> Column:
    """The key's text: parts joined by U+001F, nulls as U+0000 (so null keys meet each other)."""
    return F.concat_ws("\x1f", *[F.coalesce(part(F.col(f"`{c}`").cast("string"), o), F.lit("\x00")) for c in columns])


def uniqueness(df: DataFrame, columns: list[str], o: KeyOptions) -> tuple[int, int, int]:
    """(rows, distinct keys without nulls, rows with a null part). Keys are grouped twice, so a frequent one stays a partial count."""
    parts = [part(F.col(f"`{c}`").cast("string"), o) for c in columns]
    null = F.lit(False)
    for p in parts:
        null = null | p.isNull() | (p == "")
    groups = df.select(key(columns, o).alias("k"), null.alias("n")).groupBy("k", "n").agg(F.count("*").alias("c"))
    r = groups.agg(F.sum("c"), F.count_if(~F.col("n")), F.sum(F.when(F.col("n"), F.col("c")))).first()
    return r[0] or 0, r[1] or 0, r[2] or 0


def is_unique(df: DataFrame, columns: list[str], o: KeyOptions) -> bool:
    rows, distinct, null = uniqueness(df, columns, o)
    return rows > 0 and null == 0 and distinct == rows


def detect(df: DataFrame, profiles: list[ColumnProfile], o: KeyOptions) -> list[str]:
    """A unique key among the columns without nulls, or [].

    Tried alone are the columns whose distinct values make half of the rows: those named like a key as they stand, then
    all, the one of most values first. Then two to four columns named like a key are tried
    together. Each trial costs one exact aggregate.
    """
    whole = [p for p in profiles if p.total and not p.nulls]
    many = [p for p in whole if p.distinct >= 0.5 * p.total]
    named = [p.column for p in whole if named_like_key(p.column)]
    trials = [[p.column] for p in many if p.column in named]
    trials += [[p.column] for p in sorted(many, key=lambda p: (p.distinct, p.column), reverse=True) if p.column not in named]
    trials += [named] * (2 <= len(named) <= 4)
    return next((columns for columns in trials if is_unique(df, columns, o)), [])


def resolve(config: Config, before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]], profiles: list[ColumnProfile]) -> tuple[list[str], str, list[str]]:
    """(key columns before, mode, warnings); mode: configured, detected or row_index. ValueError where no key is left."""
    of, warnings = dict(pairs), []
    if config.keys:
        if lost := [k for k in config.keys if k not in of]:
            raise ValueError(f"key columns not on both sides: {', '.join(lost)}; common columns: {', '.join(of) or 'none'}")
        return list(config.keys), "configured", warnings
    o = config.key_options
    if o.auto_detect:
        known = [p for p in profiles if p.column in of]
        if found := detect(before, known, o):
            if not is_unique(after, [of[k] for k in found], o):
                warnings.append(f"the detected key {', '.join(found)} is not unique after")
            return found, "detected", warnings
    if o.use_row_index_if_no_key:
        return [], "row_index", [*warnings, "no key: rows are compared by their position"]
    raise ValueError("no key is set and none was found; name key columns, or allow the row index")
