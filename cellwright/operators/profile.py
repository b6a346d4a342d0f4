"""Profiles of columns, and the comparison types they suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.config import Config
from cellwright.functions import dates, numbers, text
from cellwright.models import ColumnProfile

# Fixed values.
LEADING_ZERO = r"\A[+-]?0[0-9]"


def _cell(raw: Column, column: str, name: str, config: Config) -> Column:
    """struct(column, raw, norm, is_null): what depends on the column's own rules."""
    both = F.struct(raw.alias("raw"), text.normalize(raw, config.strings(name)).alias("norm"))
    null = lambda x: text.is_null(x["raw"], x["norm"], config.null_tokens(name))
    return text.once(both, lambda x: F.struct(F.lit(column).alias("column"), x["raw"].alias("raw"), x["norm"].alias("norm"), null(x).alias("is_null")))


def _date(columns: list[tuple[str, str]], config: Config) -> Column:
    """Whether `raw` is a date, by the formats of its column; columns: (column, its name before)."""
    day_first, raw = config.compare.date.day_first, F.col("raw")
    # the built-in spellings all begin with a digit
    out = F.when(text.half_width(F.col("norm")).rlike(r"\A[0-9]+[-/.年]|\A[0-9]{8}"), dates.parse(raw, day_first))
    by_formats: dict[tuple, list[str]] = {}
    for c, name in columns:
        if own := tuple(config.date_formats(name)):
            by_formats.setdefault(own, []).append(c)
    for own, some in by_formats.items():
        out = F.when(F.col("column").isin(*some), dates.parse(raw, day_first, own)).otherwise(out)
    return out.isNotNull()


def profile_frame(df: DataFrame, columns: list[str], config: Config | None = None, approximate: bool = False, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each column: total, nulls, distinct, numeric_ok, leading_zero, max_digits, has_time, date_like, date_gate, date_ok, min_value, max_value.

    The columns are turned into rows in one scan; a column's counts are partial aggregates. Exact distinct
    values are grouped by (column, value) first, so many columns do not multiply the input. Distinct values,
    min and max are over normalised texts; the other counts leave null-equivalents out. names: the name
    before of each column, which rules go by.
    """
    config = config or Config()
    named = [(c, (names or {}).get(c, c)) for c in columns]
    # cells become rows first: what follows is one small expression for all columns, not one for each
    rows = df.select(F.inline(F.array(*[_cell(F.col(f"`{c}`").cast("string"), c, name, config) for c, name in named])))
    norm = F.col("norm")
    some = lambda c: ~F.col("is_null") & F.coalesce(c, F.lit(False))
    digits = F.length(F.regexp_replace(F.substring_index("norm", ".", 1), "[^0-9]+", ""))
    long = rows.select(
        "column", "norm", "is_null",
        some(numbers.parse(F.col("raw"), config.compare.numeric).isNotNull()).alias("num"),
        some(norm.rlike(LEADING_ZERO)).alias("zero"),
        F.when(~F.col("is_null"), digits).otherwise(0).alias("digits"),
        some(norm.contains(":") & norm.rlike(dates.HAS_TIME)).alias("time"),
        some(norm.rlike(dates.LIKE)).alias("like"),
        some(norm.rlike(dates.GATE)).alias("gate"),
        some(_date(named, config)).alias("date"),
    )
    count = lambda c: F.count_if(F.col(c))
    measures = [
        ("total", F.count("*"), F.sum("total")), ("nulls", count("is_null"), F.sum("nulls")), ("numeric_ok", count("num"), F.sum("numeric_ok")),
        ("leading_zero", count("zero"), F.sum("leading_zero")), ("max_digits", F.max("digits"), F.max("max_digits")), ("has_time", count("time"), F.sum("has_time")),
        ("date_like", count("like"), F.sum("date_like")), ("date_gate", count("gate"), F.sum("date_gate")), ("date_ok", count("date"), F.sum("date_ok")),
    ]
    if approximate:
        out = long.groupBy("column").agg(*[first.alias(n) for n, first, _ in measures], F.approx_count_distinct("norm", 0.02).alias("distinct"), F.min("norm").alias("min_value"), F.max("norm").alias("max_value"))
    else:
        values = long.groupBy("column", "norm").agg(*[first.alias(n) for n, first, _ in measures])
        out = values.groupBy("column").agg(*[then.alias(n) for n, _, then in measures], F.count("norm").alias("distinct"), F.min("norm").alias("min_value"), F.max("norm").alias("max_value"))
    kinds = {"max_digits": "int"}
    return out.select("column", *[F.col(c).cast(kinds.get(c, "long")).alias(c) for c in ("total", "nulls", "distinct", "numeric_ok", "leading_zero", "max_digits", "has_time", "date_like", "date_gate", "date_ok")], "min_value", "max_value")


def profile(df: DataFrame, columns: list[str], config: Config | None = None, rows: int | None = None, names: dict[str, str] | None = None, exact: bool = False) -> list[ColumnProfile]:
    """The profiles, in the order of the columns; distinct values are exact, unless a number of rows is configured above which they are estimated, and not `exact` asked for."""
    if not columns:
        return []
    config = config or Config()
    limit = None if exact else config.profile_exact_distinct_limit
    estimated = limit is not None and (df.count() if rows is None else rows) > limit
    found = {r["column"]: ColumnProfile(r["column"], {k: v for k, v in r.asDict().items() if k != "column"}) for r in profile_frame(df, columns, config, estimated, names).collect()}
    return [found.get(c, ColumnProfile(c)) for c in columns]


def samples(df: DataFrame, columns: list[str], most: int = 20) -> dict[str, list[str]]:
    """Up to `most` different values of each column, the least ones first; null and blank ones are left out."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    values = df.select(cells).filter("length(trim(v)) > 0").distinct()
    few = values.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy("v"))).filter(F.col("k") <= most)
    found = {r["column"]: r["v"] for r in few.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("v")).collect()}
    return {c: found.get(c, []) for c in columns}


def infer(config: Config, column: str, before: ColumnProfile, after: ColumnProfile) -> tuple[str, str, str]:
    """(type, granularity, note) of a column from both sides' profiles: by rule, else date, number or text."""
    rule, options = config.rule(column), config.compare
    both = lambda name: getattr(before, name) + getattr(after, name)
    filled = both("non_null")
    share = lambda name: both(name) / filled if filled else 0.0
    granularity = config.granularity(column)
    if granularity == "auto":
        granularity = "timestamp" if both("has_time") else "date"
    if rule and rule.type:
        return rule.type, granularity, "type set by a rule"
    if not filled:
        return m.STRING, granularity, "no values"
    if not options.detect_types:
        return m.STRING, granularity, "type detection is off"
    if options.date.enabled and share("date_ok") >= 0.98 and share("date_like") >= 0.9 and share("numeric_ok") < 0.98:
        return m.DATE, granularity, ""
    if share("numeric_ok") >= 0.98:
        if options.leading_zero_is_text and both("leading_zero"):
            return m.STRING, granularity, "numbers with leading zeros are codes"
        if max(before.max_digits, after.max_digits) > options.max_digits_for_number:
            return m.STRING, granularity, f"numbers of more than {options.max_digits_for_number} digits are codes"
        return m.NUMERIC, granularity, ""
    return m.STRING, granularity, ""
