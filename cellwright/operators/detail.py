"""The table of differing cells, and roll-ups of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright import models as m

COLUMNS = ["__pair_id", "__key", "__b_row", "__a_row", "column_name", "column_type", "column_notes", "before_raw", "after_raw", "before_norm", "after_norm", "status", "abs_diff", "rel_diff"]


def exploded(cells: DataFrame, *keep: str | Column) -> DataFrame:
    """One row for each cell `c` of the matched rows, with the columns of `keep`.

    An outer generator after an explicit filter: for an inner one Spark infers a filter on the array,
    pushes it into the join, and classifies every cell twice.
    """
    matched = cells.filter(F.col("__b_row").isNotNull() & F.col("__a_row").isNotNull())
    return matched.select(*keep, F.explode_outer("cells").alias("c")).filter(F.col("c").isNotNull())


def diff_detail(cells: DataFrame, *more: Column) -> DataFrame:
    """One row for each cell that is not equal, with the row's columns `more`. The filter stays above the generator, so no cell is classified twice."""
    long = exploded(cells, *COLUMNS[:4], *more)
    names = [f"`{n}`" for n in long.columns[4:-1]]
    return long.select(*COLUMNS[:4], *names, "c.*").filter(F.col("status") != m.EQUAL).select(*COLUMNS, *names)


def severity(status: Column) -> Column:
    out = F.lit(len(m.SEVERITY))
    for name, rank in m.SEVERITY.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def label(status: Column) -> Column:
    out = status
    for name, text in m.LABELS.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def shown(detail: DataFrame, statuses: list[str] | None = None, column: str | None = None, by_size: bool = True, most: int | None = None, chars: int | None = None, masked: list[str] | None = None) -> DataFrame:
    """The detail for a report: filtered, ordered (severest first, then by size or by row), cut to `most` rows and `chars` characters."""
    if statuses:
        detail = detail.filter(F.col("status").isin(*statuses))
    if column:
        detail = detail.filter(F.col("column_name") == column)
    rank = severity(F.col("status"))
    first = [rank, F.desc_nulls_last("abs_diff"), F.col("column_name")] if by_size else [rank, F.asc_nulls_last("__b_row"), F.col("column_name")]
    detail = detail.orderBy(*first, F.asc_nulls_last("__b_row"), F.asc_nulls_last("__a_row"))
    if most:
        detail = detail.limit(most)
    hide = F.col("column_name").isin(*masked) if masked else F.lit(False)
    for c, none in (("before_raw", "<NULL>"), ("after_raw", "<NULL>"), ("before_norm", ""), ("after_norm", "")):
        value = F.coalesce(c, F.lit(none))
        detail = detail.withColumn(c, F.when(hide, F.lit("***")).otherwise(F.left(value, F.lit(chars)) if chars else value))
    return detail


def cell_counts(cells: DataFrame) -> DataFrame:
    """column_name, status, cells: counts of all cells, the equal ones too."""
    return exploded(cells).groupBy("c.column_name", "c.status").agg(F.count("*").alias("cells"))


def format_breakdown(detail: DataFrame) -> DataFrame:
    """By column: FORMAT_ONLY cells, and how many differ in case only, in white space only, or are numbers spelt differently."""
    bare = lambda c: F.regexp_replace(c, r"[\s 　]+", "")
    case = ~F.col("before_raw").eqNullSafe(F.col("after_raw")) & F.lower("before_raw").eqNullSafe(F.lower("after_raw"))
    space = ~F.col("before_raw").eqNullSafe(F.col("after_raw")) & bare("before_raw").eqNullSafe(bare("after_raw"))
    return (
        detail.filter(F.col("status") == m.FORMAT_ONLY)
        .groupBy("column_name")
        .agg(F.count("*").alias("total"), F.count_if(case).alias("case_only"), F.count_if(space).alias("whitespace_only"), F.count_if(F.col("column_type") == m.NUMERIC).alias("numeric_format"))
    )


def column_summary(counts: DataFrame, matched: Column | int) -> DataFrame:
    """By column: cells of each status, equal ones from the matched rows, and rates."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("cells"))), F.lit(0)).alias(s.lower())
    wide = counts.groupBy("column_name").agg(*[n(s) for s in m.SEVERITY])
    severe = F.col("value_diff") + F.col("null_mismatch") + F.col("type_mismatch")
    total = matched if isinstance(matched, Column) else F.lit(matched)
    return wide.select("column_name", total.cast("long").alias("matched"), "equal", "format_only", "value_diff", "null_mismatch", "type_mismatch", severe.alias("severe"), F.try_divide(severe, total).alias("severe_rate"), F.try_divide(F.col("format_only"), total).alias("format_rate"))
