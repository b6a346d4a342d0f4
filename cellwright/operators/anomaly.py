"""Detectors of suspicious changes between two snapshots."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.config import AnomalyOptions, Config
from cellwright.functions import text
from cellwright.functions.classify import ColumnPlan
from cellwright.models import Anomaly, ColumnProfile, Stats

#: Up to so many rows a column's values are sorted by one task; beyond, only those near the quartiles are. Both are exact.
ONE_TASK = 2_000_000


def _numbers(df: DataFrame, plans: list[tuple[str, ColumnPlan]]) -> DataFrame:
    cells = [F.struct(F.lit(p.before).alias("column"), p.value(F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").cast("string")).alias("v")) for c, p in plans]
    return df.select(F.inline(F.array(*cells))).filter("v is not null")


def _quartiles(long: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """column, q1, median, q3, exact and interpolated, of (column, v) rows of any number.

    A sketch brackets each quartile by values whose ranks are off by 1/accuracy of the rows at most; what
    lies below a bracket is counted, and only the values inside, a few thousandths, are put in order.
    """
    shares = (0.25, 0.5, 0.75)
    ends = [min(1.0, max(0.0, s + side * 2 / accuracy)) for s in shares for side in (-1, 1)]
    bounds = long.groupBy("column").agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*[F.lit(x) for x in ends]), accuracy).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") <= accuracy  # a bracket would not span two ranks
    which = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(s) * (F.col("n") - 1)).alias("at"), F.when(few, F.col("least")).otherwise(F.get("e", F.lit(2 * k))).alias("lo"), F.when(few, F.col("most")).otherwise(F.get("e", F.lit(2 * k + 1))).alias("hi")) for k, s in enumerate(shares)]))
    wanted = F.broadcast(bounds.select("column", which.alias("w")).select("column", "w.*"))  # three rows a column
    met = long.join(wanted, "column").filter("v <= hi")
    counted = met.groupBy("column", "k", "at", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    before = Window.partitionBy("column", "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).filter("v is not null")
    holds = lambda at: F.max(F.when((F.col("first") <= at) & (at < F.col("first") + F.col("c")), F.col("v")))
    low, high = holds(F.floor("at")), holds(F.ceil("at"))
    found = placed.groupBy("column", "k").agg((low + (high - low) * F.max(F.col("at") - F.floor("at"))).alias("q"))
    return found.groupBy("column").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(("q1", "median", "q3"))])


def numeric_stats(df: DataFrame, plans: list[tuple[str, ColumnPlan]], one_task: bool = True) -> DataFrame:
    """column, n, mean, median, q1, q3, min, max of numeric columns; plans: (column's name in df, plan). one_task: whether a column's values may be sorted by one task, in one scan."""
    long = _numbers(df, plans)
    plain = [F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")]
    if not one_task:
        return long.groupBy("column").agg(*plain).join(F.broadcast(_quartiles(long)), "column").select("column", "n", "mean", "median", "q1", "q3", "min", "max")
    out = long.groupBy("column").agg(*plain, F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return out.select("column", "n", "mean", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"), "min", "max")


def outliers(df: DataFrame, plans: list[tuple[str, ColumnPlan]], stats: DataFrame, multiplier: float = 3.0) -> DataFrame:
    """column, n, outliers: values beyond the quartiles by more than `multiplier` times their distance. stats has one row a column, and is broadcast."""
    long = _numbers(df, plans)
    reach = multiplier * (F.col("q3") - F.col("q1"))
    beyond = (F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)
    return long.join(F.broadcast(stats.select("column", "q1", "q3")), "column").groupBy("column").agg(F.count("*").alias("n"), F.count_if(beyond).alias("outliers"))


def categories(df: DataFrame, plans: list[tuple[str, ColumnPlan]], most: int = 60) -> DataFrame:
    """column, vals: the sorted values (no null-equivalents) of text columns; vals is null for more than `most`, and a column of nulls has no row."""
    cells = []
    for c, p in plans:
        raw = F.col(f"`{c}`").cast("string")
        norm = p.norm(raw)
        cells.append(F.struct(F.lit(p.before).alias("column"), F.when(~text.is_null(raw, norm, p.null_tokens), norm).alias("v")))
    values = df.select(F.inline(F.array(*cells))).filter("v is not null").distinct()
    sizes = values.groupBy("column").count()
    few = sizes.filter(F.col("count") <= most).select("column")
    found = values.join(F.broadcast(few), "column", "left_semi").groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("vals"))
    return found.union(sizes.filter(F.col("count") > most).select("column", F.lit(None).cast("array<string>")))


def category_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """column, added, missing, n_before, n_after from two results of `categories`; a side that has nulls only has no values."""
    side = lambda df, n: df.select("column", F.struct("vals").alias(n))
    both = side(before, "x").join(side(after, "y"), "column", "full_outer").filter("(x is null or x.vals is not null) and (y is null or y.vals is not null)")
    none = F.array().cast("array<string>")
    both = both.select("column", F.coalesce("x.vals", none).alias("b"), F.coalesce("y.vals", none).alias("a"))
    return both.select("column", F.array_except("a", "b").alias("added"), F.array_except("b", "a").alias("missing"), F.size("b").alias("n_before"), F.size("a").alias("n_after"))


def schema_change(stats: Stats) -> list[Anomaly]:
    out = []
    for names, side, title in ((stats.only_before_columns, "before", "columns were removed"), (stats.only_after_columns, "after", "columns were added")):
        if names:
            out.append(Anomaly("error", "schema_change", title, "schema", detail=f"only {side}: {', '.join(names[:20])}", count=len(names), examples=names[:20]))
    return out


def row_count_change(stats: Stats) -> list[Anomaly]:
    if not stats.row_delta:
        return []
    small = abs(stats.row_delta_rate) < 0.05
    return [Anomaly("info" if small else "warn", "row_count_change", "the number of rows changed", detail=f"{stats.before_rows} before, {stats.after_rows} after ({stats.row_delta:+d}, {stats.row_delta_rate:+.2%})", value=stats.row_delta_rate, count=abs(stats.row_delta))]


def key_anomalies(stats: Stats, duplicates: dict[str, list[tuple[str, int]]], unmatched: dict[str, list[str]], may_repeat: bool = False) -> list[Anomaly]:
    """duplicates and unmatched: examples by side, "before" and "after"."""
    out = []
    for side, n in stats.duplicates.items():
        if n and not may_repeat:
            shown = [f"{k} ({c} rows)" for k, c in duplicates.get(side, [])]
            out.append(Anomaly("error", "duplicate_key", f"keys occur more than once {side}", "key", detail=", ".join(shown), count=n, examples=shown))
    for side, n in (("before", stats.only_in_before), ("after", stats.only_in_after)):
        if n:
            shown = unmatched.get(side, [])
            out.append(Anomaly("warn", "unmatched_key", f"keys are only {side}", "key", detail=", ".join(shown[:20]), count=n, examples=shown))
    return out


def format_changes(breakdown: list[dict]) -> list[Anomaly]:
    """breakdown: rows of detail.format_breakdown."""
    total = sum(r["total"] for r in breakdown)
    if not total:
        return []
    top = sorted(breakdown, key=lambda r: (-r["total"], r["column_name"]))[:8]
    parts = ", ".join(f"{n}: {sum(r[k] for r in breakdown)}" for n, k in (("case", "case_only"), ("white space", "whitespace_only"), ("numbers", "numeric_format")))
    return [Anomaly("info", "case_only_change", "cells differ in format only", detail=f"{parts}; most in {', '.join(f'{r["column_name"]} ({r["total"]})' for r in top)}", count=total)]


def null_rate_change(o: AnomalyOptions, b: ColumnProfile, a: ColumnProfile) -> list[Anomaly]:
    delta = a.null_rate - b.null_rate
    if abs(delta) < o.null_rate_delta:
        return []
    grave = a.null_rate >= 0.5 or (abs(delta) / b.null_rate >= 0.5 if b.null_rate else a.null_rate >= o.null_rate_delta)
    return [Anomaly("warn" if grave else "info", "null_rate_change", "the share of nulls changed", "column", b.column, f"{b.null_rate:.2%} before, {a.null_rate:.2%} after", delta)]


def distinct_change(o: AnomalyOptions, b: ColumnProfile, a: ColumnProfile) -> list[Anomaly]:
    ratio = abs(a.distinct - b.distinct) / max(b.distinct, a.distinct, 1)
    if ratio < o.distinct_change_ratio:
        return []
    return [Anomaly("info", "distribution_shift", "the number of distinct values changed", "column", b.column, f"{b.distinct} before, {a.distinct} after", ratio)]


def parse_failures(o: AnomalyOptions, plan: ColumnPlan, profiles: list[tuple[str, ColumnProfile]]) -> list[Anomaly]:
    """profiles: (side, profile). Columns of another type are told of only where four fifths of their values parse."""
    out = []
    for side, p in profiles:
        for kind, ok, gate in ((m.NUMERIC, p.numeric_ok, True), (m.DATE, p.date_ok, p.total and p.date_gate >= 0.3 * max(p.non_null, 1))):
            if not p.non_null or not gate or (plan.type != kind and (plan.type in (m.NUMERIC, m.DATE) or ok < 0.8 * p.non_null)):
                continue
            ratio = (p.non_null - ok) / p.non_null
            if ratio >= o.numeric_parse_failure_ratio:
                out.append(Anomaly("warn" if ratio >= 0.05 else "info", f"{kind}_parse_failure", f"values {side} cannot be read as {kind}", "column", plan.before, f"{p.non_null - ok} of {p.non_null} ({ratio:.2%}) {side}", ratio, p.non_null - ok))
    return out


def outlier_anomalies(rows: list[dict], side: str) -> list[Anomaly]:
    """rows: those of `outliers`."""
    return [
        Anomaly("info", "numeric_outlier", f"outliers {side}", "column", r["column"], f"{r['outliers']} of {r['n']} values {side}", r["outliers"] / r["n"], r["outliers"])
        for r in rows
        if r["n"] and r["outliers"] and (r["outliers"] >= 5 or r["outliers"] >= 0.001 * r["n"])
    ]


def mean_shift(o: AnomalyOptions, column: str, before: float | None, after: float | None) -> list[Anomaly]:
    if before is None or after is None:
        return []
    shift = abs(after - before) / abs(before) if before else float(after != 0)
    if shift < o.mean_shift_ratio:
        return []
    return [Anomaly("warn", "distribution_shift", "the mean moved", "column", column, f"{before:.6g} before, {after:.6g} after", shift)]


def category_anomalies(o: AnomalyOptions, row: dict) -> list[Anomaly]:
    """row: one of `category_changes`."""
    out = []
    for category, level, values, title in (("new_category", "info", row["added"], "new values"), ("missing_category", "info", row["missing"], "values are gone")):
        if values:
            out.append(Anomaly(level, category, title, "column", row["column"], ", ".join(values[: o.category_max_examples]), count=len(values), examples=values[: o.category_max_examples]))
    if row["n_before"] > 1 and row["n_after"] == 1:
        out.append(Anomaly("warn", "constant_collapse", "only one value is left", "column", row["column"], f"{row['n_before']} values before", count=row["n_before"]))
    return out


@dataclass
class Evidence:
    """What the detectors look at."""

    config: Config
    stats: Stats
    plans: list[ColumnPlan]
    before: DataFrame
    after: DataFrame
    before_profiles: dict[str, ColumnProfile]
    after_profiles: dict[str, ColumnProfile]
    breakdown: list[dict]
    duplicates: dict[str, list[tuple[str, int]]]
    unmatched: dict[str, list[str]]


def detect(e: Evidence) -> list[Anomaly]:
    """All anomalies: schema, row count, keys, formats, then column by column. A handful of aggregates, whatever the number of columns."""
    o = e.config.anomaly
    if not o.enabled:
        return []
    out = schema_change(e.stats) + row_count_change(e.stats) + key_anomalies(e.stats, e.duplicates, e.unmatched, e.config.key_options.meet_all) + format_changes(e.breakdown)
    numeric = [p for p in e.plans if p.type == m.NUMERIC]
    texts = [p for p in e.plans if p.type in (m.STRING, m.BOOLEAN)]
    stats, beyond, kinds = {}, {}, {}

    def measure(side: str, df: DataFrame, name) -> None:
        named = [(name(p), p) for p in numeric]
        rows = e.stats.before_rows if side == "before" else e.stats.after_rows
        if named:
            stats[side] = {r["column"]: r.asDict() for r in numeric_stats(df, named, rows <= ONE_TASK).collect()}
        if stats.get(side) and o.outlier_enabled:
            quartiles = df.sparkSession.createDataFrame([(c, r["q1"], r["q3"]) for c, r in stats[side].items()], "column string, q1 double, q3 double")
            beyond[side] = {r["column"]: r.asDict() for r in outliers(df, named, quartiles, o.outlier_multiplier).collect()}

    def values(side: str, df: DataFrame, name) -> None:
        # columns of too many distinct values need not be asked for theirs
        few = [p for p in texts if max(e.before_profiles[p.before].distinct, e.after_profiles[p.before].distinct) <= 2 * o.category_max_distinct]
        if few:
            kinds[side] = categories(df, [(name(p), p) for p in few], o.category_max_distinct)

    sides = [("before", e.before, lambda p: p.before), ("after", e.after, lambda p: p.after)]
    with ThreadPoolExecutor(2) as pool:  # the sides' jobs share the cluster
        list(pool.map(lambda s: measure(*s), sides))
    changes = {}
    for s in sides:
        values(*s)
    if len(kinds) == 2:
        changes = {r["column"]: r.asDict() for r in category_changes(kinds["before"], kinds["after"]).collect()}
    for p in e.plans:
        b, a = e.before_profiles[p.before], e.after_profiles[p.before]
        out += null_rate_change(o, b, a) + distinct_change(o, b, a) + parse_failures(o, p, [("before", b), ("after", a)])
        for side in ("before", "after"):
            out += outlier_anomalies([beyond.get(side, {}).get(p.before)] if beyond.get(side, {}).get(p.before) else [], side)
        if p in numeric:
            out += mean_shift(o, p.before, *(stats[s].get(p.before, {}).get("mean") for s in ("before", "after")))
        if p.before in changes:
            out += category_anomalies(o, changes[p.before])
    return out
