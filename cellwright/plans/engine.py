"""The comparison of two snapshots from end to end."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.config import Config
from cellwright.functions.classify import ColumnPlan, plan
from cellwright.models import Anomaly, ColumnProfile, ColumnResult, Stats
from cellwright.operators import align, anomaly, detail, keys, profile, rows
from cellwright.sources.load import Loaded, load


def session(config: Config | None = None) -> SparkSession:
    """The active session, or a local one with settings that fit comparisons."""
    if active := SparkSession.getActiveSession():
        return active
    config = config or Config()
    b = SparkSession.builder.appName("cellwright").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # the window by key and the join by (key, rank) then share one exchange a side
    b = b.config("spark.sql.requireAllClusterKeysForCoPartition", "false").config("spark.ui.showConsoleProgress", "false")
    if "MASTER" not in os.environ and "SPARK_REMOTE" not in os.environ:
        b = b.master(f"local[{config.threads or '*'}]")
    if config.memory_limit:
        b = b.config("spark.driver.memory", config.memory_limit.lower().replace("gb", "g").replace("mb", "m"))
    if config.temp_dir:
        b = b.config("spark.local.dir", config.temp_dir)
    return b.getOrCreate()


@dataclass
class Result:
    """stats, columns and anomalies are small; the rest are tables."""

    config: Config
    stats: Stats
    columns: list[ColumnResult]
    anomalies: list[Anomaly]
    diff_detail: DataFrame
    row_status: DataFrame
    pairs: DataFrame
    plans: list[ColumnPlan]
    before_columns: list[str]
    after_columns: list[str]
    warnings: list[str] = field(default_factory=list)


class CompareEngine:
    """run() compares, inspect() suggests settings from the head of both sides, profile() describes a side."""

    def __init__(self, config: Config, spark: SparkSession | None = None, log: Callable[[str], None] | None = None) -> None:
        self.config, self.spark, self.log = config, spark or session(config), log or (lambda _: None)
        self._profiles: dict[tuple, list[ColumnProfile]] = {}
        self._kept: list[DataFrame] = []

    def close(self, cleanup: bool = True) -> None:
        if cleanup:
            for df in self._kept:
                df.unpersist()
        self._kept.clear()
        self._profiles.clear()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table under the workspace folder, where one is set and intermediates are kept; else a checkpoint, where the cluster names a
        folder for them; else a cached table. The first two also keep the plans of what follows small."""
        if self.config.work_db and self.config.keep_intermediate:
            path = f"{self.config.work_db.rstrip('/')}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        if self.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            return df.checkpoint()
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def load(self, limit: int | None = None) -> tuple[Loaded, Loaded]:
        self.log("loading")
        return load(self.spark, self.config.before, "before", limit), load(self.spark, self.config.after, "after", limit)

    def profile(self, side: Loaded, columns: list[str] | None = None, names: dict[str, str] | None = None) -> list[ColumnProfile]:
        at = (id(side), tuple(columns or side.columns))
        if at not in self._profiles:
            side.row_count = side.df.count() if side.row_count is None else side.row_count
            self._profiles[at] = profile.profile(side.df, columns or side.columns, self.config, side.row_count, names)
        return self._profiles[at]

    def compare(self, before: DataFrame, after: DataFrame) -> Result:
        """run() on two DataFrames: their columns are cast to text and their rows numbered; what needs a shuffle is kept first."""
        from cellwright.sources.rowid import with_row_id
        from cellwright.sources.text import as_text

        for df, side in ((before, "before"), (after, "after")):
            align.guard(df.columns, side)
        numbered = lambda df, side: with_row_id(as_text(df), keep=lambda x: self._keep(x, side))
        return self._run(*(Loaded(numbered(df, side), df.columns, "", "frame") for df, side in ((before, "before"), (after, "after"))))

    def run(self) -> Result:
        return self._run(*self.load())

    def _run(self, before: Loaded, after: Loaded) -> Result:
        c = self.config
        warnings = [f"before: {w}" for w in before.warnings] + [f"after: {w}" for w in after.warnings]
        lined = align.align(c, before.columns, after.columns)
        warnings += lined.warnings
        for side, name in ((before, "before"), (after, "after")):
            if side.kind in ("csv", "json", "excel"):  # parsed once, not by every aggregate
                few = side.df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism  # such files may not be split
                side.df = self._keep(side.df.repartition(self.spark.sparkContext.defaultParallelism) if few else side.df, name)
        self.log("profiling")
        of = dict(lined.pairs)
        with ThreadPoolExecutor(2) as pool:  # the sides' jobs share the cluster
            found = pool.submit(self.profile, after, [a for _, a in lined.pairs], {a: b for b, a in lined.pairs})
            b_profiles = self.profile(before, [b for b, _ in lined.pairs])
        a_profiles = [ColumnProfile(b, p.measures) for (b, _), p in zip(lined.pairs, found.result(), strict=True)]
        before.row_count = before.df.count() if before.row_count is None else before.row_count
        after.row_count = after.df.count() if after.row_count is None else after.row_count
        key_columns, mode, more = keys.resolve(c, before.df, after.df, lined.pairs, b_profiles)
        warnings += more
        self.log(f"matching by {', '.join(key_columns) or 'row index'}")
        ignored = {r.name for r in c.columns if r.ignore or r.type == m.IGNORE}
        plans = []
        for (b, a), bp, ap in zip(lined.pairs, b_profiles, a_profiles, strict=True):
            if b not in key_columns and b not in ignored:
                kind, granularity, note = profile.infer(c, b, bp, ap)
                plans.append(plan(c, b, a, kind, granularity, note))
        index = F.col("__row_id").cast("string")
        b_key = keys.key(key_columns, c.key_options) if key_columns else index
        a_key = keys.key([of[k] for k in key_columns], c.key_options) if key_columns else index
        b_side, a_side = rows.side(before.df, b_key, before.columns, "b"), rows.side(after.df, a_key, after.columns, "a")
        b_dup, a_dup = (rows.duplicate_groups(s.select("__key")) for s in (b_side, a_side))
        n_dup = (b_dup.count(), a_dup.count()) if key_columns else (0, 0)
        repeated = c.key_options.meet_all and n_dup != (0, 0)
        pairs = rows.paired(b_side, a_side, unique=n_dup == (0, 0), hot_keys=True, every=repeated)
        self.log("comparing")
        cells = self._keep(rows.with_cells(pairs, plans), "cells")
        status, diff = rows.row_status(cells, by_key=repeated), detail.diff_detail(cells)
        if c.work_db and c.keep_intermediate:
            status, diff = self._keep(status, "row_status"), self._keep(diff, "diff_detail")
        status.createOrReplaceTempView("row_status")
        diff.createOrReplaceTempView("diff_detail")
        self._views(cells, key_columns, repeated)
        self.log("summarising")
        with ThreadPoolExecutor(3) as pool:  # three small results of the same table, asked for together
            jobs = [pool.submit(x.collect) for x in (status.groupBy("row_status").count(), detail.cell_counts(cells), detail.format_breakdown(diff))]
            by_row, counts, breakdown = (j.result() for j in jobs)
        by_row = {r["row_status"]: r["count"] for r in by_row}
        counts = {(r["column_name"], r["status"]): r["cells"] for r in counts}
        totals = {x: sum(n for (_, status), n in counts.items() if status == x) for x in m.SEVERITY}
        stats = Stats(
            before.row_count, after.row_count, by_row, totals, dict(zip(("before", "after"), n_dup, strict=True)), len(plans), key_columns, mode,
            {"before": lined.only_before, "after": lined.only_after}, c.report.treat_format_only_as_diff,
        )
        columns = self._columns(before, lined, key_columns, ignored, plans, counts, stats, b_profiles, a_profiles)
        self.log("looking for anomalies")
        found = []
        if c.anomaly.enabled:
            top = lambda d: [(r["__key"], r["rows"]) for r in d.orderBy(F.desc("rows"), "__key").limit(5).collect()]
            ends = lambda which: [r["__key"] for r in rows.one_sided(pairs, which, [], c.anomaly.max_examples).collect()]
            duplicates = {"before": top(b_dup) if n_dup[0] else [], "after": top(a_dup) if n_dup[1] else []}
            unmatched = {"before": ends("b") if stats.only_in_before else [], "after": ends("a") if stats.only_in_after else []}
            breakdown = [r.asDict() for r in breakdown]
            found = anomaly.detect(anomaly.Evidence(c, stats, plans, before.df, after.df, {p.column: p for p in b_profiles}, {p.column: p for p in a_profiles}, breakdown, duplicates, unmatched))
        return Result(c, stats, columns, found, diff, status, pairs, plans, before.columns, after.columns, warnings)

    def _views(self, cells: DataFrame, key_columns: list[str], by_key: bool = False) -> None:
        """v_row and v_diff: the same with the key columns' values, which the rows carry along."""
        named = [F.coalesce(F.col("b")[k], F.col("a")[self.config.after_name(k)]).alias(f"key_{k}") for k in key_columns]
        rows.row_status(cells, *named, by_key=by_key).createOrReplaceTempView("v_row")
        detail.diff_detail(cells, *named).createOrReplaceTempView("v_diff")

    def _columns(self, before, lined, key_columns, ignored, plans, counts, stats, b_profiles, a_profiles) -> list[ColumnResult]:
        of, by_plan = dict(lined.pairs), {p.before: p for p in plans}
        bp, ap = {p.column: p for p in b_profiles}, {p.column: p for p in a_profiles}
        out = []
        for b in before.columns:
            if b not in of:
                out.append(ColumnResult(b, None, "only_before"))
                continue
            r = ColumnResult(b, of[b], "key" if b in key_columns else "ignored" if b in ignored else "compared", sides=(bp[b], ap[b]))
            if p := by_plan.get(b):
                r.type, r.notes, r.matched = p.type, p.notes, stats.matched
                r.cells = {x: counts.get((b, x), 0) for x in m.SEVERITY}
            out.append(r)
        return out + [ColumnResult(a, a, "only_after") for a in lined.only_after]

    def inspect(self, preview_rows: int = 20_000) -> dict:
        """Suggestions from the first rows of both sides; the full run decides anew."""
        before, after = self.load(preview_rows)
        lined = align.align(self.config, before.columns, after.columns)
        b_profiles = self.profile(before, [b for b, _ in lined.pairs])
        a_profiles = self.profile(after, [a for _, a in lined.pairs], {a: b for b, a in lined.pairs})
        try:
            key_columns, mode, warnings = keys.resolve(self.config, before.df, after.df, lined.pairs, b_profiles)
        except ValueError as e:
            key_columns, mode, warnings = [], "none", [str(e)]
        columns = []
        for (b, a), x, y in zip(lined.pairs, b_profiles, a_profiles, strict=True):
            kind, granularity, note = profile.infer(self.config, b, x, y)
            columns.append({"before": b, "after": a, "type": kind, "granularity": granularity, "note": note, "before_distinct": x.distinct, "after_distinct": y.distinct, "before_null_rate": x.null_rate, "after_null_rate": y.null_rate, "sample": [x.min_value, x.max_value]})
        return {"rows": {"before": before.row_count or 0, "after": after.row_count or 0}, "columns": columns, "only_before": lined.only_before, "only_after": lined.only_after, "keys": key_columns, "key_mode": mode, "warnings": before.warnings + after.warnings + lined.warnings + warnings}


