"""The report in Markdown."""

from __future__ import annotations

import itertools

from cellwright import models as m
from cellwright.plans.engine import Result
from cellwright.report import data


def _cell(x: object) -> str:
    return data.number(x).replace("\\", "\\\\").replace("|", "\\|").replace("\r", "").replace("\n", "<br>")


def _table(head: list[str], body: list[list[object]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " - |" * len(head), *["| " + " | ".join(map(_cell, r)) + " |" for r in body], ""]


def render(result: Result) -> str:
    c, s, number = result.config, result.stats, itertools.count(1)
    out = [f"# {c.report.title}", "", f"`{c.before.path}` → `{c.after.path}`", "", f"## {next(number)}. Totals", "", *_table(["measure", "value"], [list(x) for x in data.verdict(result)])]
    if s.only_before_columns or s.only_after_columns:
        out += [f"## {next(number)}. Schema", "", *_table(["column", "only"], [[x, "before"] for x in s.only_before_columns] + [[x, "after"] for x in s.only_after_columns])]
    if severe := data.top_columns(result):
        out += [f"## {next(number)}. Columns that differ", "", *_table(["column", "type", "value differs", "null on one side", "unreadable", "format only", "rate"], [[r.column, r.type, *(r.count(x) for x in (m.VALUE_DIFF, m.NULL_MISMATCH, m.TYPE_MISMATCH)), r.format_only, f"{r.row()['severe_rate']:.2%}"] for r in severe])]
    if form := data.top_columns(result, "format"):
        out += [f"## {next(number)}. Columns with other formats", "", *_table(["column", "type", "format only", "note"], [[r.column, r.type, r.format_only, r.notes] for r in form])]
    if result.anomalies:
        out += [f"## {next(number)}. Anomalies", "", *_table(["level", "what", "column", "detail"], [[a.level, a.title, a.column, a.detail] for a in result.anomalies])]
    if s.severe or s.format_only:
        shown = [[r[1], r[2], m.LABELS[r[4]], r[5], r[6]] for r in data.detail_rows(result, c.report.markdown_max_rows)]
        out += [f"## {next(number)}. Differences", "", *_table(["key", "column", "status", "before", "after"], shown)]
    if result.warnings:
        out += ["## Warnings", "", *[f"- {w}" for w in result.warnings], ""]
    if c.work_db:
        out += ["## Tables", "", "```sql", f"SELECT * FROM parquet.`{c.work_db}/diff_detail` WHERE status <> 'FORMAT_ONLY'", "```", ""]
    return "\n".join(out)


def write(result: Result, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(result))
