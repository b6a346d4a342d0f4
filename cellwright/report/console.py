"""The report for a terminal."""

from __future__ import annotations

import unicodedata

from cellwright import models as m
from cellwright.plans.engine import Result
from cellwright.report import data


def width(text: str) -> int:
    """Cells a text takes on a terminal: East Asian wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def table(head: list[str], body: list[list[object]], most: int = 40) -> str:
    def cut(x: object) -> str:
        text = data.number(x).replace("\n", "⏎")
        while width(text) > most:
            text = text[:-1] if width(text[:-1]) <= most - 1 else text[: max(1, len(text) * most // (width(text) + 1))]
        return text

    cells = [head, *[[cut(x) for x in r] for r in body]]
    wide = [max(width(r[i]) for r in cells) for i in range(len(head))]
    lines = ["  ".join(c + " " * (w - width(c)) for c, w in zip(r, wide, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in wide), *lines[1:]])


def render(result: Result) -> str:
    c, s = result.config, result.stats
    out = [f"== {c.report.title} ==", f"before: {c.before.path}", f"after:  {c.after.path}", "", table(["measure", "value"], [list(x) for x in data.verdict(result)])]
    if s.only_before_columns or s.only_after_columns:
        out += ["", "Columns on one side", *[f"  - {x}" for x in s.only_before_columns], *[f"  + {x}" for x in s.only_after_columns]]
    if severe := data.top_columns(result):
        out += ["", "Columns that differ", table(["column", "type", "matched", "value", "null", "type?", "format", "rate"], [[r.column, r.type, r.matched, *(r.count(x) for x in (m.VALUE_DIFF, m.NULL_MISMATCH, m.TYPE_MISMATCH)), r.format_only, f"{r.row()['severe_rate']:.2%}"] for r in severe])]
    if form := data.top_columns(result, "format"):
        out += ["", "Columns with other formats", table(["column", "type", "format only"], [[r.column, r.type, r.format_only] for r in form])]
    if result.anomalies:
        out += ["", "Anomalies", *[f"  [{a.level}] {a.title}{': ' + a.column if a.column else ''} - {a.detail[:150]}" for a in result.anomalies]]
    if s.severe or s.format_only:
        samples = [[r[1], r[2], m.LABELS[r[4]], r[5], r[6]] for r in data.detail_rows(result, min(c.report.top_n, 40))]
        out += ["", "Examples", table(["key", "column", "status", "before", "after"], samples, 30)]
    if result.warnings:
        out += ["", "Warnings", *[f"  ! {w}" for w in result.warnings]]
    if c.work_db:
        out += ["", f"Tables are kept under {c.work_db} (cells, row_status, diff_detail)"]
    return "\n".join(out)
