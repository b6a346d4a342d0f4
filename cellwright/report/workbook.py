"""The report as an Excel workbook."""

from __future__ import annotations

from cellwright import models as m
from cellwright.plans.engine import Result
from cellwright.report import data
from cellwright.sources import excel

_FILLS = {m.TYPE_MISMATCH: ("F4CCCC", 0), m.VALUE_DIFF: ("FCE5CD", 1), m.NULL_MISMATCH: ("FFF2CC", 2), m.FORMAT_ONLY: ("D9EAD3", 3)}


def write(result: Result, path: str) -> None:
    c = result.config.report
    columns = [list(r.row().values()) for r in result.columns]
    sheets: list[tuple[str, object]] = [("Overview", [["measure", "value"], *[[n, v if isinstance(v, (int, float)) else str(v)] for n, v in data.verdict(result)]])]
    if columns:
        sheets.append(("Columns", [list(result.columns[0].row()), *columns]))
    if result.stats.severe or result.stats.format_only:

        def details():
            yield data.DETAIL
            for r in data.detail_rows(result, c.excel_max_rows, chars=c.excel_max_cell_chars):
                yield [*r[:4], (m.LABELS[r[4]], _FILLS[r[4]][1]), *r[5:]]

        sheets.append(("Differences", details()))
    for which, n, name in (("b", result.stats.only_in_before, "Only before"), ("a", result.stats.only_in_after, "Only after")):
        if n:
            head, body = data.one_sided(result, which)
            sheets.append((name, [head, *body]))
    if result.anomalies:
        sheets.append(("Anomalies", [["level", "category", "title", "column", "detail", "value", "count"], *[[a.level, a.category, a.title, a.column, a.detail, a.value, a.count] for a in result.anomalies]]))
    if result.stats.only_before_columns or result.stats.only_after_columns:
        sheets.append(("Schema", [["column", "only"], *[[x, "before"] for x in result.stats.only_before_columns], *[[x, "after"] for x in result.stats.only_after_columns]]))
    if result.warnings:
        sheets.append(("Warnings", [["warning"], *[[w] for w in result.warnings]]))
    excel.write(path, sheets, tuple(colour for colour, _ in _FILLS.values()))
