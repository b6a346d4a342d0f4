"""What reports show, cut to bounded numbers of rows."""

from __future__ import annotations

from collections.abc import Iterator

from cellwright import models as m
from cellwright.operators import detail, rows
from cellwright.plans.engine import Result

DETAIL = ["row", "key", "column", "type", "status", "before", "after", "abs_diff", "rel_diff"]


def masked(result: Result) -> list[str]:
    return [p.before for p in result.plans if p.mask]


def number(x: object) -> str:
    if x is None:
        return ""
    if isinstance(x, float):
        return f"{x:.6g}"
    return f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def verdict(result: Result) -> list[tuple[str, object]]:
    s = result.stats
    out: list[tuple[str, object]] = [("verdict", "consistent" if s.consistent else "different"), ("before rows", s.before_rows), ("after rows", s.after_rows), ("row delta", s.row_delta), ("matched", s.matched)]
    out += [(f"rows {m.ROW_LABELS[x]}", s.rows.get(x, 0)) for x in m.ROW_LABELS]
    out += [(f"keys that occur more than once {x}", s.duplicates.get(x, 0)) for x in ("before", "after")]
    out += [("compared columns", s.compared_columns), ("cells", s.compared), *[(f"cells {m.LABELS[x]}", s.count(x)) for x in reversed(m.SEVERITY)], ("severe", s.severe)]
    return [*out, ("keys", ", ".join(s.keys) or "row index")]


def top_columns(result: Result, which: str = "severe") -> list[m.ColumnResult]:
    order = (lambda r: (-r.severe, -r.total, r.column)) if which == "severe" else (lambda r: (-r.format_only, r.column))
    return sorted((r for r in result.columns if getattr(r, "severe" if which == "severe" else "format_only")), key=order)[: result.config.report.top_n]


def detail_rows(result: Result, most: int | None, by_size: bool = True, chars: int | None = None) -> Iterator[list[object]]:
    """DETAIL rows, fetched partition by partition."""
    chars = result.config.report.max_cell_chars if chars is None else chars
    shown = detail.shown(result.diff_detail, by_size=by_size, most=most, chars=chars or None, masked=masked(result))
    for r in shown.toLocalIterator():
        yield [r["__b_row"], r["__key"].replace("\x1f", " | ").replace("\x00", "<NULL>"), r["column_name"], r["column_type"], r["status"], r["before_raw"], r["after_raw"], r["abs_diff"], r["rel_diff"]]


def one_sided(result: Result, which: str, most: int | None = None) -> tuple[list[str], list[list[object]]]:
    columns = (result.before_columns if which == "b" else result.after_columns)[:8]
    hidden = {p.before if which == "b" else p.after for p in result.plans if p.mask}
    found = rows.one_sided(result.pairs, which, columns, most or result.config.report.only_in_max_rows).collect()
    return ["row", *columns], [[r["row_id"], *("***" if c in hidden else r[c] for c in columns)] for r in found]
