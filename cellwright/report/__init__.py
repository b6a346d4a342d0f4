"""Reports of a comparison: console, Markdown, HTML, Excel, CSV."""

from __future__ import annotations

import os
from collections.abc import Callable

from cellwright.plans.engine import Result

FILES = {"html": "report.html", "markdown": "report.md", "excel": "report.xlsx", "csv": "diff_detail.csv"}
ALIASES = {"md": "markdown", "xlsx": "excel", "xls": "excel", "text": "console", "terminal": "console", "htm": "html"}


def write_reports(result: Result, log: Callable[[str], None] = print) -> dict[str, str]:
    """Write the configured reports to the output folder: {format: path, or why it failed}. One that fails keeps no other from being written."""
    from cellwright.report import console, csv_out, html, markdown, workbook

    writers = {"markdown": markdown.write, "html": html.write, "excel": workbook.write, "csv": csv_out.write}
    out: dict[str, str] = {}
    for name in dict.fromkeys(ALIASES.get(f.lower(), f.lower()) for f in result.config.report.formats):
        try:
            if name == "console":
                log(console.render(result))
                out[name] = "-"
            elif name in writers:
                os.makedirs(result.config.output_dir, exist_ok=True)
                path = os.path.join(result.config.output_dir, FILES[name])
                writers[name](result, path)
                out[name] = path
            else:
                out[name] = f"failed: unknown format; there are console, {', '.join(writers)}"
        except Exception as e:  # noqa: BLE001
            out[name] = f"failed: {e}"
            log(f"{name} report: {e}")
    return out
