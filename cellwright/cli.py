"""Command line: compare, profile, init-config, gui."""

from __future__ import annotations

import argparse
import os
import sys

from cellwright import VERSION
from cellwright.config import Config, SourceSpec, dump_config, load_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellwright", description="Compare two snapshots of a dataset cell by cell.")
    top.add_argument("--version", action="version", version=f"cellwright {VERSION}")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="compare two snapshots")
    c.add_argument("-c", "--config", help="a YAML or JSON file; options here win over it")
    c.add_argument("-b", "--before", help="path of the snapshot before")
    c.add_argument("-a", "--after", help="path of the snapshot after")
    c.add_argument("-k", "--keys", help="key columns, separated by commas")
    for name in ("delimiter", "encoding"):
        c.add_argument(f"--{name}", help="for both sides")
        c.add_argument(f"--{name}-before")
        c.add_argument(f"--{name}-after")
    c.add_argument("--sheet-before")
    c.add_argument("--sheet-after")
    c.add_argument("--no-header", action="store_true", default=None)
    c.add_argument("--tolerance", type=float, help="relative tolerance of numbers")
    c.add_argument("--abs-tolerance", type=float, help="absolute tolerance of numbers")
    for name in ("case-insensitive", "ignore-whitespace", "detect-types", "auto-key", "row-index", "anomaly"):
        c.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--keep-intermediate", action="store_true", default=None)
    c.add_argument("--treat-format-only-as-diff", action="store_true", default=None)
    c.add_argument("-o", "--out", "--output-dir", dest="output_dir", help="folder of the reports")
    c.add_argument("--db", help="folder in which the tables are kept")
    c.add_argument("--memory-limit")
    c.add_argument("--threads", type=int)
    c.add_argument("--top-n", type=int)
    c.add_argument("--max-rows", type=int, help="rows in the HTML report")
    c.add_argument("--formats", help="console,html,excel,markdown,csv")
    c.add_argument("--html", action="store_true", help="only the HTML report")
    c.add_argument("--excel", action="store_true", help="only the Excel report")
    c.add_argument("--fail-on-diff", action=argparse.BooleanOptionalAction, default=False, help="exit with 2 unless the snapshots are consistent")
    c.add_argument("-q", "--quiet", action="store_true")
    p = sub.add_parser("profile", help="describe the columns of a source")
    p.add_argument("path", nargs="?", default="")
    p.add_argument("-f", "--file", help="the same as the path")
    p.add_argument("-c", "--config", help="a YAML or JSON file with options of types and nulls")
    for name in ("delimiter", "encoding", "sheet"):
        p.add_argument(f"--{name}")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--rows", type=int, default=20, help="sample values shown for each column")
    p.add_argument("--limit", type=int, help="only the first rows of the source")
    i = sub.add_parser("init-config", help="write a configuration with all defaults")
    i.add_argument("path", nargs="?", default="config.yaml")
    i.add_argument("-o", "--out", help="the same as the path")
    i.add_argument("--force", action="store_true", help="overwrite")
    g = sub.add_parser("gui", help="a page in the browser")
    g.add_argument("--host", default="127.0.0.1")
    g.add_argument("--port", type=int, default=8765)
    g.add_argument("--root", "--dir", dest="root", help="folder below which files may be browsed")
    g.add_argument("--open-browser", action=argparse.BooleanOptionalAction, default=True)
    g.add_argument("--no-browser", dest="open_browser", action="store_false")
    return top


def _unescaped(text: str) -> str:
    return text.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r")


def build_config(a: argparse.Namespace) -> Config:
    """The command line over the file over the defaults. A side's own option wins over the common one."""
    c = load_config(a.config) if a.config else Config()
    for side, spec in (("before", c.before), ("after", c.after)):
        if getattr(a, side):
            spec.path = getattr(a, side)
        if not spec.path:
            raise ValueError(f"no path of the snapshot {side} is given")
        for name in ("delimiter", "encoding"):
            if (value := getattr(a, f"{name}_{side}") or getattr(a, name)) is not None:
                setattr(spec, name, _unescaped(value))
        if (sheet := getattr(a, f"sheet_{side}")) is not None:
            spec.sheet = int(sheet) if sheet.isdigit() else sheet
        if a.no_header:
            spec.header = False
    if a.keys:
        c.keys = [k.strip() for k in a.keys.split(",") if k.strip()]

    def put(value: object, owner: object, name: str) -> None:
        if value is not None:
            setattr(owner, name, value)

    put(a.tolerance, c.compare.numeric, "rel_tol")
    put(a.abs_tolerance, c.compare.numeric, "abs_tol")
    put(a.case_insensitive, c.compare.string, "case_insensitive")
    put(a.ignore_whitespace, c.compare.string, "ignore_whitespace")
    put(a.detect_types, c.compare, "detect_types")
    put(a.auto_key, c.key_options, "auto_detect")
    put(a.row_index, c.key_options, "use_row_index_if_no_key")
    put(a.anomaly, c.anomaly, "enabled")
    put(a.keep_intermediate, c, "keep_intermediate")
    put(a.treat_format_only_as_diff, c.report, "treat_format_only_as_diff")
    put(a.output_dir, c, "output_dir")
    put(a.db, c, "work_db")
    put(a.memory_limit, c, "memory_limit")
    put(a.threads, c, "threads")
    put(a.top_n, c.report, "top_n")
    put(a.max_rows, c.report, "html_max_rows")
    if a.formats:
        c.report.formats = [f.strip() for f in a.formats.split(",") if f.strip()]
    elif a.html or a.excel:
        c.report.formats = ["html"] if a.html else ["excel"]
    return c


def compare(a: argparse.Namespace) -> int:
    from cellwright.plans.engine import CompareEngine
    from cellwright.report import write_reports

    c = build_config(a)
    log = (lambda _: None) if a.quiet else print
    engine = CompareEngine(c, log=log)
    try:
        result = engine.run()
        for name, path in write_reports(result, log).items():
            if path != "-":
                log(f"{name}: {path}")
        return 2 if a.fail_on_diff and not result.stats.consistent else 0
    finally:
        engine.close()


def profile(a: argparse.Namespace) -> int:
    from cellwright.operators import keys
    from cellwright.operators.profile import samples
    from cellwright.plans.engine import CompareEngine
    from cellwright.report.console import table
    from cellwright.sources.load import load

    path = a.file or a.path
    if not path:
        raise ValueError("no source is given")
    c = load_config(a.config) if a.config else Config()
    spec = SourceSpec(path, delimiter=_unescaped(a.delimiter or ""), encoding=a.encoding or "utf-8", header=not a.no_header, sheet=int(a.sheet) if (a.sheet or "").isdigit() else a.sheet)
    engine = CompareEngine(c)
    side = load(engine.spark, spec, "source", a.limit)
    found = engine.profile(side)
    share = lambda n, p: f"{n / p.non_null:.1%}" if p.non_null else "-"
    print(f"{path}: {side.row_count} rows, {len(side.columns)} columns")
    print(table(["column", "nulls", "distinct", "numeric", "dates", "least", "greatest"], [[p.column, f"{p.null_rate:.1%}", p.distinct, share(p.numeric_ok, p), share(p.date_ok, p), p.min_value or "", p.max_value or ""] for p in found], 24))
    if a.rows > 0:
        print("sample values")
        for name, values in samples(side.df, side.columns, a.rows).items():
            print(f"  {name}: {', '.join(values) or '-'}")
    for w in side.warnings:
        print(f"! {w}")
    print("suggested key:", ", ".join(keys.detect(side.df, found, c.key_options)) or "none found")
    engine.close()
    return 0


def init_config(a: argparse.Namespace) -> int:
    path = a.out or a.path
    if os.path.exists(path) and not a.force:
        raise ValueError(f"{path} exists; --force overwrites it")
    dump_config(Config(), path)
    print(path)
    return 0


def gui(a: argparse.Namespace) -> int:
    from cellwright.gui import serve

    serve(a.host, a.port, root=a.root, browser=a.open_browser)
    return 0


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0; 2 with --fail-on-diff and differences; 1 on a wrong call or a failure; 130 when interrupted."""
    a = parser().parse_args(argv)
    try:
        return {"compare": compare, "profile": profile, "init-config": init_config, "gui": gui}[a.command](a)
    except KeyboardInterrupt:
        return 130
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
