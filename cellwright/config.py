"""Configuration: dataclasses with defaults, read from dicts, YAML or JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

# Spellings of null, compared in lower case after normalisation.
NULL_TOKENS = ["", "null", "none", "nan", "na", "n/a", "n.a.", "#n/a", "<na>", "nil", "undefined", "-", "--", "—", "－", "无", "空", "未知"]

# Kinds of source by file extension; any other is read as delimited text.
EXTENSIONS = {
    ".csv": "csv", ".tsv": "csv", ".tab": "csv", ".psv": "csv", ".txt": "csv", ".dat": "csv",
    ".parquet": "parquet", ".pq": "parquet",
    ".json": "json", ".jsonl": "json", ".ndjson": "json",
    ".xlsx": "excel", ".xlsm": "excel", ".xltx": "excel", ".xls": "excel",
}


@dataclass
class SourceSpec:
    path: str = ""
    kind: str = ""
    delimiter: str = ""
    quote: str = '"'
    escape: str = '"'
    encoding: str = "utf-8"
    header: bool = True
    skip_rows: int = 0
    sheet: str | int | None = None
    name: str = ""

    def resolved_kind(self) -> str:
        return self.kind or EXTENSIONS.get(os.path.splitext(self.path.rstrip("/"))[1].lower(), "csv")

    def known_delimiter(self) -> str:
        """The delimiter that is set or that the extension tells; empty: to be found from the text."""
        return self.delimiter or {".tsv": "\t", ".tab": "\t", ".psv": "|"}.get(os.path.splitext(self.path)[1].lower(), "")


@dataclass
class NumericOptions:
    abs_tol: float = 0.0
    rel_tol: float = 1e-9
    ignore_thousands_separator: bool = True
    decimal_separator: str = "."
    percent_mode: str = "keep"
    strip_currency: bool = True
    #: Values of up to 15 digits that are integers on both sides must be equal, whatever rel_tol says.
    exact_integers: bool = False


@dataclass
class StringOptions:
    trim: bool = True
    collapse_whitespace: bool = True
    ignore_whitespace: bool = False
    case_insensitive: bool = False
    fullwidth_to_halfwidth: bool = True
    null_equals_empty: bool = True
    null_tokens: list[str] = field(default_factory=lambda: list(NULL_TOKENS))


@dataclass
class DateOptions:
    enabled: bool = True
    day_first: bool = True
    granularity: str = "auto"
    tolerance_seconds: float = 0
    formats: list[str] = field(default_factory=list)


@dataclass
class CompareOptions:
    detect_types: bool = True
    leading_zero_is_text: bool = True
    max_digits_for_number: int = 15
    numeric: NumericOptions = field(default_factory=NumericOptions)
    string: StringOptions = field(default_factory=StringOptions)
    date: DateOptions = field(default_factory=DateOptions)


@dataclass
class KeyOptions:
    trim: bool = True
    case_insensitive: bool = False
    fullwidth_to_halfwidth: bool = True
    numeric_normalize: bool = False
    auto_detect: bool = True
    use_row_index_if_no_key: bool = False
    #: A row meets all rows of its key, as in a join, in place of the one of its occurrence; the pairs of a key share their status, and repeated keys are no anomaly.
    meet_all: bool = False


@dataclass
class ColumnRule:
    name: str = ""
    after_name: str | None = None
    type: str | None = None
    ignore: bool = False
    abs_tol: float | None = None
    rel_tol: float | None = None
    case_insensitive: bool | None = None
    trim: bool | None = None
    collapse_whitespace: bool | None = None
    null_tokens: list[str] | None = None
    date_formats: list[str] | None = None
    granularity: str | None = None
    #: Values of the column are shown as *** in reports.
    mask: bool = False


@dataclass
class AnomalyOptions:
    enabled: bool = True
    outlier_enabled: bool = True
    outlier_multiplier: float = 3.0
    null_rate_delta: float = 0.05
    mean_shift_ratio: float = 0.30
    distinct_change_ratio: float = 0.30
    category_max_distinct: int = 60
    category_max_examples: int = 10
    numeric_parse_failure_ratio: float = 0.02
    max_examples: int = 20


@dataclass
class ReportOptions:
    title: str = "Dataset comparison"
    formats: list[str] = field(default_factory=lambda: ["console", "html", "excel", "markdown"])
    top_n: int = 30
    html_max_rows: int = 20000
    excel_max_rows: int = 50000
    excel_max_cell_chars: int = 100
    markdown_max_rows: int = 100
    only_in_max_rows: int = 5000
    treat_format_only_as_diff: bool = False
    max_cell_chars: int = 200


@dataclass
class Config:
    before: SourceSpec = field(default_factory=SourceSpec)
    after: SourceSpec = field(default_factory=SourceSpec)
    keys: list[str] = field(default_factory=list)
    column_map: dict[str, str] = field(default_factory=dict)
    columns: list[ColumnRule] = field(default_factory=list)
    key_options: KeyOptions = field(default_factory=KeyOptions)
    compare: CompareOptions = field(default_factory=CompareOptions)
    anomaly: AnomalyOptions = field(default_factory=AnomalyOptions)
    report: ReportOptions = field(default_factory=ReportOptions)
    output_dir: str = "output"
    work_db: str = ""
    keep_intermediate: bool = True
    #: Above so many rows a profile's distinct values are estimated; not set, they are exact at any size.
    profile_exact_distinct_limit: int | None = None
    memory_limit: str = ""
    threads: int = 0
    temp_dir: str = ""

    def rule(self, column: str) -> ColumnRule | None:
        """The first rule for a column, by its name before."""
        return next((r for r in self.columns if r.name == column), None)

    def after_name(self, column: str) -> str:
        rule = self.rule(column)
        return (rule.after_name if rule and rule.after_name else None) or self.column_map.get(column, column)

    def null_tokens(self, column: str | None = None) -> list[str]:
        rule = self.rule(column) if column else None
        tokens = rule.null_tokens if rule and rule.null_tokens is not None else self.compare.string.null_tokens
        lower = dict.fromkeys(t.lower() for t in tokens)
        if self.compare.string.null_equals_empty:
            lower.setdefault("")
        else:
            lower.pop("", None)
        return list(lower)

    def strings(self, column: str) -> StringOptions:
        rule, base = self.rule(column), asdict(self.compare.string)
        for name in ("trim", "collapse_whitespace", "case_insensitive"):
            if rule and getattr(rule, name) is not None:
                base[name] = getattr(rule, name)
        return StringOptions(**base)

    def tolerances(self, column: str) -> tuple[float, float]:
        rule, n = self.rule(column), self.compare.numeric
        return (
            rule.abs_tol if rule and rule.abs_tol is not None else n.abs_tol,
            rule.rel_tol if rule and rule.rel_tol is not None else n.rel_tol,
        )

    def date_formats(self, column: str) -> list[str]:
        rule = self.rule(column)
        return list(rule.date_formats if rule and rule.date_formats is not None else self.compare.date.formats)

    def granularity(self, column: str) -> str:
        rule = self.rule(column)
        return (rule.granularity if rule and rule.granularity else None) or self.compare.date.granularity


def build(cls: type, data: Any) -> Any:
    """A dataclass from nested dicts: unknown names are ignored, null means the default."""
    if not isinstance(data, dict):
        raise ValueError(f"{cls.__name__}: a mapping is needed, not {type(data).__name__}")
    hints, out = get_type_hints(cls), {}
    for f in fields(cls):
        value = data.get(f.name)
        if value is None:
            continue
        if is_dataclass(hints[f.name]):
            value = build(hints[f.name], {"path": value} if hints[f.name] is SourceSpec and isinstance(value, str) else value)
        elif f.name == "columns":
            value = [build(ColumnRule, {"name": x} if isinstance(x, str) else x) for x in value]
        out[f.name] = value
    return cls(**out)


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs PyYAML; use a .json file") from e
        data = yaml.safe_load(text)
    if not isinstance(data or {}, dict):
        raise ValueError("the top level of a configuration must be a mapping")
    return build(Config, data or {})


def dump_config(config: Config, path: str | None = None) -> str:
    """YAML, or JSON where PyYAML is absent or the path says so."""
    data = asdict(config)
    try:
        import yaml

        text = json.dumps(data, ensure_ascii=False, indent=2) if path and path.endswith(".json") else yaml.safe_dump(data, allow_unicode=True, sort_keys=False)
    except ImportError:
        text = json.dumps(data, ensure_ascii=False, indent=2)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text
