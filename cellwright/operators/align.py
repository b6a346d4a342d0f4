"""Alignment of columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from cellwright.config import Config

RESERVED = ("__row_id", "__key", "__rank", "__pair_id")


@dataclass
class Alignment:
    pairs: list[tuple[str, str]] = field(default_factory=list)
    only_before: list[str] = field(default_factory=list)
    only_after: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def guard(columns: list[str], side: str) -> None:
    if taken := [c for c in columns if c in RESERVED]:
        raise ValueError(f"{side}: column names {', '.join(taken)} are reserved")


def align(config: Config, before: list[str], after: list[str]) -> Alignment:
    """Pair columns by rule, rename map or name, in the order before. A second claim on a column after is dropped with a warning."""
    out, claimed, there = Alignment(), {}, set(after)
    for b in before:
        a = config.after_name(b)
        if a not in there:
            out.only_before.append(b)
        elif a in claimed:
            out.only_before.append(b)
            out.warnings.append(f"{b} and {claimed[a]} both map to {a}; {claimed[a]} keeps it")
        else:
            claimed[a] = b
            out.pairs.append((b, a))
    out.only_after = [a for a in after if a not in claimed]
    return out
