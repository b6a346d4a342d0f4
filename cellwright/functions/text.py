"""Text normalisation as Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.config import StringOptions

# Full-width forms U+FF01 to U+FF5E and the ideographic space, then five other minus signs.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
_MINUS = "−–—―‑"
#: Space, TAB, LF, FF, CR, no-break space, ideographic space.
SPACE = "[ \\t\\n\\f\\r 　]"


def full(pattern: str) -> str:
    """A pattern that must match the whole text; "." matches line feeds too."""
    return rf"(?s)\A(?:{pattern})\z"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once: it is bound to a lambda's variable, and generated code stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(c: Column) -> Column:
    """Whether a text is plain ASCII: a cheap test that spares most cells the slow paths."""
    return F.octet_length(c) == F.length(c)


def half_width(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(F.translate(c, _WIDE + _MINUS, _NARROW + "-" * len(_MINUS)))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def trim_blank(c: Column) -> Column:
    """Without blanks of any width at both ends (TAB stays)."""
    return F.when(is_ascii(c), F.trim(c)).otherwise(F.regexp_replace(c, r"\A\p{Zs}+|\p{Zs}+\z", ""))


def normalize(c: Column, o: StringOptions) -> Column:
    """Width first, then white space, then case. Ignoring white space wins over collapsing it, which always trims."""
    if o.fullwidth_to_halfwidth:
        c = half_width(c)
    if o.ignore_whitespace:
        c = F.regexp_replace(c, f"{SPACE}+", "")
    elif o.collapse_whitespace:
        c = once(F.regexp_replace(c, f"{SPACE}+", " "), trim_blank)
    elif o.trim:
        c = strip_space(c)
    return F.lower(c) if o.case_insensitive else c


def is_null(raw: Column, norm: Column, tokens: list[str]) -> Column:
    """Whether a cell stands for null: it is null, or its normalised text is a null token."""
    return raw.isNull() | F.lower(F.coalesce(norm, F.lit(""))).isin(*tokens) if tokens else raw.isNull()
