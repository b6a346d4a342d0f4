"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright.config import NumericOptions
from cellwright.functions.text import SPACE, full, half_width, once, trim_blank

# Yen (two widths), dollar (two), euro, pound, rupee.
CURRENCY = "¥￥$€£₹＄"
#: What may be cast; Spark's own cast also takes "1.5d" or hexadecimal.
GRAMMAR = full(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf|infinity|nan)")


def clean(c: Column, o: NumericOptions) -> Column:
    """The digits of a number's spelling: no currency, white space, thousands separators; (x) is -x; "." before decimals."""
    european = o.decimal_separator == ","
    drop = SPACE[1:-1] + (CURRENCY.replace("$", r"\$") if o.strip_currency else "")
    if o.ignore_thousands_separator:
        drop += "." if european else ","
    bare = F.regexp_replace(half_width(F.nullif(trim_blank(c), F.lit(""))), f"[{drop}]+", "")
    inner = lambda x: F.concat(F.lit("-"), F.substring(x, F.lit(2), F.length(x) - 2))
    c = once(bare, lambda x: F.when(x.startswith("(") & x.endswith(")"), inner(x)).otherwise(x))
    return F.replace(c, F.lit(","), F.lit(".")) if european else c


def parse(c: Column, o: NumericOptions) -> Column:
    """The value as DOUBLE, or null. A trailing % is dropped, and in ratio mode divides the value by 100."""

    def value(x: Column) -> Column:
        bare = F.when(x.endswith("%"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
        digits = F.when(bare.contains("_"), F.regexp_replace(bare, r"(?<=\d)_(?=\d)", "")).otherwise(bare)
        number = once(digits, lambda d: F.when(d.rlike(GRAMMAR), d).try_cast("double"))
        return F.when(x.endswith("%"), number / 100).otherwise(number) if o.percent_mode == "ratio" else number

    return once(clean(c, o), value)


def within(a: Column, b: Column, abs_tol: float, rel_tol: float) -> Column:
    """Whether two values differ by no more than a tolerance; never where both tolerances are 0 or less."""
    d = F.abs(a - b)
    tests = [d <= F.lit(abs_tol)] if abs_tol > 0 else []
    if rel_tol > 0:
        tests.append(d <= F.lit(rel_tol) * F.greatest(F.abs(a), F.abs(b)))
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out
