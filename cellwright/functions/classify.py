"""The plan of a column, and the classification of a pair of cells."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.config import Config, NumericOptions, StringOptions
from cellwright.functions import booleans, dates, numbers, text


@dataclass
class ColumnPlan:
    """How a column is compared: names on both sides, the type, and the options in force."""

    before: str
    after: str
    type: str = m.STRING
    notes: str = ""
    strings: StringOptions = field(default_factory=StringOptions)
    numeric: NumericOptions = field(default_factory=NumericOptions)
    null_tokens: list[str] = field(default_factory=list)
    abs_tol: float = 0.0
    rel_tol: float = 1e-9
    day_first: bool = True
    formats: list[str] = field(default_factory=list)
    granularity: str = "timestamp"
    tolerance_seconds: float = 0.0
    mask: bool = False

    def norm(self, raw: Column) -> Column:
        return text.normalize(raw, self.strings)

    def value(self, raw: Column, norm: Column) -> Column | None:
        """The typed value; null where it can't be read. Dates are read from the raw text, which keeps their blanks and case."""
        if self.type == m.NUMERIC:
            return numbers.parse(raw, self.numeric)
        if self.type == m.DATE:
            return dates.truncate(dates.parse(raw, self.day_first, self.formats), self.granularity)
        return booleans.parse(norm) if self.type == m.BOOLEAN else None

    def close(self, b: Column, a: Column) -> Column:
        if self.type == m.NUMERIC:
            near = numbers.within(b, a, self.abs_tol, self.rel_tol)
            return near & ~((F.floor(b) == b) & (F.floor(a) == a)) if self.numeric.exact_integers else near
        if self.type == m.DATE and self.tolerance_seconds > 0 and self.granularity != "date":
            return dates.seconds_apart(b, a) <= self.tolerance_seconds
        return F.lit(False)

    def status(self, x: Column) -> Column:
        """x: a struct (b, a: raw; bs, as_: normalised; bv, av: values). Null first, then spelling, then the type."""
        bn, an = text.is_null(x["b"], x["bs"], self.null_tokens), text.is_null(x["a"], x["as_"], self.null_tokens)
        out = F.when(bn & an, m.EQUAL).when(bn | an, m.NULL_MISMATCH).when(x["b"].eqNullSafe(x["a"]), m.EQUAL)
        if self.type == m.STRING:
            return out.when(x["bs"].eqNullSafe(x["as_"]), m.FORMAT_ONLY).otherwise(m.VALUE_DIFF)
        out = out.when(x["bv"].isNull() | x["av"].isNull(), m.TYPE_MISMATCH)
        return out.when((x["bv"] == x["av"]) | self.close(x["bv"], x["av"]), m.FORMAT_ONLY).otherwise(m.VALUE_DIFF)

    def abs_diff(self, x: Column) -> Column:
        if self.type == m.NUMERIC:
            return F.abs(x["av"] - x["bv"])
        return dates.seconds_apart(x["bv"], x["av"]) if self.type == m.DATE else F.lit(None).cast("double")

    def rel_diff(self, x: Column) -> Column:
        return F.try_divide(x["av"] - x["bv"], F.abs(x["bv"])) if self.type == m.NUMERIC else F.lit(None).cast("double")

    def cell(self, before: Column, after: Column) -> Column:
        """struct(column_name, column_type, column_notes, before_raw, after_raw, before_norm, after_norm, status, abs_diff, rel_diff).

        Each stage is bound once by a lambda's variable, so a chain of replacements is evaluated once a cell.
        """
        raw = F.struct(before.alias("b"), after.alias("a"), self.norm(before).alias("bs"), self.norm(after).alias("as_"))

        def valued(x: Column) -> Column:
            bv, av = self.value(x["b"], x["bs"]), self.value(x["a"], x["as_"])
            none = F.lit(None).cast("double")
            return F.struct(*[x[n].alias(n) for n in ("b", "a", "bs", "as_")], (none if bv is None else bv).alias("bv"), (none if av is None else av).alias("av"))

        def judged(x: Column) -> Column:
            return F.struct(
                F.lit(self.before).alias("column_name"), F.lit(self.type).alias("column_type"), F.lit(self.notes).alias("column_notes"),
                x["b"].alias("before_raw"), x["a"].alias("after_raw"), x["bs"].alias("before_norm"), x["as_"].alias("after_norm"),
                self.status(x).alias("status"), self.abs_diff(x).alias("abs_diff"), self.rel_diff(x).alias("rel_diff"),
            )

        return text.once(text.once(raw, valued), judged)


def plan(config: Config, before: str, after: str, type_: str, granularity: str = "timestamp", notes: str = "") -> ColumnPlan:
    """A column's plan with the options that rules and configuration put in force."""
    abs_tol, rel_tol = config.tolerances(before)
    rule = config.rule(before)
    return ColumnPlan(
        before, after, type_, notes, config.strings(before), config.compare.numeric, config.null_tokens(before), abs_tol, rel_tol,
        config.compare.date.day_first, config.date_formats(before), granularity, config.compare.date.tolerance_seconds, bool(rule and rule.mask),
    )
