"""All differences as one CSV file."""

from __future__ import annotations

import csv

from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.operators import detail
from cellwright.plans.engine import Result
from cellwright.report import data


def write(result: Result, path: str) -> None:
    """Every row, the severest first, by row; with a byte order mark for spreadsheets. Rows come partition by partition."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(data.DETAIL)
        for r in data.detail_rows(result, None, by_size=False, chars=0):
            out.writerow([*r[:4], m.LABELS[r[4]], *r[5:]])


def write_distributed(result: Result, path: str) -> None:
    """The same rows as a folder of part files, each with a header, in the same order from part to part; written by the executors, for details too large for one file."""
    shown = detail.shown(result.diff_detail, by_size=False, masked=data.masked(result))
    key = F.replace(F.replace("__key", F.lit("\x1f"), F.lit(" | ")), F.lit("\x00"), F.lit("<NULL>"))
    found = [F.col("__b_row"), key, F.col("column_name"), F.col("column_type"), detail.label(F.col("status")), F.col("before_raw"), F.col("after_raw"), F.col("abs_diff"), F.col("rel_diff")]
    shown.select(*[c.alias(n) for c, n in zip(found, data.DETAIL, strict=True)]).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
