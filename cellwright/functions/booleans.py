"""Truth values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE = ("true", "t", "yes", "y", "1", "是", "真", "有")
FALSE = ("false", "f", "no", "n", "0", "否", "假", "无")


def parse(c: Column) -> Column:
    c = F.lower(c)
    return F.when(c.isin(*TRUE), F.lit(True)).when(c.isin(*FALSE), F.lit(False))
