"""Row ids without a single-partition window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> bool:
    """Whether rows may be dealt over other partitions when df is evaluated again: sampled bounds and the sizes of the columns read decide."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def with_row_id(df: DataFrame, name: str = "__row_id", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with consecutive numbers from 0, in the order of its partitions.

    Rows are counted by partition (a small job that needs no column), and each partition's offset is
    added to the row's place in it. Both read the same input, so df must be deterministic, as scans are;
    what a shuffle has dealt is kept with its places by `keep`, and counted as kept.
    """
    placed = df.withColumn("__m", F.monotonically_increasing_id())
    if keep and shuffled(df):
        placed = keep(placed)
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    counts = dict(placed.select(part.alias("p")).groupBy("p").count().collect())  # one row a partition
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    if not offsets:
        return placed.withColumn(name, place).drop("__m")
    base = F.get(F.expr(f"array({','.join(f'{x}L' for x in offsets)})"), part.cast("int"))
    return placed.withColumn(name, base + place).drop("__m")
