"""Pairing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright import models as m


def ranked(df: DataFrame, key: str = "__key", order: str = "__row_id", hot_keys: bool = False, rows_each: int = 100_000) -> DataFrame:
    """df with __rank: the place, from 1, of each row among those of its key, by `order`.

    One window over the key; with hot_keys rows are first numbered within (key, range of `order`),
    ranges of `rows_each` ids, and each range's offset, from a small table of counts, is added, so that a
    key with very many rows is dealt over many tasks.
    """
    if not hot_keys:
        return df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    df = df.withColumn("__range", F.floor(F.col(order) / rows_each))
    counts = df.groupBy(key, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(key).alias("__k"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = df.withColumn("__local", F.row_number().over(Window.partitionBy(key, "__range").orderBy(order)))
    joined = local.join(base, (F.col(key) == F.col("__k")) & (F.col("__range") == F.col("__r")))
    return joined.withColumn("__rank", (F.col("__local") + F.col("__base")).cast("int")).drop("__range", "__k", "__r", "__base", "__local")


def side(df: DataFrame, key: Column, columns: list[str], prefix: str) -> DataFrame:
    """__key, __row_id and a struct of a side's columns as text; a struct stays null where the outer join has no row."""
    values = F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]) if columns else F.struct(F.lit(1).alias("__none"))
    return df.select(key.alias("__key"), F.col("__row_id"), values.alias(prefix))


def paired(before: DataFrame, after: DataFrame, unique: bool = False, hot_keys: bool = False, every: bool = False) -> DataFrame:
    """__key, __rank, __b_row, __a_row, b, a, __pair_id: the full outer join by key and rank.

    It is the only join of a comparison: rows carry their columns along. Where keys are known to be unique on
    both sides, no rank is computed; with `every` neither, and a row meets all rows of its key.
    """
    if unique or every:
        b, a = before.withColumn("__rank", F.lit(1)), after.withColumn("__rank", F.lit(1))
        on = ["__key"]
        a = a.drop("__rank").withColumnRenamed("__row_id", "__a_row")
    else:
        b, a = ranked(before, hot_keys=hot_keys), ranked(after, hot_keys=hot_keys).withColumnRenamed("__row_id", "__a_row")
        on = ["__key", "__rank"]
    joined = b.withColumnRenamed("__row_id", "__b_row").join(a, on, "full_outer")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rank = F.coalesce("__rank", F.lit(1)).alias("__rank")
    return joined.select("__key", rank, "__b_row", "__a_row", "b", "a", F.concat(text("__b_row"), F.lit("/"), text("__a_row")).alias("__pair_id"))


def with_cells(pairs: DataFrame, plans: list) -> DataFrame:
    """pairs with `cells`, the classified cells of a matched row (null on one-sided rows)."""
    cells = [p.cell(F.col("b")[p.before], F.col("a")[p.after]) for p in plans]
    both = F.col("__b_row").isNotNull() & F.col("__a_row").isNotNull()
    if not cells:
        kind = "array<struct<column_name:string,column_type:string,column_notes:string,before_raw:string,after_raw:string,before_norm:string,after_norm:string,status:string,abs_diff:double,rel_diff:double>>"
        return pairs.withColumn("cells", F.when(both, F.expr(f"cast(array() as {kind})")))
    return pairs.withColumn("cells", F.when(both, F.array(*cells)))


def row_status(cells: DataFrame, *more: Column, by_id: bool = False, by_key: bool = False) -> DataFrame:
    """One row for each pair: its status, and how many cells differ, severely or in format, and its columns `more`. No join and no shuffle: the row's own
    cells are counted. With `by_id`, for row ids that repeat, the cells of all pairs of an id count for each of them, which takes a shuffle; with `by_key` those of all pairs of a key."""
    n = lambda f: F.coalesce(F.size(F.filter("cells", f)), F.lit(0)).cast("long")
    counted = cells.select(
        "__pair_id", "__key", "__b_row", "__a_row",
        n(lambda x: x["status"] != m.EQUAL).alias("changed_columns"),
        n(lambda x: x["status"].isin(*m.SEVERE)).alias("severe_columns"),
        n(lambda x: x["status"] == m.FORMAT_ONLY).alias("format_only_columns"),
        *more,
    )
    if by_id or by_key:
        of = Window.partitionBy("__pair_id" if by_id else "__key")
        counted = counted.withColumns({c: F.sum(c).over(of) for c in counted.columns[4:7]})
    zero = [F.when(F.col("__b_row").isNotNull() & F.col("__a_row").isNotNull(), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("changed_columns", "severe_columns", "format_only_columns")]
    status = F.when(F.col("__a_row").isNull(), m.ONLY_IN_BEFORE).when(F.col("__b_row").isNull(), m.ONLY_IN_AFTER).when(F.col("changed_columns") > 0, m.CHANGED).otherwise(m.SAME)
    return counted.select("__pair_id", "__key", "__b_row", "__a_row", status.alias("row_status"), *zero, *[f"`{n}`" for n in counted.columns[7:]])


def duplicate_groups(df: DataFrame) -> DataFrame:
    """__key and rows of keys that occur more than once."""
    return df.groupBy("__key").agg(F.count("*").alias("rows")).filter("rows > 1")


def one_sided(pairs: DataFrame, which: str, columns: list[str], most: int | None = None) -> DataFrame:
    """The rows that only one side has (which: "b" or "a"), by row id, with up to eight columns."""
    own, other = ("__b_row", "__a_row") if which == "b" else ("__a_row", "__b_row")
    rows = pairs.filter(F.col(other).isNull()).select("__key", F.col(own).alias("row_id"), *[F.col(which)[c].alias(c) for c in columns[:8]])
    return rows.orderBy("row_id").limit(most) if most else rows
