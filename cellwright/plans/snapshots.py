"""Two text snapshots derived from `orders`, for queries and tests; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright import models as m
from cellwright.config import ColumnRule, Config
from cellwright.functions.classify import plan

COLUMNS = ["id", "price", "odate", "status", "prio"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: Column) -> Column:
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def orders_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): all columns text, with __row_id; every twentieth order changes in one of 15 ways, some rows are on one side only."""
    o = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    k, r = key % 20, key % 50
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    money, iso, status = _money(cents), F.date_format(day, "yyyy-MM-dd"), F.col("o_orderstatus")
    before = o.select(
        key.cast("string").alias("id"),
        F.when(k == 2, F.concat(F.lit("-"), money)).when(k == 6, "").otherwise(money).alias("price"),
        iso.alias("odate"), status.alias("status"), F.col("o_orderpriority").alias("prio"), key.alias("__row_id"),
    )
    price = (
        F.when(k == 0, F.concat(F.lit("¥"), money)).when(k == 1, F.concat(money, F.lit("0"))).when(k == 2, F.concat(F.lit("("), money, F.lit(")")))
        .when(k == 3, _money(cents + 100)).when(k == 4, "待确认").when(k == 5, "").when(k == 6, "N/A").otherwise(money)
    )
    odate = (
        F.when(k == 7, F.date_format(day, "yyyy/MM/dd")).when(k == 8, F.concat(F.year(day), F.lit("年"), F.month(day), F.lit("月"), F.dayofmonth(day), F.lit("日")))
        .when(k == 9, F.concat(iso, F.lit(" 00:00:00"))).when(k == 10, F.date_format(F.date_add(day, 1), "yyyy-MM-dd")).otherwise(iso)
    )
    after = o.select(
        key.alias("__key_id"), r.alias("__r"), price.alias("price"), odate.alias("odate"),
        F.when(k == 11, F.concat(status, F.lit("  "))).when(k == 12, F.translate(status, "FOP", "ＦＯＰ")).when(k == 13, F.lower(status)).otherwise(status).alias("status"),
        F.when(k == 14, "6-NEW").otherwise(F.col("o_orderpriority")).alias("prio"),
    )
    ids = F.when(F.col("__r") == 48, F.array("__key_id", F.col("__key_id") + 1_000_000)).when(F.col("__r") == 49, F.array().cast("array<long>")).otherwise(F.array("__key_id"))
    after = after.select(F.explode(ids).alias("__id"), "price", "odate", "status", "prio")
    return before, after.select(F.col("__id").cast("string").alias("id"), "price", "odate", "status", "prio", F.col("__id").alias("__row_id"))


def orders_config() -> Config:
    return Config(keys=["id"], columns=[ColumnRule("price", type=m.NUMERIC), ColumnRule("odate", type=m.DATE, granularity="date"), ColumnRule("status", type=m.STRING), ColumnRule("prio", type=m.STRING)])


def orders_plans() -> list:
    c = orders_config()
    return [plan(c, "price", "price", m.NUMERIC), plan(c, "odate", "odate", m.DATE, "date"), plan(c, "status", "status", m.STRING), plan(c, "prio", "prio", m.STRING)]


# ---- the same in SQL, written from the rules, not from the code above

_MONEY = "CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
SNAPSHOTS = f"""
o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS m, o_orderkey % 50 AS r, CAST(round(o_totalprice * 100) AS BIGINT) AS c,
  CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s, o_orderpriority AS p FROM orders),
w AS (SELECT *, {_MONEY.format(c="c")} AS money, {_MONEY.format(c="(c + 100)")} AS more, strftime(d, '%Y-%m-%d') AS iso FROM o),
b AS (SELECT k AS rid, CAST(k AS VARCHAR) AS id, CASE m WHEN 2 THEN '-' || money WHEN 6 THEN '' ELSE money END AS price, iso AS odate, s AS status, p AS prio FROM w),
aa AS (SELECT k, r, CASE m WHEN 0 THEN '¥' || money WHEN 1 THEN money || '0' WHEN 2 THEN '(' || money || ')' WHEN 3 THEN more WHEN 4 THEN '待确认' WHEN 5 THEN '' WHEN 6 THEN 'N/A' ELSE money END AS price,
  CASE m WHEN 7 THEN strftime(d, '%Y/%m/%d') WHEN 8 THEN year(d) || '年' || month(d) || '月' || day(d) || '日' WHEN 9 THEN iso || ' 00:00:00' WHEN 10 THEN strftime(d + INTERVAL 1 DAY, '%Y-%m-%d') ELSE iso END AS odate,
  CASE m WHEN 11 THEN s || '  ' WHEN 12 THEN translate(s, 'FOP', 'ＦＯＰ') WHEN 13 THEN lower(s) ELSE s END AS status, CASE m WHEN 14 THEN '6-NEW' ELSE p END AS prio FROM w),
a AS (SELECT k AS rid, CAST(k AS VARCHAR) AS id, price, odate, status, prio FROM aa WHERE r <> 49
  UNION ALL SELECT k + 1000000, CAST(k + 1000000 AS VARCHAR), price, odate, status, prio FROM aa WHERE r = 48)"""

_NUM = "TRY_CAST(CASE WHEN {x} LIKE '(%)' THEN '-' || substr({x}, 2, length({x}) - 2) ELSE {x} END AS DOUBLE)"
_CLEAN = "nullif(replace(replace({x}, '¥', ''), ',', ''), '')"
_DAY = "TRY_CAST(CASE WHEN {x} LIKE '%年%' THEN split_part({x}, '年', 1) || '-' || lpad(split_part(split_part({x}, '年', 2), '月', 1), 2, '0') || '-' || lpad(replace(split_part({x}, '月', 2), '日', ''), 2, '0') ELSE replace({x}, '/', '-') END AS TIMESTAMP)"
_TEXT = "translate(trim({x}), 'ＦＯＰ', 'FOP')"
_NULL = "lower(trim({x})) IN ('', 'n/a')"


def _status(bv: str | None, av: str | None, close: str = "false") -> str:
    out = f"CASE WHEN bn AND an THEN 'EQUAL' WHEN bn OR an THEN 'NULL_MISMATCH' WHEN br = ar THEN 'EQUAL' "
    if bv is None:
        return out + "WHEN bs = as_ THEN 'FORMAT_ONLY' ELSE 'VALUE_DIFF' END"
    return out + f"WHEN {bv} IS NULL OR {av} IS NULL THEN 'TYPE_MISMATCH' WHEN {bv} = {av} OR {close} THEN 'FORMAT_ONLY' ELSE 'VALUE_DIFF' END"


def cells_sql() -> str:
    """CTEs up to `cells`: pair, column_name, column_type, br, ar, bs, as_, status, abs_diff, rel_diff for every matched cell."""
    num = lambda x: _NUM.format(x=_CLEAN.format(x=x))
    day = lambda x: _DAY.format(x=x)
    close = f"abs(bv - av) <= 1e-9 * greatest(abs(bv), abs(av))"
    branches = []
    for column, kind in (("price", "numeric"), ("odate", "date"), ("status", "string"), ("prio", "string")):
        raw = f"SELECT pair_id, id, b_row, a_row, '{column}' AS column_name, '{kind}' AS column_type, b_{column} AS br, a_{column} AS ar, {_TEXT.format(x='b_' + column)} AS bs, {_TEXT.format(x='a_' + column)} AS as_, {_NULL.format(x='b_' + column)} AS bn, {_NULL.format(x='a_' + column)} AS an FROM pairs WHERE b_row IS NOT NULL AND a_row IS NOT NULL"
        if kind == "numeric":
            v = f"SELECT *, {num('br')} AS bv, {num('ar')} AS av FROM ({raw})"
            branches.append(f"SELECT pair_id, id, b_row, a_row, column_name, column_type, br, ar, bs, as_, {_status('bv', 'av', close)} AS status, abs(av - bv) AS abs_diff, CASE WHEN bv <> 0 THEN (av - bv) / abs(bv) END AS rel_diff FROM ({v})")
        elif kind == "date":
            v = f"SELECT *, CAST({day('br')} AS DATE) AS bv, CAST({day('ar')} AS DATE) AS av FROM ({raw})"
            branches.append(f"SELECT pair_id, id, b_row, a_row, column_name, column_type, br, ar, bs, as_, {_status('bv', 'av')} AS status, abs(date_diff('day', bv, av)) * 86400.0 AS abs_diff, CAST(NULL AS DOUBLE) AS rel_diff FROM ({v})")
        else:
            branches.append(f"SELECT pair_id, id, b_row, a_row, column_name, column_type, br, ar, bs, as_, {_status(None, None)} AS status, CAST(NULL AS DOUBLE) AS abs_diff, CAST(NULL AS DOUBLE) AS rel_diff FROM ({raw})")
    sides = ", ".join(f"b.{c} AS b_{c}, a.{c} AS a_{c}" for c in COLUMNS)
    pairs = f"pairs AS (SELECT coalesce(b.id, a.id) AS id, b.rid AS b_row, a.rid AS a_row, coalesce(CAST(b.rid AS VARCHAR), '') || '/' || coalesce(CAST(a.rid AS VARCHAR), '') AS pair_id, {sides} FROM b FULL OUTER JOIN a ON b.id = a.id)"
    return f"WITH {SNAPSHOTS},\n{pairs},\ncells AS ({' UNION ALL '.join(branches)})"
