"""Queries against their SQL on what only larger tables have: shuffles of several partitions, and keys that meet."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from cellwright import catalog
from cellwright.config import Config
from cellwright.operators import profile
from cellwright.sources.rowid import with_row_id

SMALL = "/root/testdata/sf0.001"


def same(spark, folder, name):
    """Whether a query's rows are those of its SQL."""
    con = duckdb.connect()
    for t in ("orders", "nation", "region", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder if t == 'orders' else SMALL}/{t}.parquet{'/*.parquet' if t == 'orders' else ''}'")
    expected = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    plain = lambda rows: Counter(tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r) for r in rows)
    return plain(expected.fetchall()) == plain(tuple(r) for r in catalog.queries()[name](spark, folder).select(*names).collect())


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """40,000 orders; a shuffle of all their columns keeps its partitions, one of few columns is coalesced."""
    folder = str(tmp_path_factory.mktemp("many"))
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    k = F.col("n") * 1500 + F.col("o_orderkey")
    spark.range(27).withColumnRenamed("id", "n").crossJoin(o).withColumn("o_orderkey", k).drop("n").write.parquet(f"{folder}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "150KB")
    yield folder
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_numbers_of_sorted_rows(spark, many):
    kept = []
    got = with_row_id(spark.read.parquet(f"{many}/orders.parquet").orderBy("o_orderkey"), keep=lambda df: kept.append(df.persist()) or df)
    r = got.agg(F.count("*"), F.count_distinct("__row_id"), F.min("__row_id"), F.max("__row_id"), F.count_if(F.col("__row_id") != F.col("o_orderkey"))).first()
    assert tuple(r) == (40_500, 40_500, 0, 40_499, 0)
    kept[0].unpersist()


@pytest.mark.parametrize("name", ["row_view", "csv_export", "engine_columns", "diff_view", "engine_anomalies", "engine_stats"])
def test_sorted_sides(spark, many, name):
    assert same(spark, many, name)


@pytest.fixture(scope="module")
def meeting(spark, tmp_path_factory):
    """Orders of which some have the keys that the snapshots add for others."""
    folder = str(tmp_path_factory.mktemp("meeting"))
    o = spark.read.parquet(f"{SMALL}/orders.parquet")
    o.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000).withColumn("o_totalprice", F.col("o_totalprice") + 1).unionAll(o).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", ["pair_full_outer", "abs_rel_diff", "cell_status_counts", "dataset_verdict", "diff_detail", "row_status_counts", "column_summary", "diff_filtered"])
def test_keys_that_meet(spark, meeting, name):
    assert same(spark, meeting, name)


def test_exact_distinct_values(spark):
    few = Config(profile_exact_distinct_limit=10)
    df = spark.range(30_000).select(F.col("id").cast("string").alias("c"))
    assert profile.profile(df, ["c"], few)[0].distinct != 30_000 and profile.profile(df, ["c"], few, exact=True)[0].distinct == 30_000


@pytest.mark.parametrize("name", ["csv_export", "report_verdict", "engine_anomalies", "diff_view", "engine_columns", "engine_stats", "row_view"])
def test_comparisons_of_keys_that_meet(spark, meeting, name):
    assert same(spark, meeting, name)


def test_distinct_values_of_many_rows(spark):
    """Unless a limit is configured, exact at any number of rows."""
    df = spark.range(30_000).select(F.col("id").cast("string").alias("c"))
    assert profile.profile(df, ["c"], rows=3_000_000)[0].distinct == 30_000
