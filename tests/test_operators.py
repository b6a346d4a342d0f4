"""Anomalies, keys, ranks, plans, and random texts against DuckDB."""

import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright import catalog
from cellwright import models as m
from cellwright.config import AnomalyOptions, ColumnRule, Config, KeyOptions, NumericOptions, StringOptions, build, dump_config, load_config
from cellwright.functions import numbers, text
from cellwright.functions.classify import ColumnPlan, plan
from cellwright.models import ColumnProfile, Stats
from cellwright.operators import anomaly, detail, keys, rows
from cellwright.operators import profile as profiler
from cellwright.plans.engine import CompareEngine

O = AnomalyOptions()


def profile(name="c", **counts):
    return ColumnProfile(name, {"total": 100} | counts)


def test_simple_detectors():
    s = Stats(100, 97, rows={"ONLY_IN_BEFORE": 3}, duplicates={"after": 2}, one_sided_columns={"before": ["x"]})
    assert [a.level for a in anomaly.schema_change(s)] == ["error"]
    assert [a.level for a in anomaly.row_count_change(s)] == ["info"]
    assert [a.level for a in anomaly.row_count_change(Stats(before_rows=100, after_rows=80))] == ["warn"] and not anomaly.row_count_change(Stats())
    found = anomaly.key_anomalies(s, {"after": [("k", 3)]}, {"before": ["a", "b"]})
    assert [(a.category, a.count) for a in found] == [("duplicate_key", 2), ("unmatched_key", 3)]
    assert anomaly.format_changes([{"column_name": "c", "total": 3, "case_only": 1, "whitespace_only": 0, "numeric_format": 2}])[0].category == "case_only_change" and not anomaly.format_changes([])


@pytest.mark.parametrize(("before", "after", "level"), [(10, 12, None), (20, 26, "info"), (10, 20, "warn"), (0, 6, "warn"), (60, 50, "warn"), (40, 55, "warn")])
def test_null_rate(before, after, level):
    found = anomaly.null_rate_change(O, profile(nulls=before), profile(nulls=after))
    assert [a.level for a in found] == ([level] if level else [])


def test_distinct_mean_and_parse():
    assert anomaly.distinct_change(O, profile(distinct=10), profile(distinct=7)) and not anomaly.distinct_change(O, profile(distinct=10), profile(distinct=8))
    assert anomaly.mean_shift(O, "c", 10.0, 13.0) and not anomaly.mean_shift(O, "c", 10.0, 12.9) and anomaly.mean_shift(O, "c", 0.0, 1.0) and not anomaly.mean_shift(O, "c", None, 1.0)
    fails = lambda kind, **c: [(a.category, a.level) for a in anomaly.parse_failures(O, ColumnPlan("c", "c", kind), [("after", profile(**c))])]
    assert fails("numeric", numeric_ok=99) == [] and fails("numeric", numeric_ok=97) == [("numeric_parse_failure", "info")] and fails("numeric", numeric_ok=90) == [("numeric_parse_failure", "warn")]
    assert fails("string", numeric_ok=70) == [] and fails("string", numeric_ok=85) == [("numeric_parse_failure", "warn")]
    assert fails("date", date_ok=97, date_gate=97) == [("date_parse_failure", "info")]


def test_categories_and_outliers(spark):
    row = {"column": "c", "added": ["x"], "missing": [], "n_before": 3, "n_after": 1}
    assert [a.category for a in anomaly.category_anomalies(O, row)] == ["new_category", "constant_collapse"]
    assert anomaly.outlier_anomalies([{"column": "c", "n": 10_000, "outliers": 4}], "after") == []
    assert len(anomaly.outlier_anomalies([{"column": "c", "n": 10_000, "outliers": 5}, {"column": "d", "n": 10, "outliers": 1}], "after")) == 2


def test_all_anomalies_end_to_end(spark):
    b = [(i, "abc"[i % 3], "x" if i % 2 else "y", 10 + i % 5, "1" if i else "q", None if i < 5 else "v") for i in range(100)]
    a = [(i, "abd"[i % 3], "x", 10 + i % 5 if i < 90 else 1000, "1" if i > 3 else "q", None if i < 30 else "v") for i in range(95)] + [(1, "a", "x", 1, "1", "v")]
    kind = "id int, cat string, flat string, n int, num string, gaps string"
    engine = CompareEngine(Config(keys=["id"], columns=[ColumnRule("num", type="numeric")]), spark)
    r = engine.compare(spark.createDataFrame(b, kind), spark.createDataFrame(a, kind))
    found = {x.category for x in r.anomalies}
    assert {"row_count_change", "duplicate_key", "unmatched_key", "new_category", "missing_category", "constant_collapse", "numeric_outlier", "distribution_shift", "null_rate_change", "numeric_parse_failure"} <= found
    engine.close()


def test_key_detection(spark):
    df = spark.createDataFrame([(i, i // 2, i % 2, f"n{i}") for i in range(40)], "val int, shop_id int, line_no int, name string")
    from cellwright.operators.profile import profile as profiles

    assert keys.detect(df, profiles(df, df.columns), KeyOptions()) == ["val"]
    rest = df.drop("val", "name")
    assert keys.detect(rest, profiles(rest, rest.columns), KeyOptions()) == ["shop_id", "line_no"]
    assert keys.uniqueness(df.withColumn("k", F.when(F.col("val") > 3, F.col("val"))), ["k"], KeyOptions()) == (40, 36, 4)


def test_hot_key_ranks(spark):
    df = spark.createDataFrame([("hot" if i % 4 else f"k{i}", i) for i in range(2000)], "__key string, __row_id long")
    plain, dealt = (sorted(map(tuple, rows.ranked(df, hot_keys=h, rows_each=100).select("__key", "__row_id", "__rank").collect())) for h in (False, True))
    assert plain == dealt


def test_one_join_and_no_single_partition(spark):
    d = "/root/testdata/sf0.001"
    plan = lambda name: catalog.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
    rows_plan, counts, details = plan("row_status"), plan("cell_status_counts"), plan("diff_detail")
    assert len(re.findall("FullOuter", rows_plan)) == 1 and not re.search("SinglePartition|Python", rows_plan + counts + details)
    # cells of matched rows need an inner join only; they are classified once, and filtered above the generator
    assert all(len(re.findall("Join ", p)) == 1 and p.count("待确认") == details.count("待确认") for p in (counts, details))
    assert details.index("Filter") < details.index("Generate") and "transform" not in next(x for x in details.split("\n") if "Join" in x)


def test_queries_match_their_sql(spark):
    """A few queries here; the driver holds all of them against their SQL."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("cell_status_counts", "row_status_counts", "dup_key_groups", "profile_columns"):
        df = catalog.queries()[name](spark, d)
        columns = sorted(df.columns)
        found = con.sql(catalog.oracle_sql()[name])
        assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns)) for r in found.fetchall()), name
    assert set(catalog.queries()) == set(catalog.oracle_sql())


characters = st.text(st.sampled_from("aBé 1.,-()%¥$＄１ａ　 \t\n\r苹—"), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(characters, min_size=30, max_size=60))
def test_random_texts_against_duckdb(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    got = {r["i"]: (r["n"], r["x"]) for r in df.select("i", text.normalize(F.col("v"), StringOptions()).alias("n"), numbers.parse(F.col("v"), NumericOptions()).alias("x")).collect()}
    con = duckdb.connect()
    con.execute("create table t(i int, v varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    wide, narrow = text._WIDE + text._MINUS, text._NARROW + "-" * len(text._MINUS)
    sql = "select i, trim(regexp_replace(translate(v, ?, ?), '[ \\t\\n\\f\\r\\x{00A0}\\x{3000}]+', ' ', 'g')) as n, regexp_replace(translate(trim(v), ?, ?), '[ \\t\\n\\f\\r\\x{00A0}\\x{3000}¥$￥€£₹＄,]', '', 'g') as c from t"
    for i, n, c in con.execute(sql, [wide, narrow, wide, narrow]).fetchall():
        assert got[i][0] == n, (values[i],)
        if c.startswith("(") and c.endswith(")"):
            c = "-" + c[1:-1]
        c = c[:-1] if c.endswith("%") else c
        value = float(c) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", c, re.ASCII) else None
        assert got[i][1] == value, (values[i], c)


def test_labels_and_severity(spark):
    df = spark.createDataFrame([(s,) for s in m.SEVERITY], "status string").select("status", detail.severity(F.col("status")).alias("r"), detail.label(F.col("status")).alias("l"))
    assert {r["status"]: (r["r"], r["l"]) for r in df.collect()} == {s: (k, m.LABELS[s]) for s, k in m.SEVERITY.items()}


def test_config(tmp_path):
    c = build(Config, {"before": "a.csv", "columns": ["x", {"name": "y", "type": "date", "odd": 1}], "keys": None, "compare": {"numeric": {"rel_tol": 0.5}}, "unknown": 3})
    assert c.before.path == "a.csv" and [r.name for r in c.columns] == ["x", "y"] and c.keys == [] and c.compare.numeric.rel_tol == 0.5
    for name in ("c.yaml", "c.json"):
        dump_config(c, str(tmp_path / name))
        assert load_config(str(tmp_path / name)) == c
    with pytest.raises(ValueError):
        build(Config, [1])
    c.compare.string.null_equals_empty = False
    assert "" not in c.null_tokens() and "n/a" in c.null_tokens()


def test_categories_of_a_side_without_values(spark):
    plans = [("s", plan(Config(), "s", "s", m.STRING))]
    full = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    none = spark.createDataFrame([(None,), ("",)], "s string")
    many = spark.createDataFrame([(f"v{i}",) for i in range(70)], "s string")
    changes = lambda b, a: [(r["added"], r["missing"], r["n_before"], r["n_after"]) for r in anomaly.category_changes(anomaly.categories(b, plans), anomaly.categories(a, plans)).collect()]
    assert changes(full, none) == [([], ["a", "b", "c"], 3, 0)] and changes(none, full) == [(["a", "b", "c"], [], 0, 3)]
    assert changes(full, many) == [] and changes(many, none) == [] and changes(none, none) == []


def test_quartiles_are_exact_both_ways(spark):
    plans = [(c, plan(Config(), c, c, m.NUMERIC)) for c in ("x", "y", "z")]
    df = spark.range(20_011).select((F.col("id") * 7919 % 20_011).cast("string").alias("x"), F.when(F.col("id") % 3 == 0, "5").otherwise((F.col("id") % 11).cast("string")).alias("y"), F.when(F.col("id") < 2, F.col("id").cast("string")).alias("z"))
    one, many = (sorted(tuple(r) for r in anomaly.numeric_stats(df, plans, one_task=k).collect()) for k in (True, False))
    assert one == many and one[0][:2] == ("x", 20_011)


def test_key_detection_tries_named_columns_together(spark):
    o = KeyOptions()
    found = lambda df: keys.detect(df, profiler.profile(df, df.columns), o)
    rows = [(str(i // 6), str(i // 2 % 3), str(i % 2), "x") for i in range(24)]
    assert found(spark.createDataFrame(rows, "a_id string, b_no string, c_code string, d string")) == ["a_id", "b_no", "c_code"]
    assert found(spark.createDataFrame([(str(i), str(i), str(i)) for i in range(9)], "z string, k_id string, y string")) == ["k_id"]
    assert found(spark.createDataFrame([(None if i == 3 else str(i), str(i), str(i)) for i in range(9)], "k_id string, y string, z string")) == ["z"]
