"""Statuses of cells, rows and columns, end to end on tiny CSV files."""

import pytest

from cellwright import models as m
from cellwright.config import ColumnRule, Config, SourceSpec
from cellwright.plans.engine import CompareEngine


def run(spark, tmp_path, before, after, keys=("id",), **options):
    for name, text in (("before", before), ("after", after)):
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    c = Config(before=SourceSpec(str(tmp_path / "before.csv")), after=SourceSpec(str(tmp_path / "after.csv")), keys=list(keys))
    c.anomaly.enabled = options.pop("anomaly", False)
    for path, value in options.items():
        owner, *rest = path.split("__")
        at = c
        for part in [owner, *rest][:-1]:
            at = getattr(at, part)
        setattr(at, [owner, *rest][-1], value)
    engine = CompareEngine(c, spark)
    r = engine.run()
    r.cells = {(d["__key"], d["column_name"]): d["status"] for d in r.diff_detail.collect()}
    r.rows = {d["__key"]: d["row_status"] for d in r.row_status.collect()}
    r.by = {x.column: x for x in r.columns}
    engine.close()
    return r


def table(column, values):
    return f"id,{column}\n" + "".join(f"{i},{v}\n" for i, v in enumerate(values))


def pairs(spark, tmp_path, column, changes, **options):
    """The status of each change, in order."""
    q = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or v != v.strip() else v
    r = run(spark, tmp_path, table(column, [q(b) for b, _ in changes]), table(column, [q(a) for _, a in changes]), **options)
    return [r.cells.get((str(i), column), m.EQUAL) for i in range(len(changes))], r


F, V, N, T, E = m.FORMAT_ONLY, m.VALUE_DIFF, m.NULL_MISMATCH, m.TYPE_MISMATCH, m.EQUAL

CASES = [
    ("amount", [("1.50", "1.5"), ("1234", "1234.00"), ("0.10", "0.1")], {}, [F, F, F]),
    ("amount", [("1,234.50", "1234.5"), ("12,000", "12000.00")], {}, [F, F]),
    ("amount", [("¥1,200.00", "1200"), ("(300.50)", "-300.5")], {}, [F, F]),
    ("amount", [("100.00", "120.00"), ("1.5", "2.5")], {}, [V, V]),
    ("value", [("0.1", "0.10000000000000001"), ("1.0000000001", "1")], {}, [F, F]),
    ("value", [("100", "100.5"), ("100", "102")], {"compare__numeric__rel_tol": 0.01}, [F, V]),
    ("value", [("100", "100.4"), ("100", "100.6")], {"compare__numeric__rel_tol": 0.0, "compare__numeric__abs_tol": 0.5}, [F, V]),
    ("rate", [("12%", "12.00%")], {}, [F]),
    ("rate", [("12%", "0.12"), ("5", "5.0")], {"compare__numeric__percent_mode": "ratio"}, [F, F]),
    ("amount", [("1.234,50", "1234,5")], {"compare__numeric__decimal_separator": ","}, [F]),
    ("day", [("2024-01-05", "2024/01/05"), ("2024/03/09", "2024-03-09"), ("2024年4月1日", "2024-04-01")], {}, [F, F, F]),
    ("day", [("2024-01-05", "2024-01-05 00:00:00")], {}, [F]),
    ("time", [("2024-01-05 08:00:00", "2024-01-05 17:30:00"), ("2024-01-05 08:00:00", "2024-01-05T08:00:00Z")], {}, [V, F]),
    ("time", [("2024-01-05 08:00:00", "2024-01-05 08:00:03")], {"compare__date__tolerance_seconds": 5}, [F]),
    ("time", [("2024-01-05 08:00:10", "2024-01-05 08:00:50")], {"compare__date__granularity": "minute"}, [F]),
    ("time", [("2024-01-05 08:00:00", "2024/01/05T08:00")], {"compare__string__ignore_whitespace": True, "compare__string__case_insensitive": True}, [F]),
    ("day", [("05/01/2024", "2024-01-05"), ("15/01/2024", "2024-01-15")], {"columns": [ColumnRule("day", type="date")]}, [F, F]),
    ("day", [("01/05/2024", "2024-01-05")], {"columns": [ColumnRule("day", type="date")], "compare__date__day_first": False}, [F]),
    ("day", [("5.Jan.2024", "2024-01-05")], {"columns": [ColumnRule("day", type="date", date_formats=["%d.Jan.%Y"])]}, [F]),
    ("name", [("  apple ", "apple"), ("ba  nana", "ba nana")], {}, [F, F]),
    ("code", [("ＡＢＣ－１２３", "ABC-123"), ("（甲）", "(甲)"), ("ａｂ", "ab")], {}, [F, F, F]),
    ("name", [("Apple", "apple")], {}, [V]),
    ("name", [("Apple", "apple")], {"compare__string__case_insensitive": True}, [F]),
    ("note", [("N/A", ""), ("NULL", ""), ("", "null"), ("x", "x")], {}, [E, E, E, E]),
    ("note", [("text", "")], {}, [N]),
    ("note", [("", "NULL"), ("x", "x")], {"compare__string__null_equals_empty": False}, [N, E]),
    ("amount", [("待确认", "300"), ("200", "abc"), ("N/A", "100")], {"columns": [ColumnRule("amount", type="numeric")]}, [T, T, N]),
    ("flag", [("Y", "是"), ("no", "0"), ("true", "F"), ("maybe", "1")], {"columns": [ColumnRule("flag", type="boolean")]}, [F, F, V, T]),
    ("shop", [("001", "1"), ("010", "0010")], {}, [V, V]),
    ("order", [("1234567890123456789", "1234567890123456790")], {}, [V]),
    ("text", [("a\nｂ", "a\nb")], {}, [F]),
]


@pytest.mark.parametrize(("column", "changes", "options", "expected"), CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_cells(spark, tmp_path, column, changes, options, expected):
    assert pairs(spark, tmp_path, column, changes, **options)[0] == expected


def test_one_dirty_value_in_fifty(spark, tmp_path):
    changes = [(str(100 + i), str(100 + i)) for i in range(50)]
    changes[7] = ("107", "待确认")
    got, r = pairs(spark, tmp_path, "amount", changes)
    assert r.by["amount"].type == m.NUMERIC and got.count(T) == 1 and got.count(E) == 49


def test_rows(spark, tmp_path):
    r = run(spark, tmp_path, "id,v\nA,1\nB,2\nC,3\n", "id,v\nA,1\nB,9\nD,4\n")
    s = r.stats
    assert (s.matched, s.rows["SAME"], s.rows["CHANGED"], s.only_in_before, s.only_in_after) == (2, 1, 1, 1, 1)
    assert r.rows == {"A": m.SAME, "B": m.CHANGED, "C": m.ONLY_IN_BEFORE, "D": m.ONLY_IN_AFTER}
    assert (s.count("EQUAL"), s.count("VALUE_DIFF"), s.compared) == (1, 1, 2) and r.by["v"].count("EQUAL") == 1


def test_duplicate_keys_pair_in_order(spark, tmp_path):
    r = run(spark, tmp_path, "id,v\nA,1\nA,2\n", "id,v\nA,1\nA,2\nA,3\n")
    s = r.stats
    assert (s.duplicates["before"], s.duplicates["after"], s.only_in_after, s.severe) == (1, 1, 1, 0) and not s.consistent


def test_composite_key(spark, tmp_path):
    r = run(spark, tmp_path, "shop,day,v\n1,a,1\n1,b,2\n", "shop,day,v\n1,b,3\n1,a,1\n", keys=("shop", "day"))
    assert r.stats.matched == 2 and r.stats.severe == 1


def test_row_index(spark, tmp_path):
    r = run(spark, tmp_path, "v\na\nb\na\n", "v\na\nx\na\n", keys=(), key_options__auto_detect=False, key_options__use_row_index_if_no_key=True)
    assert r.stats.matched == 3 and r.stats.severe == 1 and r.stats.key_mode == "row_index"


def test_no_key(spark, tmp_path):
    with pytest.raises(ValueError, match="no key"):
        run(spark, tmp_path, "v\na\na\n", "v\na\na\n", keys=())


def test_detected_key_is_not_compared(spark, tmp_path):
    r = run(spark, tmp_path, "order_id,v\n1,a\n2,a\n3,b\n", "order_id,v\n1,a\n2,a\n3,c\n", keys=())
    assert r.stats.keys == ["order_id"] and r.stats.compared_columns == 1 and r.by["order_id"].mode == "key"


def test_renamed_key(spark, tmp_path):
    r = run(spark, tmp_path, "id,v\n1,a\n2,b\n", "number,v\n2,b\n1,c\n", column_map={"id": "number"})
    assert r.stats.matched == 2 and r.stats.count("VALUE_DIFF") == 1 and r.by["id"].mode == "key"


def test_schema_change(spark, tmp_path):
    r = run(spark, tmp_path, "id,x,y\n1,1,2\n", "id,x,z\n1,1,2\n", anomaly=True)
    assert (r.stats.only_before_columns, r.stats.only_after_columns) == (["y"], ["z"])
    assert [a.category for a in r.anomalies].count("schema_change") == 2
    assert (r.by["y"].mode, r.by["z"].mode) == ("only_before", "only_after")


def test_ignored_and_failed_rename(spark, tmp_path):
    r = run(spark, tmp_path, "id,note,old\n1,1,x\n", "id,note\n1,2\n", columns=[ColumnRule("note", ignore=True), ColumnRule("old", after_name="gone")])
    assert r.by["note"].mode == "ignored" and r.stats.severe == 0 and r.by["old"].mode == "only_before"


def test_column_map(spark, tmp_path):
    r = run(spark, tmp_path, "id,金额\n1,1\n", "id,amount\n1,2\n", column_map={"金额": "amount"})
    assert r.by["金额"].mode == "compared" and r.by["金额"].count("VALUE_DIFF") == 1


def test_format_only_is_consistent(spark, tmp_path):
    before, after = 'id,a,n\n1,1.50,1\n2,"2,000.00",1\n', "id,a,n\n1,1.5,1\n2,2000,1\n"
    r = run(spark, tmp_path, before, after)
    assert r.stats.format_only == 2 and r.stats.consistent
    assert not run(spark, tmp_path, before, after, report__treat_format_only_as_diff=True).stats.consistent


def test_mixed_row(spark, tmp_path):
    r = run(spark, tmp_path, "id,a,n\n1,1.50,1\n", "id,a,n\n1,1.5,2\n")
    row = r.row_status.first()
    assert (row["changed_columns"], row["severe_columns"], row["format_only_columns"]) == (2, 1, 1) and not r.stats.consistent


def test_empty_files(spark, tmp_path):
    r = run(spark, tmp_path, "id,v\n", "id,v\n", anomaly=True)
    assert r.stats.before_rows == 0 and r.stats.consistent


def test_reserved_names(spark, tmp_path):
    with pytest.raises(ValueError, match="reserved"):
        run(spark, tmp_path, "id,__key\n1,2\n", "id,__key\n1,2\n")


def test_first_map_wins(spark, tmp_path):
    r = run(spark, tmp_path, "id,a,b\n1,1,2\n", "id,b\n1,1\n", column_map={"a": "b"})
    assert any("both map" in w for w in r.warnings) and r.by["b"].mode == "only_before"


def test_frames_and_views(spark):
    b = spark.createDataFrame([(1, 1.5), (2, 2.5)], "id int, v double")
    a = spark.createDataFrame([(1, 1.5), (2, 3.5)], "id int, v double")
    engine = CompareEngine(Config(keys=["id"]), spark)
    assert engine.compare(b, a).stats.count("VALUE_DIFF") == 1
    assert spark.table("v_diff").select("key_id", "column_name").collect() == [("2", "v")]
    assert spark.table("v_row").count() == 2
    engine.close()


def test_exact_integers(spark, tmp_path):
    changes = [("2000000000", "2000000001"), ("5", "5.0")]
    assert pairs(spark, tmp_path, "n", changes)[0] == [F, F]
    assert pairs(spark, tmp_path, "n", changes, compare__numeric__exact_integers=True)[0] == [V, F]
