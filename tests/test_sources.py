"""Readers, row ids, text casts."""

import datetime as dt

import pytest

from cellwright.config import SourceSpec
from cellwright.sources import excel
from cellwright.sources.delimited import sniff, unique_names
from cellwright.sources.load import load
from cellwright.sources.rowid import with_row_id
from cellwright.sources.text import as_text


def rows(spark, path, limit=None, **spec):
    side = load(spark, SourceSpec(str(path), **spec), limit=limit)
    got = side.df.orderBy("__row_id").collect()
    assert [r["__row_id"] for r in got] == list(range(len(got)))
    return side.columns, [tuple(r[c] for c in side.columns) for r in got], side


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id,a,a\n1,"x, ""y""\nz",\n2,,"  q "\n', encoding="utf-8")
    columns, got, side = rows(spark, f)
    assert columns == ["id", "a", "a_1"] and got == [("1", 'x, "y"\nz', ""), ("2", "", "  q ")] and len(side.warnings) == 1
    assert rows(spark, f, header=False)[1][0] == ("id", "a", "a") and rows(spark, f, header=False)[0] == ["column0", "column1", "column2"]
    assert len(rows(spark, f, limit=1)[1]) == 1


@pytest.mark.parametrize(("name", "text", "spec"), [("a.tsv", "id\tv\n1\tx\n", {}), ("a.psv", "id|v\n1|x\n", {}), ("a.txt", "id;v\n1;x\n2;y\n", {}), ("b.csv", "id#v\n1#x\n", {"delimiter": "#"}), ("s.csv", "made by\nsomebody\nid,v\n1,x\n", {"skip_rows": 2})])
def test_delimiters(spark, tmp_path, name, text, spec):
    f = tmp_path / name
    f.write_text(text, encoding="utf-8")
    columns, got, _ = rows(spark, f, **spec)
    assert columns == ["id", "v"] and got[0] == ("1", "x")


@pytest.mark.parametrize("encoding", ["gbk", "utf-8-sig", "latin-1", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    f = tmp_path / "a.csv"
    word = "é" if encoding == "latin-1" else "苹果"
    f.write_text(f"id,{word}\n1,{word}x\n", encoding=encoding)
    columns, got, _ = rows(spark, f, encoding={"latin-1": "iso-8859-1"}.get(encoding, encoding))
    assert columns == ["id", word] and got == [("1", word + "x")]


def test_parquet_and_globs(spark, tmp_path):
    spark.createDataFrame([(1, 1.5, dt.date(2024, 1, 5))], "id int, v double, d date").write.parquet(str(tmp_path / "p1.parquet"))
    spark.createDataFrame([(2, True)], "id int, w boolean").write.parquet(str(tmp_path / "p2.parquet"))
    columns, got, _ = rows(spark, tmp_path / "p*.parquet", kind="parquet")
    assert set(columns) == {"id", "v", "d", "w"} and {dict(zip(columns, r, strict=True))["id"] for r in got} == {"1", "2"}


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": {"a": [1]}}\n{"id": 2, "v": null}\n')
    (tmp_path / "b.json").write_text('[{"id": 1, "v": "x"},\n {"id": 2, "v": "y"}]')
    assert rows(spark, tmp_path / "a.jsonl")[1] == [("1", '{"a":[1]}'), ("2", None)]
    assert rows(spark, tmp_path / "b.json")[1] == [("1", "x"), ("2", "y")]


def test_excel(spark, tmp_path):
    f = tmp_path / "a.xlsx"
    excel.write(str(f), [("one", [["id", "v", "v"], [1, 2.5, "x<&>"], [2, None, "苹果"], [None, None, None], [3.0, 1e20, ("filled", 0)]]), ("two", [["a"], ["b"]])], ("FF0000",))
    columns, got, _ = rows(spark, f)
    assert columns == ["id", "v", "v_1"] and got == [("1", "2.5", "x<&>"), ("2", None, "苹果"), ("3", "1e+20", "filled")]
    assert rows(spark, f, sheet="two")[1] == [("b",)] and rows(spark, f, sheet=1)[0] == ["a"]
    with pytest.raises(ValueError, match="no sheet"):
        rows(spark, f, sheet="three")
    (tmp_path / "old.xls").write_bytes(b"")
    with pytest.raises(ValueError, match="xlsx"):
        rows(spark, tmp_path / "old.xls")
    assert excel._moment(45296) == "2024-01-05" and excel._moment(45296.5) == "2024-01-05 12:00:00" and excel._moment(0.25) == "06:00:00"


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        rows(spark, tmp_path / "none.csv")
    with pytest.raises(ValueError, match="unknown kind"):
        rows(spark, tmp_path / "none.csv", kind="odd")


def test_row_ids_are_consecutive_and_without_one_partition(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 > 0")
    got = with_row_id(df)
    assert [r["__row_id"] for r in got.orderBy("id").collect()] == list(range(df.count()))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert with_row_id(spark.range(0)).count() == 0


def test_text(spark):
    df = spark.sql("select 12345678.5D a, 0.0001D b, 1.5D c, 1e300D d, array(1, 2) e, timestamp_ntz '2024-01-05 08:00:00' f, cast(null as int) g, 100.0D h, true i, named_struct('x', 1) j")
    assert tuple(as_text(df).first()) == ("12345678.5", "0.0001", "1.5", "1.0E300", "[1, 2]", "2024-01-05 08:00:00", None, "100.0", "true", '{"x":1}')


def test_helpers():
    assert unique_names(["a", "", "a", "a_1", "a"]) == ["a", "column1", "a_1", "a_1_1", "a_2"]
    assert sniff(["a;b;c", "1;2,5;3"]) == ";" and sniff(["abc"]) == ","


def test_skip_rows_of_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('junk\n\nid,v\n1,"a\nb"\n2,c\n')
    (tmp_path / "b.csv").write_text('more, "x"\n\nid,v\n3,"d ""q""\n\ne"\n\n4,\n')
    rows = lambda name, skip: [tuple(r) for r in load(spark, SourceSpec(str(tmp_path / name), skip_rows=skip)).df.orderBy("__row_id").collect()]
    assert rows("a.csv", 2) == rows("a.csv", 1) == [("1", "a\nb", 0), ("2", "c", 1)]
    assert rows("*.csv", 2) == [("1", "a\nb", 0), ("2", "c", 1), ("3", 'd "q"\n\ne', 2), ("4", "", 3)]
    assert load(spark, SourceSpec(str(tmp_path / "a.csv"), skip_rows=2)).columns == ["id", "v"]


def test_plain_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("id,v\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    (tmp_path / "fed.csv").write_text('id,v\n1,"a\nb"\n')
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        plain = load(spark, SourceSpec(str(tmp_path / "plain.csv"))).df
        assert plain.rdd.getNumPartitions() > 1 and plain.count() == 2000 and plain.filter("v = 'x, \"7\"'").first()["id"] == "7"
        assert load(spark, SourceSpec(str(tmp_path / "fed.csv"))).df.first()["v"] == "a\nb"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
