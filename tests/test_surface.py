"""Reports, command line, page, stream."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from cellwright import cli
from cellwright.config import ColumnRule, Config, SourceSpec
from cellwright.gui import browse, make_server
from cellwright.plans.engine import CompareEngine
from cellwright.report import console, write_reports
from cellwright.sources.excel import Workbook
from cellwright.streaming.recompare import recompare


@pytest.fixture
def files(tmp_path):
    (tmp_path / "b.csv").write_text("id,v,s\n1,1.50,x</script>\n2,2,y\n3,3,z\n", encoding="utf-8")
    (tmp_path / "a.csv").write_text("id,v,s\n1,1.5,x</script>\n2,9,q|r\n4,4,w\n", encoding="utf-8")
    return tmp_path


def test_reports(spark, files):
    c = Config(before=SourceSpec(str(files / "b.csv")), after=SourceSpec(str(files / "a.csv")), keys=["id"], output_dir=str(files / "out"), work_db=str(files / "db"), columns=[ColumnRule("s", mask=True)])
    c.report.formats = ["console", "html", "xlsx", "md", "csv", "odd"]
    engine, said = CompareEngine(c, spark), []
    out = write_reports(engine.run(), said.append)
    engine.close()
    assert out["odd"].startswith("failed") and "different" in said[0]
    page = (files / "out" / "report.html").read_text(encoding="utf-8")
    payload = json.loads(page.split('id="payload">')[1].split("</script>")[0])
    assert payload["stats"]["cells"]["VALUE_DIFF"] == 2 and len(payload["detail"]) == 3 and not payload["diffTruncated"] and len(payload["sides"]) == 2
    assert any(r[2] == "s" and r[5] == "***" for r in payload["detail"])
    md = (files / "out" / "report.md").read_text(encoding="utf-8")
    assert "## 1. Totals" in md and "***" in md
    table = (files / "out" / "diff_detail.csv").read_bytes()
    assert table.startswith(b"\xef\xbb\xbf") and table.count(b"\n") == 4
    book = Workbook((files / "out" / "report.xlsx").read_bytes())
    assert {"Overview", "Columns", "Differences", "Only before", "Only after"} <= set(book.sheets) and len(list(book.rows("Differences"))) == 4
    assert spark.read.parquet(str(files / "db" / "diff_detail")).count() == 3


def test_console_width():
    assert console.width("苹果a") == 5 and "苹果" in console.table(["列"], [["苹果"]])


def test_command_line(spark, files, capsys):
    b, a, out = str(files / "b.csv"), str(files / "a.csv"), str(files / "o")
    assert cli.main(["compare", "-b", b, "-a", a, "-k", "id", "-o", out, "--html", "-q", "--fail-on-diff"]) == 2
    assert cli.main(["compare", "-b", b, "-a", b, "-k", "id", "-o", out, "--formats", "console", "--fail-on-diff", "--no-anomaly"]) == 0
    assert "consistent" in capsys.readouterr().out
    assert cli.main(["compare", "-b", b]) == 1 and cli.main(["compare", "-b", b, "-a", str(files / "none.csv")]) == 1
    assert cli.main(["profile", b]) == 0
    assert "suggested key: id" in capsys.readouterr().out
    config = str(files / "c.yaml")
    assert cli.main(["init-config", config]) == 0 and cli.main(["init-config", config]) == 1 and cli.main(["init-config", config, "--force"]) == 0
    args = cli.parser().parse_args(["compare", "-c", config, "-b", b, "-a", a, "--tolerance", "0.1", "--delimiter", "\\t", "--delimiter-after", ";", "--row-index", "--no-auto-key", "--treat-format-only-as-diff"])
    c = cli.build_config(args)
    assert (c.compare.numeric.rel_tol, c.before.delimiter, c.after.delimiter, c.key_options.use_row_index_if_no_key, c.key_options.auto_detect, c.report.treat_format_only_as_diff) == (0.1, "\t", ";", True, False, True)


def test_page(spark, files):
    server = make_server(root=str(files))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, data=None):
        body = None if data is None else json.dumps(data).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body), timeout=120) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    settings = {"before": str(files / "b.csv"), "after": str(files / "a.csv"), "output_dir": str(files / "gui"), "report": {"formats": ["html"]}}
    assert call("/")[0] == 200 and call("/none")[0] == 404 and json.loads(call("/api/status")[1])["state"] == "idle"
    assert {e["name"] for e in json.loads(call("/api/browse", {"path": str(files)})[1])["entries"]} >= {"a.csv", "b.csv"}
    assert call("/api/browse", {"path": "/etc"})[0] == 400 and call("/api/inspect", {"config": {"before": "/none.csv", "after": "/none.csv"}})[0] == 400
    found = json.loads(call("/api/inspect", {"config": settings})[1])
    assert found["keys"] == ["id"] and {c["before"]: c["type"] for c in found["columns"]}["v"] == "numeric"
    assert "before" in json.loads(call("/api/export-config", {"config": settings})[1])["text"]
    assert call("/api/run", {"config": settings})[0] == 200
    for _ in range(300):
        state = json.loads(call("/api/status")[1])
        if state["state"] != "running":
            break
        time.sleep(0.3)
    assert state["state"] == "done" and state["files"] == ["report.html"]
    assert call("/files/report.html")[0] == 200 and call("/files/..%2F..%2Fb.csv")[0] == 404
    server.shutdown()
    with pytest.raises(ValueError):
        make_server("0.0.0.0")
    assert browse(str(files), None)["path"]


def test_stream(spark, files, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("1,a\n2,b\n")
    reference = spark.createDataFrame([("1", "a"), ("2", "c")], "id string, v string")
    stream = spark.readStream.schema("id string, v string").csv(str(tmp_path / "in"))
    c, seen = Config(keys=["id"]), {}
    c.anomaly.enabled = False
    recompare(stream, reference, c, lambda r, n: seen.__setitem__(n, r.stats), str(tmp_path / "ck")).awaitTermination(120)
    assert [s.count("VALUE_DIFF") for s in seen.values()] == [1]
