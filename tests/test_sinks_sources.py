from __future__ import annotations

import csv
import io
import json
import sqlite3
import zipfile

import pytest

from sheaf.operators import queue as Q
from sheaf.sinks import writers as K
from sheaf.sources import readers as S


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(1, "=1+1", ["a", None], None), (2, "plain", [], "ü")], "k int, t string, l array<string>, n string")


def test_csv_is_safe(rows, tmp_path):
    K.write_csv(rows.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    got = list(csv.DictReader(io.StringIO(text)))
    assert got[0]["t"] == "'=1+1" and json.loads(got[0]["l"]) == ["a", None]


def test_json_sqlite_xlsx(rows, tmp_path):
    K.write_json(rows, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())[1] == {"k": 2, "t": "plain", "l": [], "n": "ü"}
    K.write_sqlite(rows, str(tmp_path / "d.sqlite"))
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        assert db.execute("SELECT k, t, n FROM data ORDER BY k").fetchall() == [("1", "=1+1", None), ("2", "plain", "ü")]
    K.write_xlsx(rows, str(tmp_path / "d.xlsx"))
    with zipfile.ZipFile(tmp_path / "d.xlsx") as z:
        assert "'=1+1" in z.read("xl/worksheets/sheet1.xml").decode()


def test_write_once_manifest_bundle_promote(tmp_path):
    K.write_once(str(tmp_path / "a"), b"x")
    with pytest.raises(FileExistsError):
        K.write_once(str(tmp_path / "a"), b"y")
    assert K.manifest(str(tmp_path))["a"]["bytes"] == 1
    assert zipfile.ZipFile(K.bundle(str(tmp_path))).namelist() == ["a"]
    assert not K.promote(str(tmp_path / "p"), "r1", True, False) and K.promote(str(tmp_path / "p"), "r1", True, True)


def test_manifest_pages_and_fixtures(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a")
    (tmp_path / "b.html.gz").write_bytes(S.gzip_fixture("<p>b"))
    (tmp_path / "c.html.gz").write_bytes(b"broken")
    (tmp_path / "manifest.json").write_text(json.dumps({"pages": [{"path": "b.html.gz", "url": "u1"}, {"path": "a.html", "url": "u2"}], "details": []}))
    got = S.manifest_pages(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [(r["url"], r["html"]) for r in got] == [("u1", "<p>b"), ("u2", "<p>a")]
    assert S.fixtures(spark, str(tmp_path)).where("error is not null").count() == 1
    assert S.gzip_fixture("x") == S.gzip_fixture("x")


def test_record_lines_are_validated(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"vin":"A","year":2019}\n{"vin":"A","nope":1}\n{broken\n{"vin":"B","vin":"C"}\n{"year":"x"}\n')
    good, bad = S.records(spark, str(tmp_path / "r.jsonl"))
    assert [r["vin"] for r in good.collect()] == ["A"]
    assert bad.count() == 4


def test_recent_jobs_and_delays(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0)], "job_id int, at double")
    assert Q.latest_rows(df, "job_id", "at", 1).collect()[0]["job_id"] == 2
