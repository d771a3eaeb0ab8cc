"""Files in and out, and the five analyses from paths."""

from __future__ import annotations

import csv
import importlib.util
import io
import json
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import tools
from tessera.sources import documents, files, logs, records, tabular
from tests.test_invoices import CLEAN

LOG = "2024-03-01 10:00:00 ERROR [db] lost 1 row\r\n\r\n2024-03-01 10:01:00 INFO [db] fine\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_csv_types(spark, folder):
    (folder / "t.csv").write_text('i,g,f,b,s,n,e\n1,1,1.5,True,"a ""q"",\nb",NA,\n2,,2,False,c,null,\n')
    df = tabular.read_table(spark, str(folder / "t.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "g": "double", "f": "double", "b": "boolean", "s": "string", "n": "double", "e": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, 1.0, 1.5, True, 'a "q",\nb', None, None), (2, None, 2.0, False, "c", None, None)]
    with pytest.raises(ValueError, match="unsupported"):
        tabular.read_table(spark, str(folder / "t.doc"))
    if importlib.util.find_spec("openpyxl") is None:
        with pytest.raises(RuntimeError, match="openpyxl"):
            tabular.read_table(spark, str(folder / "t.xlsx"))


def test_logs_of_all_kinds(spark, folder):
    (folder / "a.log").write_text(LOG)
    (folder / "sub").mkdir()
    (folder / "sub" / "b.txt").write_bytes("é latin\n".encode("latin-1") + b"x" * 20)
    (folder / "c.bin").write_text("ERROR not a log name")
    (folder / "d.log").write_bytes(bytes(range(128, 256)) * 4)
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        z.writestr("in/e.out", "line one\nline two")
        z.writestr("in/f.md", "ignored")
    found = {}
    for r in logs.read_logs(spark, str(folder)).collect():
        found.setdefault(r["source_file"].rsplit("/", 1)[1], []).append((r["line_no"], r["line"]))
    assert {k: sorted(v) for k, v in found.items()} == {
        "a.log": [(1, "2024-03-01 10:00:00 ERROR [db] lost 1 row"), (2, ""), (3, "2024-03-01 10:01:00 INFO [db] fine")],
        "b.txt": [(1, "é latin"), (2, "x" * 20)], "e.out": [(1, "line one"), (2, "line two")],
    }
    assert logs.read_logs(spark, str(folder / "c.bin")).count() == 1
    split = logs.read_split_logs(spark, str(folder / "a.log")).orderBy("source_file", "line_no").collect()
    assert [r["line"] for r in split] == ["2024-03-01 10:00:00 ERROR [db] lost 1 row", "", "2024-03-01 10:01:00 INFO [db] fine"]


def test_records_and_configs(spark, folder):
    (folder / "r.json").write_text(json.dumps({"totalSize": 1, "records": [{"Id": 1, "A": {"b": None}}, {"Id": 2}]}))
    assert sorted(r["Id"] for r in records.read_records(spark, str(folder / "r.json")).collect()) == [1, 2]
    (folder / "c.yaml").write_text("type_casts: {id: string}\n")
    assert records.read_config(str(folder / "c.yaml")).type_casts == {"id": "string"}
    (folder / "e.json").write_text("")
    assert records.read_config(str(folder / "e.json")) is None


def test_writers(spark, folder):
    df = spark.createDataFrame([(1, "ü"), (2, None)], "a int, b string")
    files.write_csv_file(df, str(folder / "o.csv"))
    assert (folder / "o.csv").read_bytes().startswith(b"\xef\xbb\xbf") and list(csv.reader((folder / "o.csv").open(encoding="utf-8-sig"))) == [["a", "b"], ["1", "ü"], ["2", ""]]
    files.write_json_file(df, str(folder / "o.json"))
    assert json.loads((folder / "o.json").read_text()) == [{"a": 1, "b": "ü"}, {"a": 2, "b": None}]
    files.write_csv(df, str(folder / "dir"))
    assert spark.read.csv(str(folder / "dir"), header=True).count() == 2
    assert files.output_name("/x/orders_raw.json", "csv") == "/x/orders_transformed.csv" and files.cleaned_name("/x/a.csv") == "/x/a_cleaned.csv"


def test_too_many_rows_for_one_file(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="directory"):
        files.write_json_file(spark.range(4), str(folder / "x.json"))


def test_pdf_through_an_extractor(spark, folder):
    (folder / "a.pdf").write_bytes(b"good")
    (folder / "b.pdf").write_bytes(b"bad")

    def extractor(content):
        if content == b"bad":
            raise ValueError("broken")
        return "text", [[["a", None]]]

    found = {r["doc_id"].rsplit("/", 1)[1]: r for r in documents.read_pdfs(spark, str(folder), extractor).collect()}
    assert found["a.pdf"]["text"] == "text" and found["a.pdf"]["tables"] == [[["a", None]]]
    assert found["b.pdf"]["text"] is None and "broken" in found["b.pdf"]["error"]


def test_analyses_from_paths(spark, folder):
    (folder / "t.csv").write_text("id,amount\n1,5\n1,5\n2,\n")
    found = tools.profile_dataset(spark, str(folder / "t.csv"))
    assert found["status"] == "success" and found["totals"]["duplicate_rows"] == 1 and spark.read.csv(found["cleaned_file"], header=True).count() == 2
    (folder / "logs").mkdir()
    (folder / "logs" / "a.log").write_text(LOG)
    report = tools.analyze_logs(spark, str(folder / "logs"), year=2024)
    assert report["status"] == "success" and report["summary"]["errors"] == 1
    both = tools.compare_incidents(spark, report["output_files"]["report"], report["output_files"]["report"])
    assert both["similarity_score"] == 100.0
    assert tools.analyze_logs(spark, str(folder / "logs"), time_range="2020-01-01/2020-01-02")["status"] == "error"
    (folder / "x_raw.json").write_text(json.dumps({"data": [{"Country": "DE", "Email": "a@b.co"}]}))
    made = tools.transform_records(spark, str(folder / "x_raw.json"), enrichers=["geo_lookup"])
    rows = list(csv.DictReader(open(made["output_file"], encoding="utf-8-sig")))
    assert made["output_file"].endswith("x_transformed.csv") and rows[0]["continent"] == "Europe"
    (folder / "inv").mkdir()
    (folder / "inv" / "i.txt").write_text(CLEAN)
    assert tools.process_invoices(spark, str(folder / "inv"), today="2024-06-01", output=str(folder / "out")).first()["status"] == "passed"
    assert any((folder / "out").glob("file=invoice_A-17/*.json"))


def test_foreseen_failures(spark, folder):
    (folder / "t.doc").write_text("x")
    (folder / "none.json").write_text('{"data": []}')
    (folder / "bad.json").write_text("{")
    for found in (
        tools.profile_dataset(spark, "/no/such"), tools.profile_dataset(spark, str(folder / "t.doc")), tools.analyze_logs(spark, "/no/such"), tools.compare_incidents(spark, "/no", "/no"),
        tools.transform_records(spark, str(folder / "none.json")), tools.transform_records(spark, str(folder / "bad.json")), tools.transform_records(spark, "/no", output_format="xml"),
        tools.compare_incidents(spark, str(folder / "bad.json"), str(folder / "bad.json")),
    ):
        assert found["status"] == "error" and found["error"]


def by_python(path):
    """Lines of a file as Python's own text mode has them, by the rules of encoding and binary content."""
    content = path.read_bytes()
    head = content[:8192]
    if sum(not (0x20 <= b < 0x7F or b in (9, 10, 13)) for b in head) > 0.1 * len(head):
        return []
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    return [(k, line.removesuffix("\n")) for k, line in enumerate(io.StringIO(text, newline=None), 1)]


CONTENTS = {
    "unix.log": "".join(f"line {i} é\n" for i in range(4000)).encode(), "windows.log": b"".join(b"row %d\r\n" % i for i in range(3000)), "no_end.log": b"x\n" * 2000 + b"last",
    "late_latin.log": b"ascii only\n" * 3000 + b"caf\xe9\n" + b"more\n" * 50, "old_mac.log": b"\r".join(b"m%d" % i for i in range(2500)) + b"\r", "mixed.log": b"a\rb\nc\r\n\r\rd\r\r\n\ne" * 400,
    "blank.log": b"\n\n\r\n\n", "empty.log": b"", "binary.log": bytes(range(128, 256)) * 200, "late_binary.log": b"text\n" * 2000 + bytes(range(128, 256)) * 90,
    "edge_text.log": b"x" * 7373 + b"\x01" * 819 + b"\x01" * 50, "edge_binary.log": b"x" * 7372 + b"\x01" * 820, "one.log": b"alone", "cut.log": "é".encode()[:1] + b"abcdefghijkl\n",
}


@pytest.mark.parametrize("split", ["1000", "128m"])
def test_lines_of_split_files(spark, folder, split):
    """Numbers, encodings and binary files are those of whole files, though a file lies in many splits."""
    for name, content in CONTENTS.items():
        (folder / name).write_bytes(content)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = {}
        for r in logs.read_logs(spark, str(folder)).collect():
            found.setdefault(r["source_file"].rsplit("/", 1)[1], []).append((r["line_no"], r["line"]))
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    for name in CONTENTS:
        assert sorted(found.get(name, [])) == by_python(folder / name), name


def test_archives(spark, folder):
    """Members of any encoding, nested folders and damaged parts; what can't be read counts as a failure, the rest is read."""
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in CONTENTS.items():
            z.writestr(f"deep/{name}", content)
        z.writestr("deep/notes.md", "ignored")
    (folder / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    with zipfile.ZipFile(folder / "half.zip", "w") as z:
        z.writestr("good.log", LOG)
        z.writestr("bad.log", "2024-03-01 10:00:00 ERROR [db] damaged\n" * 100)
    raw = bytearray((folder / "half.zip").read_bytes())
    raw[raw.rindex(b"damaged")] ^= 1
    (folder / "half.zip").write_bytes(raw)
    rows = logs.read_logs(spark, str(folder)).collect()
    found = {}
    for r in rows:
        found.setdefault(r["source_file"].split("/in/", 1)[1], []).append((r["line_no"], r["line"]))
    for name, content in CONTENTS.items():
        (folder / name).write_bytes(content)
        assert sorted(found.get(f"a.zip!/deep/{name}", [])) == by_python(folder / name), name
    assert found["broken.zip"] == found["half.zip!/bad.log"] == [(0, None)] and len(found["half.zip!/good.log"]) == 3
    (folder / "only").mkdir()
    shutil.copy(folder / "half.zip", folder / "only" / "half.zip")
    report = tools.analyze_logs(spark, str(folder / "only"), year=2024)
    assert report["unreadable_files"] == 1 and report["summary"]["parse_failures"] == 1 and report["summary"]["total_lines"] == 3
    stored = json.loads(open(report["output_files"]["report"]).read())
    assert stored["summary"]["parse_failures"] == 1


def test_members_are_dealt_to_tasks(spark, folder):
    with zipfile.ZipFile(folder / "many.zip", "w") as z:
        for i in range(40):
            z.writestr(f"{i}.log", f"line of {i}\n" * 3)
    found = logs.archived_lines(spark, str(folder / "many.zip"))
    assert found.rdd.getNumPartitions() > 1 and found.count() == 120
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_single_files_from_many_tasks(spark, folder):
    """More rows than any bound, in order, from several parts; nested values, quotes and nulls; empty tables."""
    df = spark.range(0, 5000, 1, 7).select("id", F.concat(F.lit('q"uote, '), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, F.array("id")).alias("list"))
    files.write_json_file(df, str(folder / "many.json"))
    rows = json.loads((folder / "many.json").read_text())
    assert [r["id"] for r in rows] == list(range(5000)) and rows[0] == {"id": 0, "text": 'q"uote, 0', "list": [0]} and rows[1]["list"] is None
    files.write_csv_file(df, str(folder / "many.csv"))
    lines = list(csv.reader((folder / "many.csv").open(encoding="utf-8-sig")))
    assert lines[0] == ["id", "text", "list"] and [int(r[0]) for r in lines[1:]] == list(range(5000)) and lines[1][1:] == ['q"uote, 0', "[0]"]
    files.write_json_file(df.limit(0), str(folder / "none.json"))
    files.write_csv_file(df.limit(0), str(folder / "none.csv"), mark=False)
    assert json.loads((folder / "none.json").read_text()) == [] and (folder / "none.csv").read_text() == "id,text,list\n"
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["many.csv", "many.json", "none.csv", "none.json"]


def test_paths_of_other_stores(spark, folder):
    """A path with a scheme is found, read and written beside its input."""
    (folder / "t.csv").write_text("email,amount\na@b.co,5\nbroken@,5\n,7\n")
    found = tools.profile_dataset(spark, f"file://{folder}/t.csv")
    assert found["status"] == "success" and found["report_file"] == f"file://{folder}/t_profile.json"
    stored = json.loads((folder / "t_profile.json").read_text())
    assert stored["issues"]["invalid_emails"]["email"] == {"count": 1, "samples": ["broken@"]} and stored["cleaned_file"].endswith("t_cleaned.csv")
    (folder / "logs").mkdir()
    (folder / "logs" / "a.log").write_text(LOG)
    assert tools.analyze_logs(spark, f"file://{folder}/logs", year=2024)["summary"]["total_lines"] == 3
    assert (folder / "incident_report.json").exists()


def test_samples_follow_the_file(spark, folder):
    """The first faults in the order of the file, whatever the types of other columns."""
    (folder / "t.csv").write_text("email,n\n" + "".join(f"bad{99 - i}@,{i}\n" for i in range(50)))
    found = tools.profile_dataset(spark, str(folder / "t.csv"), cleaned=False)
    assert found["samples"]["emails"]["email"] == [f"bad{99 - i}@" for i in range(10)]


def test_ragged_records(spark, folder):
    """Fields of any record, at any depth, with one type each; odd names; several documents; no Python workers."""
    docs = {
        "a.json": {"data": [{"id": 1, "x": {"y": 1.5, "odd `name` <OBJECT>": [1]}}, {"id": 2, "x": None, "only": None}]}, "b.json": [{"id": "three", "x": {"y": 2}}, 7, {"tags": [{"k": "v"}, {"n": 1}]}],
        "c.json": {"id": 12345678901234, "flag": True},
    }
    for name, doc in docs.items():
        (folder / name).write_text(json.dumps(doc))
    (folder / "d.json").write_text("{no json")
    df = records.read_records(spark, str(folder))
    assert "Python" not in df._jdf.queryExecution().toString()
    rows = [r.asDict(recursive=True) for r in df.collect()]
    assert len(rows) == 6 and records.unreadable_documents(spark, str(folder)) == 1
    assert sorted(str(r["id"]) for r in rows) == ["1", "12345678901234", "2", "None", "None", "three"]
    assert {r["value"] for r in rows} == {None, 7} and [r["x"]["y"] for r in rows if r["x"]] and dict(df.dtypes)["flag"] == "boolean"
    assert next(r for r in rows if r["id"] == "1")["x"]["odd `name` <OBJECT>"] == [1]
    assert next(r for r in rows if r["tags"])["tags"] == [{"k": "v", "n": None}, {"k": None, "n": 1}]
