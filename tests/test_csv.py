import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rosterline.sources import csv_check, csv_scan, exports, tenants, upload

HEAD = "id,name,email,status\n"


def write(folder, name, text):
    data = text if isinstance(text, bytes) else text.encode()
    (folder / name).write_bytes(data)
    return str(folder)


def verdicts(spark, folder):
    rows = csv_check.check_files(spark, str(folder)).collect()
    return {r.file.rsplit("/", 1)[1]: (r.status, r.line_number) for r in rows}


def strict_reader_line(text):
    """Line at which Python's strict reader fails, or None."""
    reader = csv.reader(io.StringIO(text, newline=""), strict=True)
    try:
        for _ in reader:
            pass
    except csv.Error:
        return reader.line_num
    return None


CASES = {
    "valid": HEAD + "".join(f"{i},n{i},e{i}@x.org,ok\n" for i in range(50)),
    "unclosed": HEAD + "".join(f"{i},n,e,ok\n" for i in range(6)) + '7,n,"open,ok\n',
    "unclosed_last_column": HEAD + '1,n,e,"open\n2,n,e,ok\n3,n,e,ok\n',
    "stray": HEAD + '1,n,"a"b@x,ok\n2,n,e,ok\n',
    "stray_in_multi_line": HEAD + '1,n,"a\nb"c,ok\n',
    "accepted": HEAD + '"a,b","a""b","x,""y",x"y"z\n5" pipe,"two\nlines",c,d\n\n1,2,3,4\n',
    "crlf": HEAD.replace("\n", "\r\n") + '1,"a\r\nb",c,d\r\n',
}


def test_structure_cases(spark, tmp_path):
    for name, text in CASES.items():
        write(tmp_path, f"{name}.csv", text)
    write(tmp_path, "bad_bytes.csv", HEAD.encode() + b"1,\xff\xfe,c,d\n")
    write(tmp_path, "ignored.txt", '"open')
    found = verdicts(spark, tmp_path)
    assert found.pop("bad_bytes.csv") == ("invalid_utf8", 1)
    assert {n: line for n, (_, line) in found.items()} == {f"{n}.csv": strict_reader_line(t) for n, t in CASES.items()}
    assert found["unclosed.csv"][0] == found["unclosed_last_column.csv"][0] == "unclosed_quote"
    assert found["stray.csv"] == ("stray_text", 2)


def test_structure_agrees_with_a_strict_reader(spark, tmp_path):
    rng = random.Random(7)
    texts = {
        f"f{i}.csv": "".join(rng.choice('",ab\n\n"') for _ in range(rng.randint(1, 60))) for i in range(200)
    }
    for name, text in texts.items():
        write(tmp_path, name, text)
    found = verdicts(spark, tmp_path)
    assert {n: found[n][1] for n in texts} == {n: strict_reader_line(t) for n, t in texts.items()}


def test_structure_over_many_splits_and_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_check, "RUN_LINES", 16)
    good = "".join(f'{i},"a ""quoted"" word",b\n' for i in range(5000))
    texts = {"ok.csv": good, "late.csv": good + '1,"x"y,z\n' + good, "open.csv": good + '1,2,"x\n' + "a,b,c\n" * 3000}
    for name, text in texts.items():
        write(tmp_path, name, text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = verdicts(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {n: found[n][1] for n in texts} == {n: strict_reader_line(t) for n, t in texts.items()}


def test_scan_pads_short_rows_and_sets_long_rows_aside(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEAD + '1,n,e,ok\n2,short\n3,"n, m",e,ok,extra\n4,"x, y",02139,NA\n')
    scanned = csv_scan.scan(spark, path)
    rows = {r.id: r for r in scanned.rows.collect()}
    assert set(rows) == {"1", "2", "4"}
    assert rows["2"]._short and rows["2"].email is None and not rows["1"]._short
    assert (rows["4"]["name"], rows["4"].email, rows["4"].status) == ("x, y", "02139", "NA")
    assert [(r.raw, r.fields) for r in scanned.quarantine.collect()] == [('3,"n, m",e,ok,extra', 5)]
    assert (scanned.rows.count(), scanned.quarantine.count()) == (3, 1)
    assert [r.status for r in scanned.rows.select("status").collect()] == ["ok", None, "NA"]


def test_rows_with_bare_and_doubled_quotes_are_counted_by_the_grammar(spark, tmp_path):
    long = ['5" x,6" y,z', '"a ""b"", c",d,e', "a,b,", '"p",q,""']
    short = ['"one ""only"", field"', '5" x']
    path = write(tmp_path, "a.csv", "\n".join(["a,b", *long, *short, '"x, ""y""",5" z', ""]))
    scanned = csv_scan.scan(spark, path)
    assert sorted((r.raw, r.fields) for r in scanned.quarantine.collect()) == sorted((t, 3) for t in long)
    assert {(r.a, r.b, r._short) for r in scanned.rows.collect()} == {
        ('one "only", field', None, True), ('5" x', None, True), ('x, "y"', '5" z', False)
    }


def test_upload_reads_each_file_by_its_header_and_loses_no_row(spark, tmp_path):
    for name, text in {
        "one.csv": "npi,email\n1,a@x.org\n2\n", "two [b].csv": "email,npi\nb@x.org,3\n", "open.csv": 'npi,email\n4,"x\n',
        "lines.csv": 'npi,email\n5,"c\nd"\n6,e,long\n', "empty.csv": "", "head.csv": "npi,email\n", "skip.txt": "npi\n9\n",
    }.items():
        write(tmp_path, name, text)
    found = upload.read(spark, str(tmp_path))
    assert {(r.npi, r.email, r._short) for r in found.rows.collect()} == {
        ("1", "a@x.org", False), ("2", None, True), ("3", "b@x.org", False), ("5", "c\nd", False)
    }
    assert [r.raw for r in found.quarantine.collect()] == ["6,e,long"]
    names = F.regexp_extract("file", "[^/]*$", 0).alias("name")
    verdicts = {r["name"]: (r.status, r.lines) for r in found.verdicts.select(names, "status", "lines").collect()}
    assert verdicts["empty.csv"] == ("ok", 0) and verdicts["open.csv"] == ("unclosed_quote", 2) and len(verdicts) == 6


def test_upload_of_nothing_but_rejected_files(spark, tmp_path):
    found = upload.read(spark, write(tmp_path, "open.csv", 'a\n"x\n'))
    assert found.rows.count() == found.quarantine.count() == 0 and found.verdicts.count() == 1


def test_scan_of_multi_line_fields(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEAD + '1,"two\nlines",e,ok\n2,n,e,ok,extra\n3,"a\n,b",e\n')
    assert csv_check.check_files(spark, path).first().multi_line
    scanned = csv_scan.scan(spark, path, multi_line=True)
    assert {r.id: r["name"] for r in scanned.rows.collect()} == {"1": "two\nlines", "3": "a\n,b"}
    assert scanned.quarantine.first().fields == 5


def test_ingest_report(spark, tmp_path):
    rows = "".join(f"{i},User{i},user{i}@example.com,active\n" for i in range(12000))
    scanned = csv_scan.scan(spark, write(tmp_path, "a.csv", HEAD + rows))
    for report in (csv_scan.ingest_report(scanned), csv_scan.ingest_report(scanned, 5, ["id"])):
        found = {r["column"]: (r.total_rows, r.inferred_type) for r in report.collect()}
        assert len(found) == 4 and all(total == 12000 for total, _ in found.values())
        assert found["email"][1] == "email"
    assert csv_scan.preview(scanned.rows, ["id"]).count() == 5


def test_admission(spark):
    files = spark.createDataFrame(
        [("in/Q2.csv", 12 << 20), ("in/BAD.pdf", 67 << 20), ("in/Big.CSV", 67 << 20), ("a\\b\\N.xlsx", 50 << 20)],
        "path string, length long",
    )
    found = {r.file_name: r.verdict for r in csv_scan.admission(files).collect()}
    assert found == {"Q2.csv": "accept", "BAD.pdf": "error-type", "Big.CSV": "error-size", "N.xlsx": "accept"}


def test_parse_errors(spark):
    df = spark.createDataFrame(
        [
            (47, "1234567890", "5551234567", '1234567890,"a@x.org,5551234567'),
            (48, "1234567890", "", '1234567890,"5"" pipe",'),
            (49, "1234567890", "", '1234567890,5" pipe,'),
            (50, "1234567890", "", '"1234567890,a'),
            (112, "12345x7890", "", "12345x7890,a,"),
            (203, "1", "+1-555-123-4567", "1,a,+1-555-123-4567"),
        ],
        "row int, npi string, phone string, line string",
    )
    errors = csv_scan.parse_errors(df, "row", "npi", "phone", "line", ["npi", "email", "phone"])
    found = {(r.row, r.col): r.detail for r in errors.collect()}
    assert set(found) == {(47, "email"), (50, "npi"), (112, "npi"), (203, "phone")}
    assert found[203, "phone"] == "Field contains 15 characters — exceeds 14-char phone max"


def test_csv_sink_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None, True)], "p string, q string, r string, has_opted_in boolean")
    exports.write_csv(exports.for_crm(df).coalesce(1), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == ["p,q,r,has_opted_in", '"a,b","say ""x""",,True']


def test_empty_export_keeps_its_header(spark, tmp_path):
    df = spark.createDataFrame([("a", False)], "p string, has_opted_in boolean")
    exports.write_csv(exports.for_crm(df), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["p,has_opted_in"]


def test_tenant_scan_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "records")
    tenants.write_records(spark.createDataFrame([("a", 1), ("b", 2)], "company_id string, n int"), path)
    one = tenants.tenant(tenants.read_table(spark, path), "a")
    assert [r.n for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(company_id" in one._jdf.queryExecution().toString()
    assert len(one.inputFiles()) >= 1


@pytest.mark.parametrize("company, reason", [("a", None), ("b", "must match"), (None, "is required"), ("", "is required")])
def test_guard(spark, company, reason):
    accepted, rejected = tenants.guard(spark.createDataFrame([(company,)], "company_id string"), F.lit("a"))
    assert accepted.count() == (reason is None)
    assert [reason in r.reason for r in rejected.collect()] == ([] if reason is None else [True])


def test_upsert_last_write_wins(spark):
    a = spark.createDataFrame([("1", 1, "x"), ("2", 1, "y")], "id string, v int, name string")
    b = spark.createDataFrame([("1", 3, "z"), ("1", 2, "w"), ("3", 1, "n")], "id string, v int, name string")
    found = {r.id: r.name for r in tenants.upsert(a, b, ["id"], ["v"]).collect()}
    assert found == {"1": "z", "2": "y", "3": "n"}
