"""Uploads of any layout in one scan, line numbers over splits, and exact percentiles."""

import math

import pytest
from pyspark.sql import functions as F

from rosterline.operators import outliers
from rosterline.plans import intake
from rosterline.sources import csv_check, csv_rows, upload


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "64b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, name, text):
    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_fields_and_names(spark):
    table = [('a,"b, ""c""",,"",5" x', ["a", 'b, "c"', None, "", '5" x']), ("", [None]), (",", [None, None]), ('"l\nm",é', ["l\nm", "é"])]
    df = spark.createDataFrame([(t,) for t, _ in table], "t string")
    assert [r[0] for r in df.select(csv_rows.fields(F.col("t"))).collect()] == [x for _, x in table]
    assert spark.range(1).select(csv_rows.names(F.lit("id,,Name,name"))).first()[0] == ["id", "_c1", "Name2", "name3"]


def test_rows_of_files_in_many_splits(spark, tmp_path, small_splits):
    body = "".join(f'{i},"n{i}, x"\n' if i % 3 else f"{i},n,extra\n" for i in range(200))
    write(tmp_path, "a.csv", "id,name\n" + body)
    write(tmp_path, "b.csv", 'name,id\n"two\nlines",7\n\nz,8\n' + '"a\nb\nc",9\n' * 30 + 'q"r"s,10\n"",11\nid,name\n')
    write(tmp_path, "c.csv", "id,name\n" * 40)
    found = upload.scan(spark, str(tmp_path))
    assert found.lines.select("file", "block").distinct().count() > 20
    name = F.regexp_extract("file", "[^/]*$", 0).alias("f")
    rows = upload.by_name(found, ["ID", "name", "none"]).select(name, "ID", "name", "none", "_short").collect()
    assert sorted((r.ID, r["name"]) for r in rows if r.f == "a.csv") == sorted((str(i), f"n{i}, x") for i in range(200) if i % 3)
    b = sorted((r.ID, r["name"]) for r in rows if r.f == "b.csv")
    assert b == sorted([("7", "two\nlines"), ("8", "z"), *[("9", "a\nb\nc")] * 30, ("10", 'q"r"s'), ("11", ""), ("name", "id")])
    assert sum(r.f == "c.csv" for r in rows) == 39 and not any(r._short or r.none for r in rows)
    wide = csv_rows.located(found.quarantine, found.lines).select("raw", "row").collect()
    assert {r.raw: r["row"] for r in wide} == {f"{i},n,extra": i + 2 for i in range(0, 200, 3)}
    listed = {r.file_name: (r.upload_id, r.status, r.total_rows, r.quarantined, r.columns) for r in upload.uploads(found, F.lit("t"), name).collect()}
    assert listed["a.csv"] == ("a.csv", "ok", 133, 67, ["id", "name"]) and listed["b.csv"][2] == 35


def test_headers_over_two_lines_and_mapped_columns(spark, tmp_path):
    write(tmp_path, "h.csv", '"first\nname",npi,"a,b"\nAnn,1\nBob,2,"c\nd"\n')
    write(tmp_path, "y.csv", "npi,mail,npi\n3,m@x.org,4\n")
    write(tmp_path, "bad.csv", b"npi\n\xff\n")
    found = upload.scan(spark, str(tmp_path))
    assert sorted(upload.column_names(found)) == ["a,b", "first\nname", "mail", "npi", "npi0", "npi2"]
    every = found.files.select("file", F.explode("names").alias("raw"))
    target = F.when(F.col("raw").startswith("first"), "First Name").when(F.col("raw").startswith("npi"), "NPI").otherwise("Ignore")
    rows = upload.mapped(found, every.withColumn("target", target), ["NPI", "First Name", "Email"]).collect()
    assert sorted((r.NPI, r["First Name"], r.Email, r._short) for r in rows) == [("1", "Ann", None, True), ("2", "Bob", None, False), ("3", None, None, False)]
    verdict = found.files.where("file LIKE '%bad.csv'").first()
    assert (verdict.status, verdict.line_number, verdict.bad_line, verdict.names) == ("invalid_utf8", 1, 2, [])


def test_plan_is_the_same_for_any_number_of_layouts(spark, tmp_path):
    def size(layouts):
        folder = tmp_path / str(layouts)
        for i in range(layouts):
            write(folder, f"{i}.csv", ",".join(["a", "b", "c"][i % 3 :] + ["a", "b", "c"][: i % 3]) + "," * (i // 3) + "\n1,2,3\n")
        return len(upload.by_name(upload.scan(spark, str(folder)), ["a", "b"])._jdf.queryExecution().analyzed().toString().splitlines())

    assert size(2) == size(9)


@pytest.mark.parametrize("levels", [(), (64,), (64, 256)])
def test_levels_of_the_structure_tree_agree(spark, levels):
    lines = [("f", 10 * (i // 4), i, t) for i, t in enumerate(['a,"b', "c", 'd",e', "g"] * 30 + ["x", '"p"q', "r"])]
    df = spark.createDataFrame([*lines, ("g", 0, 0, '"o'), ("g", 640, 9, "p")], "file string, block long, pos long, line string").repartition(5)
    got = {r.file: (r.lines, r.status, r.line_number, r.multi_line, r.header) for r in csv_check.structure_faults(df, levels).collect()}
    assert got == {"f": (123, "stray_text", 122, True, 'a,"b'), "g": (2, "unclosed_quote", 2, True, '"o')}


@pytest.mark.parametrize("partitions, accuracy", [(1, 10_000), (64, 50)])
def test_percentiles_are_exact(spark, partitions, accuracy):
    values = [("hot", float(i * 7919 % 4001)) for i in range(4000)] + [("ties", float(i // 900)) for i in range(1000)]
    values += [("one", 5.0), (None, 3.0), ("none", None), ("hot", None)] + [(f"g{i % 30}", float(i)) for i in range(3000)]
    df = spark.createDataFrame(values, "g string, v double").repartition(partitions)
    for q in (0.99, 0.5, 0.0, 1.0):
        want = {}
        for g in {g for g, _ in values if g}:
            ordered = sorted(v for h, v in values if h == g and v is not None)
            if ordered:
                want[g] = ordered[max(1, math.ceil(round(q * len(ordered), 9))) - 1]
        assert {r.g: r.percentile for r in outliers.group_percentile(df, "g", "v", q, accuracy).collect()} == want
    stats = {r.g: (r.group_size, r.group_p99) for r in outliers.group_statistics(df, "g", "v", accuracy).collect()}
    assert stats["hot"][0] == 4000 and stats["one"] == (1, 5.0) and stats["none"] == (0, None) and stats[None] == (1, None)


def test_listed_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/listing"
    monkeypatch.setattr(intake, "scratch", lambda spark, label: path)
    spark.createDataFrame([(k, f"N{k}") for k in range(6)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    customers = spark.range(0, 60_000, 250).selectExpr("id AS c_custkey", "CAST(id DIV 250 % 6 AS INT) AS c_nationkey")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    listed = intake.file_listing(spark, str(tmp_path)).collect()
    assert len(listed) == customers.selectExpr("c_nationkey", "c_custkey DIV 1000").distinct().count() + len([r for r in listed if r.extension == "txt"])
    assert {r.folder for r in listed if r.extension == "txt"} == {r.folder for r in listed if r.folder.startswith(("N0-", "N5-"))}
    for kind in ("csv", "txt"):
        tasks = {f.name.split("-")[1] for f in (tmp_path / "listing").rglob(f"part-*.{kind}")}
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
