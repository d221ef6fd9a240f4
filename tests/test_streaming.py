from pyspark.sql import functions as F

from rosterline.streaming import ingest


def totals(spark, path):
    return {r.upload_id: r.total_rows for r in ingest.running_totals(spark, path).collect()}


def test_restarts_neither_lose_nor_double_rows(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(name, n):
        (landing / name).write_text("id,name\n" + "".join(f'{i},"n, {i}"\n' for i in range(n)))

    def run():
        stream = ingest.csv_stream(spark, str(landing), files_per_batch=1)
        query = ingest.start(stream, ["id", "name"], out, state)
        query.awaitTermination()
        assert query.exception() is None

    arrive("a.csv", 10)
    arrive("b.csv", 5)
    run()
    assert totals(spark, out) == {"a.csv": 10, "b.csv": 5}
    run()
    arrive("c.csv", 7)
    run()
    assert totals(spark, out) == {"a.csv": 10, "b.csv": 5, "c.csv": 7}
    assert spark.read.parquet(f"{out}/records").count() == 22


def test_long_rows_are_set_aside(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    (landing / "a.csv").write_text('id,name\n1,a\n2\n3,"c, d",extra\n')
    query = ingest.start(ingest.csv_stream(spark, str(landing)), ["id", "name"], out, str(tmp_path / "s"))
    query.awaitTermination()
    assert totals(spark, out) == {"a.csv": 2}
    rows = {r.id: (r.name, r._short) for r in spark.read.parquet(f"{out}/records").select("id", F.col("name"), "_short").collect()}
    assert rows == {"1": ("a", False), "2": (None, True)}
    assert [(r.raw, r.upload_id) for r in spark.read.parquet(f"{out}/quarantine").collect()] == [('3,"c, d",extra', "a.csv")]


def test_equal_names_multi_line_fields_and_other_header_orders(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    for tenant, text in {
        "c1": 'id,name\n1,"line one\nline two"\n2,b\n', "c2": "name,id\nx,7\n", "c 3+": 'id,name\n1,"open\n', "c4": "id,extra\n5,y\n"
    }.items():
        (landing / tenant).mkdir(parents=True)
        (landing / tenant / "list.csv").write_text(text)
    query = ingest.start(ingest.csv_stream(spark, str(landing)), ["id", "name"], out, str(tmp_path / "s"))
    query.awaitTermination()
    assert query.exception() is None
    assert totals(spark, out) == {"c1/list.csv": 2, "c2/list.csv": 1, "c4/list.csv": 1}
    rows = spark.read.option("mergeSchema", "true").parquet(f"{out}/records").collect()
    assert {(r.upload_id, r.id, r.name, r.extra) for r in rows} == {
        ("c1/list.csv", "1", "line one\nline two", None), ("c1/list.csv", "2", "b", None),
        ("c2/list.csv", "7", "x", None), ("c4/list.csv", "5", None, "y"),
    }
    rejected = spark.read.parquet(f"{out}/rejected").collect()
    assert [(r.upload_id, r.status) for r in rejected] == [("c 3+/list.csv", "unclosed_quote")]
