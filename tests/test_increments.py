"""State that grows by batches, neighbours within blocks, spread as a bitmap and the release path."""

import random
from pathlib import Path

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rosterline.operators import flags, inference, linkage, outliers, score, search, summary
from rosterline.sources import exports, tenants


def files(spark, path):
    """Files of each tenant's newest batch."""
    rows = spark.read.parquet(f"{path}/manifest").orderBy("seq").collect()
    newest = {r.company_id: r.batch for r in rows}
    return {str(f) for c, b in newest.items() for f in Path(f"{path}/data/batch={b}/company_id={c}").glob("part-*")}


def test_merge_rewrites_touched_tenants_only(spark, tmp_path):
    path = str(tmp_path / "table")
    shape = "company_id string, id int, v int, x string"
    tenants.create(spark.createDataFrame([("007", 1, 1, "a"), ("007", 2, 1, "b"), ("12", 1, 1, "c"), ("n", 1, 1, "d")], shape), path)
    before = files(spark, path)
    changes = spark.createDataFrame([("007", 1, 2, "A"), ("007", 2, 0, "old"), ("new", 5, 1, "e")], shape)
    assert tenants.merge(changes, path, ["id"], ["v"], "b1")
    after = files(spark, path)
    expected = {("007", 1, 2, "A"), ("007", 2, 1, "b"), ("12", 1, 1, "c"), ("n", 1, 1, "d"), ("new", 5, 1, "e")}
    assert {tuple(r) for r in tenants.stored(spark, path).select("company_id", "id", "v", "x").collect()} == expected
    assert {f for f in before if "company_id=007" not in f} == before & after  # files of the others keep their names
    assert not list(Path(path).glob("data/batch=b1/company_id=12")) and len(after) == 4
    assert not any("batch=start/company_id=007" in f for f in after)
    later = changes.withColumn("x", F.lit("other"))
    assert not tenants.merge(later, path, ["id"], ["v"], "b1") and files(spark, path) == after
    assert tenants.merge(changes.limit(0), path, ["id"], ["v"], "b2") and files(spark, path) == after


def test_a_merge_that_died_has_no_effect_and_may_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1, 1)], "company_id string, id int, v int")
    tenants.create(rows, path)
    tenants.write_records(rows.withColumn("v", F.lit(9)), f"{path}/data/batch=b1", "overwrite")  # data, but no manifest
    assert [r.v for r in tenants.stored(spark, path).collect()] == [1]
    assert tenants.merge(rows.withColumn("v", F.lit(2)), path, ["id"], ["v"], "b1")
    assert [r.v for r in tenants.stored(spark, path).collect()] == [2]


def test_merge_refuses_rows_without_tenant_and_odd_names(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1, 1)], "company_id string, id int, v int")
    tenants.create(rows, path)
    with pytest.raises(SparkRuntimeException):
        tenants.merge(rows.withColumn("company_id", F.lit(None).cast("string")), path, ["id"], ["v"], "b1")
    with pytest.raises(ValueError):
        tenants.merge(rows, path, ["id"], ["v"], "../b")
    with pytest.raises(ValueError):
        tenants.create(rows.limit(0), str(tmp_path / "none"))


def test_outdated_folders_are_pruned(spark, tmp_path):
    path = str(tmp_path / "table")
    tenants.create(spark.range(100).selectExpr("id % 5 AS company_id", "id", "0 AS v"), path)
    plan = tenants.stored(spark, path)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan


def test_summaries_are_combined_without_records(spark, tmp_path):
    path = str(tmp_path / "sums")
    rng = random.Random(5)
    records = spark.createDataFrame([(rng.choice("abc"), i % 3) for i in range(200)], "company_id string, up int")
    kinds = [*score.WEIGHTS, "billing"]
    listed = [(rng.choice("abc"), i % 3, rng.choice(kinds), rng.choice(["High", "Medium", "Low"]), rng.random() < 0.5) for i in range(90)]
    found = spark.createDataFrame(listed, "company_id string, up int, category string, severity string, resolved boolean")
    sizes = records.groupBy("company_id").agg(F.count(F.lit(1)).alias("total_rows"))
    for n in (1, 2, 3):
        summary.store(summary.partials(records.where(F.col("up") == n - 1), found.where(F.col("up") == n - 1)), path, str(n))
        whole = score.health_score(found.where(F.col("up") < n), records.where(F.col("up") < n).groupBy("company_id").agg(F.count(F.lit(1)).alias("total_rows")), ["company_id"])
        kept = score.from_sums(summary.combined(spark, path), ["company_id"])
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, whole.collect()))
    summary.store(summary.partials(records.where("up = 1"), found.where("up = 1")), path, "2")  # again
    assert sorted(map(tuple, score.from_sums(summary.combined(spark, path), ["company_id"]).collect())) == sorted(
        map(tuple, score.health_score(found, sizes, ["company_id"]).collect())
    )
    assert len(summary.combined(spark, path).inputFiles()) < 20


def test_counts_of_files_are_those_of_the_whole(spark):
    rows = spark.createDataFrame([(f"{1000000000 + i}", f"a{i}@b.org" if i % 4 else "", i) for i in range(40)], "x string, y string, i int")
    parts = [inference.value_counts(rows.where(F.col("i") % 3 == k), ["x", "y"] if k else ["y", "x"]) for k in range(3)]
    merged = inference.decide(inference.merge_counts(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    columns = ["column", "records", "non_empty", "best_share", "inferred_type"]
    whole = inference.infer_types(rows, ["x", "y"])
    assert sorted(map(tuple, merged.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))


def brute_neighbours(rows, reach):
    blocks = {}
    for block, name, rec in rows:
        if block and block.strip():
            blocks.setdefault(block, []).append((name or "", rec))
    return sorted((b, x[i][1], x[j][1]) for b, x in ((b, sorted(x)) for b, x in blocks.items()) for i in range(len(x)) for j in range(i + 1, min(len(x), i + reach + 1)))


@pytest.mark.parametrize(("reach", "stretch"), [(1, 1), (2, 7), (3, 3), (2, 65_536)])
def test_neighbours_equal_brute_force(spark, reach, stretch):
    """Half of the rows are one block, names repeat, some blocks are blank and ranges have few rows."""
    rng = random.Random(reach)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c", " ", None]), rng.choice(["x", "y", "z", None]), i) for i in range(150)]
    records = spark.createDataFrame(rows, "npi string, last_name string, record_id int")
    found = linkage.neighbour_pairs(records, order=("last_name",), fields=("last_name",), reach=reach, stretch=stretch)
    assert sorted(map(tuple, found.select("block", "rec1", "rec2").collect())) == brute_neighbours(rows, reach)


def test_neighbours_find_a_pair_unlike_the_first(spark):
    records = spark.createDataFrame(
        [("1", "Adams", 1), ("1", "Morrison", 2), ("1", "Zhang", 3), ("1", "Morison", 4)], "npi string, last_name string, record_id int"
    )
    first = {(r.rec1, r.rec2) for r in linkage.duplicate_pairs(records, fields=("last_name",)).collect()}
    near = {(r.rec1, r.rec2) for r in linkage.neighbour_pairs(records, order=("last_name",), fields=("last_name",), reach=1).collect()}
    assert (4, 2) in near and (4, 2) not in first and (2, 4) not in first
    assert linkage.neighbour_pairs(records.limit(0), order=("last_name",), fields=("last_name",)).count() == 0
    with pytest.raises(ValueError):
        linkage.neighbour_pairs(records, reach=0)


def test_spread_counts_codes_once(spark):
    codes = [chr(65 + i) + chr(65 + j) for i in range(26) for j in range(26)]
    rows = [(1, c) for c in codes] + [(1, c.lower()) for c in codes] + [(2, c) for c in codes[:11]] * 3 + [(3, c) for c in codes[:10]]
    rows += [(3, "Ohio"), (3, ""), (3, None), (3, "1A"), (4, None)]
    found = outliers.spread(spark.createDataFrame(rows, "k int, state string"), ["k"], "state")
    assert sorted(map(tuple, found.collect())) == [(1, 676), (2, 11)]


def test_spread_flags_name_the_number(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2)], "company_id string, record_id int")
    activity = spark.createDataFrame([(1, chr(65 + i) + "A") for i in range(14)] + [(2, "TX")], "record_id int, state string")
    (flag,) = flags.of_spread(records, activity).collect()
    assert (flag.flag_id, flag.issue_type, flag.reason) == (
        "outliers:state:1", "Geographic", "Prescribing pattern spans 14 states — geographically implausible"
    )


def listed(spark):
    columns = list(exports.CLEAN_COLUMNS)[1:]
    rows = [(c, i, *[f"{n}{i}" if n != "specialty" else 'a, "b"' for n in columns]) for i, c in enumerate("aabc")]
    return spark.createDataFrame(rows, ["company_id", "record_id", *columns])


def test_closed_gates_release_nothing(spark):
    decided = spark.createDataFrame(
        [("a", "npi_validation", "High", True), ("b", "NPI_validation", "High", False), ("a", "PII", "High", False)],
        "company_id string, category string, severity string, resolved boolean",
    )
    assert {r.company_id for r in flags.cleared(listed(spark), decided).collect()} == {"a", "c"}


def test_lists_have_header_rows_and_trailer_in_order(spark, tmp_path):
    tagged = listed(spark).withColumn("dq_flag", F.when(F.col("record_id") == 1, "[DATA QUALITY WARNING]").otherwise(""))
    path = str(tmp_path / "lists")
    exports.write_clean_lists(tagged, path, "Admin")
    lines = [line for f in sorted((tmp_path / "lists" / "company_id=a").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "DQ_FLAG,NPI,First Name,Last Name,Specialty,State,Email,Phone,ZIP,DEA Number"
    assert lines[-1] == "# 2 total records · 1 DQ warnings · Role: Admin" and len(lines) == 4
    assert ',npi0,first_name0,last_name0,"a, ""b""",state0,email0,phone0,zip0,dea0' in lines


def test_a_batch_is_logged_once(spark, tmp_path):
    events = spark.createDataFrame([("csv", 3)], "format string, records int")
    for batch in ("x", "y", "y"):
        exports.log(events, str(tmp_path / "log"), batch)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_text_keys_sort_as_a_reader_sorts(spark):
    rows = spark.createDataFrame([("b", 1), ("A", 2), ("a", 3), ("é", 4), ("f", 5)], "field string, id int")
    assert [r.field for r in search.ordered(rows, "field", "id", descending=False).collect()] == ["a", "A", "b", "é", "f"]
