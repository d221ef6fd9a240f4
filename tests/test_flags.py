import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterline.operators import flags, linkage, outliers
from rosterline.plans import detection

RECORDS = "company_id string, record_id long, npi string, specialty string, volume double, email string, home string, note string, expires date"


@pytest.fixture
def records(spark):
    late, soon = dt.date(2048, 1, 1), dt.date(2030, 1, 1)
    return spark.createDataFrame(
        [
            ("c", 1, "1234567893", "Oncology", 1.0, "a@c.org", "1 Road", "call 123-45-6789 or 987-65-4321", soon),
            ("c", 2, "1234567893", "Oncology", 1.0, "b@other.org", None, None, late),
            ("d", 3, "1234567893", None, None, None, " ", "", None),
            ("d", 4, "5", "Urology", 2.0, "x", "", "4111 1111 1111 1111", None),
            ("d", 5, "9988776655", "Cardiology", 2.0, "x@any.org", "", "y@z.org", soon),
        ],
        RECORDS,
    )


def found(spark, records):
    known = spark.createDataFrame(
        [("1234567893", "Active", "Oncology", None), ("9988776655", "Inactive", "Cardiology", 2019)],
        "npi string, status string, specialty string, deactivated_year int",
    )
    companies = spark.createDataFrame([("c", "C.org"), ("d", None)], "company_id string, email_domain string")
    one = flags.of_records(records, known, companies, {"home": "home_address"}, ("note",), expiry="expires", as_of="2026-01-01")
    return one.unionByName(flags.of_pairs(linkage.duplicate_pairs(records, fields=("company_id",))))


def test_all_detectors_in_one_list(spark, records):
    listed = found(spark, records)
    assert listed.columns == list(flags.COLUMNS)
    rows = listed.collect()
    assert {(r.record_id, r.field, r.issue_type) for r in rows} == {
        (1, "home", "Physical Address"), (1, "note", "Social Security Number"),
        (2, "email", "Domain"), (2, "expires", "Expiry"), (2, "npi", "Same npi"), (3, "npi", "Same npi"),
        (4, "npi", "Invalid"), (4, "note", "Financial Identifier"),
        (5, "npi", "Inactive"), (5, "note", "Personal Identifier"),
    }
    assert len(rows) == len({r.flag_id for r in rows})
    reasons = {(r.record_id, r.issue_type): r.reason for r in rows}
    assert reasons[5, "Inactive"] == "NPI is inactive since 2019"
    assert reasons[2, "Expiry"] == "License expiry date 22 years in the future"
    assert found(spark, records.limit(0)).count() == 0


def test_release_holds_nothing_removed_and_nothing_to_be_hidden(spark, records):
    acts = {"PII:note/SSN:1": "anonymized", "duplicates:npi:2": "merged", "outliers:email:2": "warned", "npi_validation:npi:4": "removed", "npi_validation:npi:5": "warned"}
    decided = found(spark, records).drop("resolved")
    log = spark.createDataFrame([(k, v, 2 if "dup" in k else None, " ") for k, v in acts.items()], "flag_id string, action string, master int, note string")
    decided = decided.join(log, "flag_id", "left").withColumn("resolved", F.col("action").isNotNull())
    pairs = linkage.duplicate_pairs(records, fields=("company_id",))
    out = {r.record_id: r for r in flags.release(records, decided, pairs, ["note"]).collect()}
    assert set(out) == {2, 3, 5}  # 1 lost to 2, 4 was removed
    assert (out[2].dq_flag, out[2].dq_note, out[3].dq_flag) == ("[DATA QUALITY WARNING]", "No note provided", "")
    alone = flags.release(records.where("record_id = 1"), decided, pairs.limit(0), ["note"]).first()
    assert alone.note == records.where("record_id = 1").select(F.sha2("note", 256)).first()[0]


def test_flags_are_detected_once_and_decided_by_the_latest_accepted_decision(spark, tmp_path, monkeypatch):
    names = ["npi_validation:npi", "PII:address/Home Address", "outliers:email", "duplicates:npi"]
    data = [("C", f"{n}:{r}", n.split(":")[0], r, "f", "t", "High", None, "why", False) for n in names for r in (7, 8)]
    runs = spark.sparkContext.accumulator(0)

    def seen(row):
        runs.add(1)
        return row

    schema = """company_id string, flag_id string, category string, record_id long, field string, issue_type string,
        severity string, score double, reason string, resolved boolean"""
    found = spark.createDataFrame(spark.sparkContext.parallelize(data, 2).map(seen), schema)
    monkeypatch.setattr(detection, "_detected", lambda spark, d: found)
    lines = [  # the line number tells the flag, the quantity and the others the action
        (7, 4, 40.0, 0.0, 0.01, "A", 2),  # an override that lacks its justification
        (7, 8, 10.0, 0.0, 0.01, "A", 1),
        (7, 1, 10.0, 0.0, 0.01, "A", 1),
        (7, 1, 10.0, 0.08, 0.01, "A", 2),
        (7, 2, 50.0, 0.0, 0.01, "A", 1),
        (9, 1, 10.0, 0.0, 0.01, "A", 1),  # no such flag
    ]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, day int"
    log = spark.createDataFrame(lines, columns).selectExpr("*", "TIMESTAMP '2026-01-01' + make_dt_interval(day) AS l_shipdate")
    log.write.parquet(f"{tmp_path}/lineitem.parquet")
    decided = detection._reviewed(spark, str(tmp_path))
    assert runs.value == len(data)
    assert set(decided.columns) | {"resolved"} == {*found.columns, "ts", "seq", "action", "justification", "note", "master"}
    actions = {r.flag_id: (r.action, r.resolved) for r in decided.collect()}
    expected = {f"{n}:{r}": (None, False) for n in names for r in (7, 8)}
    expected |= {f"{names[0]}:7": ("removed", True), f"{names[1]}:7": ("anonymized", True)}
    assert actions == expected


def test_states_in_odd_spellings(spark):
    rows = [(1, s) for s in ("AB", " ab ", "ab", "ZZ", "zz", "A", "", "A1", "ABC", "1A", None)] + [(2, s) for s in ("AA", "ZZ", "CD")]
    found = outliers.spread(spark.createDataFrame(rows, "id int, state string"), ["id"], "state", 0)
    assert {r["id"]: r.states for r in found.collect()} == {1: 2, 2: 3}
