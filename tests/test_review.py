import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterline.functions import bands
from rosterline.operators import compliance, mapping, quality, review, score, search, summary
from rosterline.sources import exports

PII = ["High", "Medium", "Low", "High", "High", "High"]
OUTLIERS = ["High", "Medium", "Low", "Medium"]
NPI = ["High", "Medium", "Medium", "High"]


def flags(spark, resolved):
    rows = [("PII", i, x) for i, x in enumerate(PII)] + [("outliers", i, x) for i, x in enumerate(OUTLIERS)]
    rows += [("npi_validation", i, x) for i, x in enumerate(NPI)] + [("duplicates", i, None) for i in range(4 - 1)]
    data = [(c, i, s, resolved(c, i)) for c, i, s in rows]
    return spark.createDataFrame(data, "category string, flag_id int, severity string, resolved boolean")


@pytest.mark.parametrize(
    "resolved, expected",
    [
        (lambda c, i: False, 0),
        (lambda c, i: True, 99),
        (lambda c, i: (c, i) == ("npi_validation", 0), 8),
        (lambda c, i: c == "npi_validation", 29),
    ],
)
def test_score_goldens(spark, resolved, expected):
    size = spark.createDataFrame([(10412,)], "total_rows long")
    found = score.health_score(flags(spark, resolved), size).first()
    assert (found.score, found.flags) == (expected, 17)


def test_score_without_flags_is_full(spark):
    none = flags(spark, lambda c, i: True).limit(0)
    size = spark.createDataFrame([(100,)], "total_rows long")
    assert score.health_score(none, size).first().score == 100
    grouped = score.health_score(none.withColumn("g", F.lit("a")), size.withColumn("g", F.lit("a")), ["g"]).first()
    assert (grouped.score, grouped.label) == (100, "Excellent")
    assert {r.points for r in score.category_points(none).collect()} == {30.0, 25.0, 20.0}


def resolutions(spark, *rows):
    data = [(i, a, dt.datetime(2026, 1, d), s, m, n, j) for i, a, d, s, m, n, j in rows]
    return spark.createDataFrame(
        data, "flag_id int, action string, ts timestamp, seq int, master int, note string, justification string"
    )


def test_latest_decision_and_undo(spark):
    log = resolutions(
        spark,
        (1, "removed", 1, 1, None, None, None),
        (1, "kept", 2, 1, None, None, None),
        (2, "warned", 1, 1, None, "n", None),
        (2, "undo", 1, 2, None, None, None),
        (3, "undo", 1, 1, None, None, None),
        (3, "warned", 3, 0, None, "  ", None),
        (4, "override", 1, 1, None, None, "too short"),
        (5, "override", 1, 1, None, None, "exactly 15 char"),
    )
    of = spark.createDataFrame([(i, "NPI_validation" if i > 3 else "PII") for i in range(1, 8)], "flag_id int, category string")
    current = review.latest(review.accepted_overrides(log, of))
    assert {r.flag_id: r.action for r in current.collect()} == {1: "kept", 3: "warned", 5: "override"}
    warned = review.quality_warnings(current).collect()
    assert [(r.flag_id, r.note) for r in warned] == [(3, "No note provided")]
    all_flags = spark.range(1, 6).select(F.col("id").cast("int").alias("flag_id"), F.lit("pii").alias("category"))
    counted = review.open_counts(review.with_decision(all_flags, current), ["category"]).first()
    assert (counted.total, counted.resolved, counted.open) == (5, 3, 2)


def test_only_overrides_of_provider_numbers_need_a_justification(spark):
    log = resolutions(
        spark,
        (1, "override", 1, 1, None, None, "ok"),
        (2, "override", 1, 1, None, None, None),
        (3, "warned", 1, 1, None, None, None),
        (3, "override", 2, 1, None, None, "ok"),
    )
    of = spark.createDataFrame([(1, "PII"), (2, None), (3, "npi_validation")], "flag_id int, category string")
    current = review.latest(review.accepted_overrides(log, of))
    assert {r.flag_id: r.action for r in current.collect()} == {1: "override", 2: "override", 3: "warned"}


def test_effects_on_records(spark):
    records = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, None)], "record_id int, email string")
    decided = spark.createDataFrame(
        [(1, "anonymized", "email"), (2, "removed", "email"), (3, "anonymized", "email")],
        "record_id int, action string, field string",
    )
    masked = {r.record_id: r.email for r in review.anonymize(records, decided, ["email"]).collect()}
    assert len(masked[1]) == 64 and masked[2] == "b@x" and masked[3] is None
    assert {r.record_id for r in review.drop_removed(records, decided).collect()} == {1, 3}


def test_survivors_and_losers_make_up_the_input(spark):
    records = spark.range(1, 9).withColumnRenamed("id", "record_id")
    pairs = spark.createDataFrame(
        [(1, 2, "merged", 2), (3, 4, "merged", 1), (5, 6, "distinct", None), (7, 8, "removed", None)],
        "rec1 long, rec2 long, action string, master int",
    )
    kept = {r.record_id for r in review.surviving_records(records, pairs).collect()}
    assert kept == {2, 3, 5, 6, 7}


def test_every_warning_tags_its_record(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b")], "record_id int, npi string")
    warned = spark.createDataFrame([(10, 1, "x"), (11, 1, "y")], "flag_id int, record_id int, note string")
    tagged = review.tag_warnings(records, warned)
    found = sorted((r.record_id, r.npi, r.dq_flag, r.dq_note or "") for r in tagged.collect())
    mark = "[DATA QUALITY WARNING]"
    assert found == [(1, "a", mark, "x"), (1, "a", mark, "y"), (2, "b", "", "")]


def test_recency_filter_reaches_the_scan(spark):
    recent = search.since(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts", "2024-01-20 00:00:00", 7)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-13" in plan


def test_export_gate(spark):
    blocked = exports.gate(flags(spark, lambda c, i: False)).first()
    assert (blocked.available, blocked.open_high) == (False, 2)
    assert blocked.block_reason == "2 High-severity NPI errors must be resolved in Data Review before export."
    assert exports.gate(flags(spark, lambda c, i: c == "npi_validation")).first().available


def test_compliance(spark):
    text = " ".join(p.phrase.upper() for p in compliance.LEXICON)
    df = spark.createDataFrame([(1, text), (2, "nothing here")], "id int, body string")
    hits = compliance.scan(df, "body", ["id"]).withColumn("status", F.lit("open"))
    assert hits.count() == 4 and {r.id for r in hits.collect()} == {1}
    counted = compliance.counts(hits).first()
    assert (counted.high_open, counted.all_high_resolved) == (2, False)
    assert not compliance.campaign_gate(hits).first().available


MAPPING = [
    ("provider_id", "NPI", 0.97), ("first_nm", "First Name", 0.95), ("last_nm", "Last Name", 0.95),
    ("specialty_cd", "Specialty", 0.88), ("state_abbr", "State", 0.91), ("email_addr", "Email", 0.93),
    ("phone_num", "Phone", 0.89), ("zip", "ZIP Code", 0.85), ("dea_no", "DEA Number", 0.72), ("misc_notes", "Ignore", 0.61),
]


def test_mapping(spark):
    suggested = spark.createDataFrame([("u", *m) for m in MAPPING], "upload_id string, raw string, suggested string, confidence double")
    none = spark.createDataFrame([], "upload_id string, raw string, target string")
    resolved = mapping.resolve(suggested, none, ["upload_id"])
    found = mapping.report(resolved, ["upload_id"]).first()
    assert (found.pre_mapped, found.overridden, found.can_proceed) == (8, 0, True)
    tiers = {r.tier: r["count"] for r in resolved.groupBy("tier").count().collect()}
    assert tiers == {"High": 5, "Medium": 3, "Low": 2}
    changed = spark.createDataFrame([("u", "provider_id", "Email")], "upload_id string, raw string, target string")
    resolved = mapping.resolve(suggested, changed, ["upload_id"])
    found = mapping.report(resolved, ["upload_id"]).first()
    assert (found.missing_required, found.duplicated, found.can_proceed, found.overridden) == (["NPI"], ["Email"], False, 1)
    assert [r.target for r in mapping.missing_required(resolved, ["upload_id"]).collect()] == ["NPI"]
    applied = mapping.apply(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "NPI", "b": "Ignore"})
    assert applied.columns == ["NPI"]


def test_platform_rollup(spark):
    orgs = [("active", 14, 42800), ("active", 5, 11200), ("active", 8, 9400), ("trial", 2, 2100), ("active", 21, 88000), ("suspended", 1, 0)]
    found = summary.platform_rollup(spark.createDataFrame(orgs, "status string, users int, records int")).first()
    assert tuple(found) == (6, 4, 51, 153500)


def test_dashboard(spark):
    companies = spark.createDataFrame([("a",), ("empty",)], "company_id string")
    uploads = spark.createDataFrame(
        [("a", 10, 80.0, "2026-07-18T10:00:00Z"), ("a", 5, None, "2026-01-01T00:00:00"), ("a", None, 81.5, "bad"),
         ("gone", 99, 1.0, "2026-07-18T10:00:00Z"), ("a", 1, None, "")],
        "company_id string, total_rows int, health_score double, created_at string",
    ).withColumn("uploaded_at", F.lit("2026-07-17T00:00:00Z"))
    found = flags(spark, lambda c, i: c == "PII").withColumn("company_id", F.lit("a"))
    board = summary.dashboard(uploads, found, companies, "2026-07-20 00:00:00").first()
    assert (board.total_hcps, board.records_this_week, board.health_score) == (16, 11, 80.8)
    assert board.last_upload == dt.datetime(2026, 7, 18, 10)
    assert (board.pii, board.duplicates, board.outliers, board.npi_validation, board.total_flags) == (0, 3, 4, 4, 11)
    nothing = summary.dashboard(uploads.limit(0), found.limit(0), companies, "2026-07-20 00:00:00").first()
    assert (nothing.total_hcps, nothing.health_score, nothing.last_upload, nothing.total_flags) == (0, 0.0, None, 0)


def test_cell_states_add_up(spark):
    df = spark.createDataFrame(
        [("1234567890", "Jo"), ("12", None), (None, "John"), ("1", "x9")], "npi string, first_name string"
    )
    rules = tuple(r for r in quality.FIELD_RULES if r.column in df.columns)
    states = [[c.status for c in r.cells] for r in quality.cells(df, rules).collect()]
    assert states == [["complete", "partial"], ["invalid", "missing"], ["missing", "complete"], ["invalid", "invalid"]]
    health = quality.field_health(df, rules).collect()
    assert all(r.complete + r.partial + r.invalid + r.missing == 4 for r in health)
    assert [r.health for r in quality.record_health(df, rules).collect()] == [50, 0, 50, 0]
    assert quality.cells(df, rules, ["First Name"], "missing").count() == 1


def test_sorting_and_bands(spark):
    df = spark.createDataFrame([(1, "Low"), (2, "High"), (3, "Medium"), (4, "High")], "id int, severity string")
    assert [r.id for r in search.ordered(df, "severity", "id").collect()] == [2, 4, 3, 1]
    got = spark.createDataFrame([(x,) for x in (44.9, 45.0, 65.0, 85.0)], "x double")
    assert [r[0] for r in got.select(bands.score_label(F.col("x"))).collect()] == ["Poor", "Fair", "Good", "Excellent"]
    half = spark.createDataFrame([(2.5,), (-2.5,), (2.4999,)], "x double").select(bands.half_up(F.col("x")))
    assert [r[0] for r in half.collect()] == [3, -2, 2]


def test_open_counts_of_groups_without_flags_and_without_name(spark):
    flags = spark.createDataFrame([("a", True), ("a", False), (None, False), (None, None)], "company string, resolved boolean")
    groups = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "company string")
    found = {r.company: (r.total, r.resolved, r.open) for r in review.open_counts(flags, ["company"], groups).collect()}
    assert found == {"a": (2, 1, 1), "b": (0, 0, 0), None: (2, 0, 2)}
    assert review.open_counts(flags, ["company"], groups).count() == 3


def test_gates_stay_closed_for_a_group_without_name(spark):
    flags = spark.createDataFrame([("a", True), (None, False)], "company string, resolved boolean").selectExpr(
        "*", "'NPI_Validation' AS category", "'High' AS severity", "if(resolved, 'accepted', 'open') AS status")
    groups = spark.createDataFrame([("a",), ("b",), (None,)], "company string")
    for gate in (exports.gate, compliance.campaign_gate):
        assert {r.company: r.available for r in gate(flags, ["company"], groups).collect()} == {"a": True, "b": True, None: False}
