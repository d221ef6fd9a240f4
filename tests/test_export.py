from rosterline.sources import exports, tenants

COLUMNS = "id string, name string, email string, npi string, phone string, Has_Opted_In boolean"


def people(spark, *consents):
    rows = [(str(i), f"N{i}", None, "1", "2", c) for i, c in enumerate(consents)]
    return spark.createDataFrame(rows, COLUMNS)


def status(df):
    return exports.outcome(df, "Has_Opted_In").first().status


def test_only_explicit_consent_leaves(spark):
    without_key = spark.createDataFrame([("9", "No Key")], "id string, name string")
    df = tenants.stack(people(spark, True, False, None), without_key)
    assert [r.id for r in exports.for_crm(df, "Has_Opted_In").collect()] == ["0"]
    assert status(df) == "ok"


def test_cells_are_text(spark):
    df = spark.createDataFrame([("John Döe", None, True, 3), ("José María", "x", True, None)], "n string, p string, Has_Opted_In boolean, k int")
    rows = sorted(tuple(r) for r in exports.for_crm(df, "Has_Opted_In").collect())
    assert rows == [("John Döe", "", "True", "3"), ("José María", "x", "True", "")]


def test_binary_text_is_made_valid(spark):
    df = spark.createDataFrame([(bytearray(b"ok"), True)], "b binary, Has_Opted_In boolean")
    assert exports.for_crm(df, "Has_Opted_In").first().b == "ok"


def test_outcomes(spark):
    assert status(people(spark).limit(0)) == "not_found"
    assert status(people(spark, False, None)) == "empty"
    missing = spark.createDataFrame([("1", "a")], "id string, name string")
    assert status(missing) == "empty" and exports.for_crm(missing, "Has_Opted_In").count() == 0
    assert exports.for_crm(people(spark, True, False, True), "Has_Opted_In").count() == 2


def test_numbers_and_words_as_consent(spark):
    numbers = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 2)], "id int, Has_Opted_In int")
    assert [r.id for r in exports.for_crm(numbers, "Has_Opted_In").collect()] == ["1"]
    words = spark.createDataFrame([(1, "true")], "id int, Has_Opted_In string")
    assert exports.for_crm(words, "Has_Opted_In").count() == 0 and status(words) == "empty"


def test_consent_filter_reaches_the_scan(spark, tmp_path):
    people(spark, True, False).write.parquet(str(tmp_path / "p"))
    kept = exports.for_crm(spark.read.parquet(str(tmp_path / "p")).select("id", "Has_Opted_In"), "Has_Opted_In")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Has_Opted_In,true)" in plan and "ReadSchema: struct<id:string,Has_Opted_In:boolean>" in plan


def test_consent_column_in_any_case_and_invalid_bytes(spark):
    df = spark.createDataFrame([(1, True, bytearray(b"a\xffb")), (2, False, bytearray(b"c"))], "npi int, Has_Opted_In boolean, note binary")
    got = exports.for_crm(df).collect()
    assert [(r.npi, r.note) for r in got] == [("1", "a�b")]


def test_gate_of_a_company_without_flags(spark):
    flags = spark.createDataFrame([("a", "npi_validation", "High", False)], "company_id string, category string, severity string, resolved boolean")
    companies = spark.createDataFrame([("a",), ("b",)], "company_id string")
    got = {r.company_id: (r.open_high, r.available) for r in exports.gate(flags, ["company_id"], companies).collect()}
    assert got == {"a": (1, False), "b": (0, True)}
