import datetime as dt

from pyspark.sql import functions as F

from rosterline.functions import text as t
from rosterline.operators import pii


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


def test_words(spark):
    assert one(spark, "  two\nwords　and\u00a0more\ufeffé ", t.word_count) == 5
    assert one(spark, " \n", t.word_count) == 0


def test_small_helpers(spark):
    assert one(spark, "C:\\a/b\\c.csv", t.base_name) == "c.csv"
    assert one(spark, "a.b.CSV", t.extension) == "csv"
    assert one(spark, "x" * 41, lambda c: t.truncated(c, 40)) == "x" * 40 + "…"
    assert one(spark, "x" * 40, lambda c: t.truncated(c, 40)) == "x" * 40
    assert one(spark, "Jane Doe", t.initials) == "JD"
    assert one(spark, "", lambda c: t.first_filled(c, F.lit("b"))) == "b"
    day = F.lit("2026-07-18").cast("date")
    assert one(spark, "Q2.HCP.csv", lambda c: t.clean_list_file_name(c, day)) == "HCP_Clean_Q2_2026-07-18.csv"
    assert one(spark, None, lambda c: t.clean_list_file_name(c, day)) == "HCP_Clean_Export_2026-07-18.csv"
    assert one(spark, "a b a", lambda c: t.replace_phrases(c, {"a": "x", "b": "y"})) == "x y x"


def test_instants(spark):
    expected = dt.datetime(2026, 7, 18, 10)
    assert one(spark, "2026-07-18T10:00:00Z", t.instant) == expected
    assert one(spark, "2026-07-18T10:00:00", t.instant) == expected
    assert one(spark, "2026-07-18T12:00:00+02:00", t.instant) == expected
    assert one(spark, "yesterday", t.instant) is None and one(spark, "", t.instant) is None


def test_personal_data_at_the_end_of_a_long_text(spark):
    long_text = "x" * 300_000 + " 123-45-6789 4111 1111 1111 1111, 4111111111111112 mail jane.doe+1@home.example.org"
    df = spark.createDataFrame([(1, long_text), (2, "nothing"), (3, None)], "id int, body string")
    found = sorted((r.id, r.field, r.severity, r.value) for r in pii.in_text(df, "body", ["id"]).collect())
    assert found == [
        (1, "Credit Card", "High", "4111 1111 1111 1111"),
        (1, "Personal Email", "Low", "jane.doe+1@home.example.org"),
        (1, "SSN", "High", "123-45-6789"),
    ]


def test_columns_named_after_personal_data(spark):
    df = spark.createDataFrame([(1, "1970-01-01", " ", "x")], "id int, DOB string, home_address string, other string")
    assert [(r.field, r.severity, r.value) for r in pii.in_columns(df, ["id"]).collect()] == [("DOB", "Medium", "1970-01-01")]
    assert pii.in_columns(df.select("id", "other"), ["id"]).count() == 0


def test_only_accepted_hits_are_replaced_by_position(spark):
    phrases = {"new data": "published data", "data set": "table", "Cure": "$1 help"}
    table = [("A New Data set, a CURE, new data", ["new data"]), ("cure cure", ["Cure"]), ("new data", []), ("new data set", None), ("", ["Cure"]), (None, ["Cure"])]
    df = spark.createDataFrame(table, "text string, ok array<string>")
    got = [r[0] for r in df.select(t.replace_accepted(F.col("text"), phrases, F.col("ok"))).collect()]
    assert got == ["A published data set, a CURE, published data", "$1 help $1 help", "new data", "new data set", "", None]
    hits = df.select(t.phrase_hits(F.col("text"), list(phrases))).first()[0]
    assert [(h.phrase, h.start, h.stop) for h in hits] == [("new data", 2, 10), ("Cure", 18, 22), ("new data", 24, 32)]


def test_totals_of_uploads_with_one_time_column(spark):
    from rosterline.operators import summary

    companies = spark.createDataFrame([("c",)], "company_id string")
    uploads = spark.createDataFrame([("c", 5, 80.0, "2026-01-02T03:04:05Z")], "company_id string, total_rows int, health_score double, uploaded_at string")
    assert summary.upload_totals(uploads, companies, "2026-01-03").first().records_this_week == 5
