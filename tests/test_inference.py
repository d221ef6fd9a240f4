import pytest
from pyspark.sql import functions as F

from rosterline.functions import validators as v
from rosterline.operators.inference import infer_types

VALIDATORS = {
    "npi": (["1700000017", "0000000000", "١٢٣٤٥٦٧٨٩٠"], ["170000001", "17000000170", "17000O0017", ""]),
    "email": (["o.krantz+desk@lakeside.co.example"], ["krantz@", "@lakeside.example", "lakeside.example", ""]),
    "phone": (
        ["(907) 234-1180", "907-234-1180", "9072341180", "+1-907-234-1180", "907.234.1180", "+1 (907) 234-1180"],
        ["907-234", "none", ""],
    ),
    "practiceState": (["AK", "OR", "VT", "DC"], ["ak", "ORE", "V", "50", ""]),
    "boolean": (
        ["true", "True", "TRUE", "yes", "1", "y", "opt-in", "opted-in", "false", "no", "0", "n", "opt-out"],
        ["perhaps", "3", ""],
    ),
    "firstName": (["Imani", "Anne-Luz", "D'Arcy", "PIET", "Anna Lena"], ["imani", "I", "907", ""]),
    "specialty": (["Radiology", "OB/GYN", "ENT & Head Surgery"], ["R", "907", ""]),
}


@pytest.mark.parametrize("kind", VALIDATORS)
def test_validators(spark, kind):
    good, bad = VALIDATORS[kind]
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, expected boolean")
    wrong = df.where(v.CHECKS[kind](F.col("x")) != F.col("expected")).collect()
    assert wrong == []


def test_normalize(spark):
    df = spark.createDataFrame([("  test  ",), (None,), (" 　a b\x1c\t",), ("",)], "x string")
    assert [r.n for r in df.select(v.normalize(F.col("x")).alias("n")).collect()] == ["test", "", "a b", ""]


@pytest.mark.parametrize(
    "npi, valid",
    [("1234567893", True), ("1122334455", True), ("5544332211", True), ("1234567890", False), ("0000000001", False),
     ("9988776655", False), ("4455667788", False), ("9988221100", False), ("9876543210", False), ("12", False)],
)
def test_check_digit(spark, npi, valid):
    df = spark.createDataFrame([(npi,)], "npi string")
    assert df.select(v.has_valid_check_digit(F.col("npi"))).first()[0] is valid


def types(df, **kw):
    return {r["column"]: r["inferred_type"] for r in infer_types(df, **kw).collect()}


PROVIDERS = [
    ("1700000017", "Ottilie", "Krantz", "o.krantz@lakeside.example", "(907) 234-1180", "AK", "Dermatology", "opt-in"),
    ("1700000025", "Bao", "Tran", "bao+office@riverbend.example", "907-234-1181", "OR", "Family Medicine", "no"),
    ("1700000033", "Imani", "Okafor", "imani@okafor.example", "9072341182", "NM", "OB/GYN", "0"),
    ("1700000041", "Luz", "Del Rio", "luz.delrio@mesa.example", "(907) 234-1183", "VT", "Urology", "false"),
    ("1700000058", "Piet", "Vos", "piet_vos@polder.example", "907.234.1184", "ME", "Radiology", "y"),
]
HEADER = ["npi", "first_name", "last_name", "email", "phone", "practice_state", "specialty", "has_opted_in"]


def test_complete_provider_list(spark):
    expected = ["npi", "firstName", "lastName", "email", "phone", "practiceState", "specialty", "boolean"]
    df = spark.createDataFrame(PROVIDERS, HEADER)
    assert types(df) == dict(zip(HEADER, expected))
    assert types(df, sample_rows=5, order_by=["npi"]) == dict(zip(HEADER, expected))


def column(spark, name, values):
    return spark.createDataFrame([(x,) for x in values], f"`{name}` string")


@pytest.mark.parametrize(
    "name, values, expected",
    [
        ("npi", ["1234567890"] * 9 + ["x"], "npi"),
        ("opted_in", ["yes"] * 9 + ["perhaps"], "boolean"),
        ("opted_in", ["yes"] * 8 + ["perhaps 1", "perhaps 2"], "boolean"),  # by value: 80 % is the best share
        ("opted_in", ["yes"] * 2 + ["12-34"] * 8, "string"),
        ("Email", ["a@b.co"] * 4 + ["x"], "email"),
        ("c1", ["1234567890"] * 5, "npi"),
        ("c1", ["CA", "NY", "TX"], "practiceState"),
        ("c1", ["Cardiology", "Neurology"], "firstName"),
        ("c1", ["OB/GYN", "ENT & Head Surgery"], "specialty"),
        ("c1", ["true", "false"], "boolean"),
        ("c1", ["a@b.co", "42"], "email"),
        ("c1", ["a@b.co", "42", "42"], "string"),
        ("c1", [None, None], "string"),
        ("consent", [None, " "], "string"),
        ("c1", [], "string"),
    ],
)
def test_type_of_column(spark, name, values, expected):
    assert types(column(spark, name, values)) == {name: expected}


def test_typed_columns_and_nan(spark):
    df = spark.createDataFrame([(1234567890, float("nan"), True), (1234567891, None, False)], "a long, b double, c boolean")
    assert types(df) == {"a": "npi", "b": "string", "c": "boolean"}


def test_many_columns_need_one_scan(spark):
    wide = spark.range(50).select(*[F.lit("CA").alias(f"c{i}") for i in range(200)])
    found = infer_types(wide)
    assert found.where("inferred_type = 'practiceState' AND records = 50").count() == 200
