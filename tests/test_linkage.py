import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rosterline.operators import linkage, outliers, registry, segments

LOW_THRESHOLDS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}

FIELDS = "record_id long, npi string, first_name string, last_name string, specialty string, state string, email string, phone string, address string, source string"


def records(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def skewed_records(spark, n=4000):
    """A third of all records share one placeholder number, some have none, the rest are in small blocks."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        u = rng.random()
        npi = "0000000000" if u < 1 / 3 else None if u < 0.4 else " " if u < 0.45 else str(1_000_000_000 + rng.randrange(n))
        rows.append((i, npi, f"F{i}", "L", "S", "CA", None, None, "A", f"u{i % 3}"))
    rng.shuffle(rows)
    return rows, records(spark, rows).repartition(8)


def test_pairs_cover_every_duplicate_of_a_hot_block(spark):
    rows, df = skewed_records(spark)
    blocks = {}
    for r in rows:
        if r[1] and r[1].strip():
            blocks.setdefault(r[1], []).append(r[0])
    expected = sorted((npi, min(ids), i) for npi, ids in blocks.items() for i in ids if i != min(ids))
    found = linkage.duplicate_pairs(df).collect()
    assert sorted((r.block, r.rec1, r.rec2) for r in found) == expected
    assert all(r.a.first_name == f"F{r.rec1}" and r.b.first_name == f"F{r.rec2}" for r in found)


@pytest.fixture
def low_thresholds(spark):
    before = {key: spark.conf.get(key, None) for key in LOW_THRESHOLDS}
    for key, value in LOW_THRESHOLDS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_split_beside_a_table_and_beside_an_aggregate(spark, low_thresholds):
    """Half of the rows share a key: number (registry), practice (companies), block and group (aggregates)."""
    rows = spark.range(0, 20_000, 1, 8).selectExpr(
        "id AS record_id",
        "CASE WHEN id % 2 = 0 THEN '0000000000' ELSE CAST(1000000000 + id % 4000 AS STRING) END AS npi",
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('p', id % 500) END AS practice",
        "concat('F', id) AS first_name", "sha2(string(id), 256) AS last_name", "'S' AS specialty", "'CA' AS state",
        "concat('a@', id % 7, '.org') AS email", "sha2(string(id + 1), 256) AS phone", "'A' AS address", "'u' AS source",
        "id * 7919 % 1000 / 1000 AS v",
    )
    known = rows.selectExpr("npi", "'Active' AS status", "specialty", "1 AS deactivated_year").distinct()
    names = [("hot", "1.org")] + [(f"p{i}", "1.org") for i in range(500)]
    practices = spark.createDataFrame(names, "practice string, email_domain string")
    plans = {
        "registry": registry.validate(rows, known),
        "companies": outliers.domain_mismatch(rows, practices, "practice"),
        "blocks": linkage.duplicate_pairs(rows),
        "groups": outliers.statistical_outliers(rows, "practice", "v"),
    }
    assert {name for name, df in plans.items() if "skew=true" not in final_plan(df)} == set()


DUPLICATES = [
    (1, "1700000017", "Wilhelmina", "Ashdown", "Radiology", "VT", "w.ashdown@polder.example", "(907) 234-1184", "7 Mill Lane", "north"),
    (2, "1700000017", "Mina", "Ashdown", "Radiology", "VT", "mina@ashdown.example", "(907) 234-1184", "7 Mill Lane", "south"),
    (3, "1700000025", "Bao", "Tran", "Urology", "ME", None, "(907) 234-1181", "22 Harbour Row", "north"),
    (4, "1700000025", "Bao", "Tran", "Urology", "ME", None, "(907) 234-1181", "22 Harbour Row", "north"),
]


def test_similarity_differences_and_origin(spark):
    pairs = linkage.duplicate_pairs(records(spark, DUPLICATES))
    found = {
        r.rec1: r
        for r in linkage.with_origin(linkage.with_differences(linkage.with_similarity(pairs))).collect()
    }
    assert found[3].similarity == 100 and found[3].differences == [] and found[3].origin == "Same upload"
    assert [x.field for x in found[1].differences] == ["first_name", "email", "source"]
    assert found[1].origin == "Cross-upload" and 60 < found[1].similarity < 95


def test_registry_issues(spark):
    df = spark.createDataFrame(
        [(1, "0000000001", "Surgery"), (2, "9988776655", "Cardiology"), (3, "1122334455", "Surgeon"),
         (4, "1234567893", "Oncology"), (5, None, "Oncology")],
        "record_id int, npi string, specialty string",
    )
    known = spark.createDataFrame(
        [("9988776655", "Inactive", "Cardiology", 2019), ("1122334455", "Active", "GP", None), ("1234567893", "Active", "oncology", None)],
        "npi string, status string, specialty string, deactivated_year int",
    )
    found = {r.record_id: (r.issues, r.issue_type, r.severity) for r in registry.validate(df, known).collect()}
    assert found == {
        1: (["Invalid", "Not Found"], "Invalid", "High"),
        2: (["Inactive", "Invalid"], "Inactive", "Medium"),
        3: (["Mismatch"], "Mismatch", "Medium"),
        4: ([], None, None),
        5: (["Invalid", "Not Found"], "Invalid", "High"),
    }
    assert registry.errors(registry.validate(df, known)).count() == 4
    assert registry.errors(registry.validate(df, None)).count() == 0


def test_outliers_in_a_dominating_group(spark):
    rows = [(i, "big", 100.0 + i % 7) for i in range(2000)] + [(9001, "big", 2000.0), (9002, "small", 1.0), (9003, "small", 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    found = {r.id: r for r in outliers.statistical_outliers(df, "g", "v").collect()}
    assert found[9001].severity == "High" and found[9001].ratio > 10
    assert 9002 not in found  # a group without spread has no outlier


def test_plausibility(spark):
    active = spark.createDataFrame([("a", f"S{i}") for i in range(12)] * 3 + [("b", "S1")], "npi string, state string")
    assert [tuple(r) for r in outliers.geographic_spread(active, ["npi"], "state").collect()] == [("a", 12)]
    licences = spark.createDataFrame([(1, "2048-07-19"), (2, "2046-07-18"), (3, None)], "id int, expiry string")
    assert [r.id for r in outliers.implausible_expiry(licences, "expiry", "2026-07-18").collect()] == [1]
    mails = spark.createDataFrame([(1, "p", "A@Clinic.org"), (2, "p", "b@mail.com"), (3, "p", None), (4, "q", "x@y.z")], "id int, practice string, email string")
    practices = spark.createDataFrame([("p", "clinic.org"), ("q", None)], "practice string, email_domain string")
    assert [r.id for r in outliers.domain_mismatch(mails, practices, "practice").collect()] == [2]


def test_segments_keep_every_provider(spark):
    rows = [(i, "Card" if i % 2 else "Onc", "N" if i % 3 else "S", float(i % 2) * 1000 + i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, specialty string, region string, volume double")
    clustered = segments.segment(df, ["specialty", "region"], ["volume"], k=3)
    assert clustered.select("id").distinct().count() == 300
    shown = segments.profile(clustered, "segment", "specialty", "region").collect()
    assert sum(r["size"] for r in shown) == 300 and len(shown) == 3
    wide = df.withColumn("x", F.expr("cast(id * 7919 as string)")).unionByName(
        spark.range(5000).selectExpr("id", "'a' specialty", "'b' region", "1.0D volume", "cast(-id as string) x"))
    assert segments.segment(wide, ["x"], ["volume"], k=3).count() == 5300


def _plain_prototypes(rows, k, rounds, weight):
    """The same rounds in loops over (key, category, number)."""
    numbers = [x if x is not None and math.isfinite(x) else None for _, _, x in rows]
    known = [x for x in numbers if x is not None]
    mean = sum(known) / len(known)
    deviation = (sum((x - mean) ** 2 for x in known) / len(known)) ** 0.5
    unit = [0 if x is None or not deviation else math.floor(1000 * (x - mean) / deviation + 0.5) for x in numbers]
    points = [(c, z) for (_, c, _), z in zip(rows, unit, strict=True)]
    place = ["" if key is None else hashlib.md5(str(key).encode()).hexdigest() for key, _, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (place[i], points[i][0] is not None, points[i][0] or "", points[i][1]))
    now = list(dict.fromkeys(points[i] for i in order[: segments.TRIES * k]))[:k]
    near = lambda p: min(range(len(now)), key=lambda s: ((p[1] - now[s][1]) ** 2 + weight * (p[0] != now[s][0]), s))
    for _ in range(rounds):
        held = [[p for p, s in zip(points, map(near, points), strict=True) if s == i] for i in range(len(now))]
        modes = [Counter(c for c, _ in h) for h in held]
        now = [
            (min(m, key=lambda c: (-m[c], c is not None, c or "")), math.floor(sum(z for _, z in h) / len(h))) if h else old
            for h, m, old in zip(held, modes, now, strict=True)
        ]
    return Counter((key, near(p)) for (key, _, _), p in zip(rows, points, strict=True))


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_prototypes_equal_plain_rounds(spark, rounds):
    rows = [(i, "abcd"[i * i % 4], float(i * 37 % 101)) for i in range(400)]
    rows += [(None, None, 5.0), (7, None, None), (7, "a", float("nan")), (8, "", float("inf")), (9, "z", 1e6)] * 2
    df = spark.createDataFrame(rows, "key int, kind string, `a.b` double").withColumns({"c0": F.lit("x"), "z0": F.lit(1), "first": F.lit(2)})
    expected = _plain_prototypes(rows, 5, rounds, 500_000)
    for partitions in (1, 7):
        found = segments.prototypes(df.repartition(partitions), "key", ["kind"], ["a.b"], 5, rounds)
        assert found.columns == [*df.columns, "segment"]
        assert Counter((r.key, r.segment) for r in found.collect()) == expected


def test_prototypes_of_few_or_equal_rows(spark):
    empty = spark.createDataFrame([], "key int, kind string, x double")
    assert segments.prototypes(empty, "key", ["kind"], ["x"]).collect() == []
    equal = spark.createDataFrame([(i, "a", 1.0) for i in range(20)], "key int, kind string, x double")
    assert {r.segment for r in segments.prototypes(equal, "key", ["kind"], ["x"]).collect()} == {0}
    assert {r.segment for r in segments.prototypes(equal, "key", [], ["x"]).collect()} == {0}
    two = equal.withColumn("kind", F.when(F.col("key") % 2 == 0, "a").otherwise("b"))
    assert len({(r.kind, r.segment) for r in segments.prototypes(two, "key", ["kind"], []).collect()}) == 2


def test_names_are_listed_as_a_reader_sorts_them(spark):
    pairs = spark.createDataFrame(
        [(n, ("x", n)) for n in ("Zimmer", "adams", "Élan", "Baker")], "rec2 string, a struct<first_name: string, last_name: string>"
    )
    assert [r.rec2 for r in linkage.by_name(pairs).collect()] == ["adams", "Baker", "Élan", "Zimmer"]
