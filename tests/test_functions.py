import math

import pytest
from pyspark.sql import functions as F

from tallyframe import functions as fn


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("125.0", 125), (" 7 ", 7), ("7.5", None), ("x", None), ("", None), (None, None)])
def test_whole_number(spark, text, want):
    assert one(spark, fn.whole_number(F.col("x")), text) == want


@pytest.mark.parametrize(("text", "want"), [("12.2", 38), ("12", 36), ("0.1", 1), ("12.3", None), ("-1.0", None), ("abc", None), (None, None)])
def test_innings_to_outs(spark, text, want):
    assert one(spark, fn.innings_to_outs(F.col("x")), text) == want


def test_first_date(spark):
    for text in ("2021-07-04", "20210704", "07/04/2021"):
        assert one(spark, fn.first_date(F.col("x")), text).isoformat() == "2021-07-04"
    assert one(spark, fn.first_date(F.col("x")), "July 4") is None


def test_exact_age(spark):
    df = spark.createDataFrame([(2000, 2, 29), (2001, 2, 29), (2001, None, 1), (None, None, None), (2030, 1, 1)], "y int, m int, d int")
    age, status = fn.exact_age(F.col("y"), F.col("m"), F.col("d"), F.lit("2024-02-29").cast("date"))
    got = [tuple(r) for r in df.select(age, status).collect()]
    assert got[0][0] == pytest.approx(8766 / 365.2425)
    assert [s for _, s in got] == ["exact_birth_date", "invalid_birth_date", "partial_birth_date", "missing_birth_date", "birth_after_as_of"]
    assert [a for a, _ in got[1:]] == [None] * 4


def test_direction_boundary_is_center(spark):
    scale = 0.75
    x = [125.42 + 100 * math.tan(math.radians(a / scale)) for a in (-15.001, -15 + 1e-9, 15 - 1e-9, 15.001)]
    df = spark.createDataFrame([(v, 98.27, s) for v in x for s in ("R", "L")], "x double, y double, s string")
    got = [r[0] for r in df.select(fn.batted_direction(F.col("x"), F.col("y"), F.col("s"))).collect()]
    assert got == ["pull", "opposite", "center", "center", "center", "center", "opposite", "pull"]
    assert one(spark, fn.batted_direction(F.lit(None).cast("double"), F.lit(1.0), F.lit("R")), "x") is None
    assert one(spark, fn.batted_direction(F.lit(1.0), F.lit(1.0), F.lit("S")), "x") is None


def test_location_direction(spark):
    df = spark.createDataFrame([("7", "R"), ("9.0", "R"), ("8", "L"), ("3", "L"), ("12", "R"), ("7", "S")], "l string, s string")
    got = [r[0] for r in df.select(fn.location_direction(F.col("l"), F.col("s"))).collect()]
    assert got == ["pull", "opposite", "center", "pull", None, None]


def test_log_gamma(spark):
    values = [1e-3, 0.5, 1.0, 2.5, 17.0, 1234.5, 1e7]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, r in zip(values, df.select(fn.log_gamma(F.col("x"))).collect()):
        assert r[0] == pytest.approx(math.lgamma(v), rel=1e-11, abs=1e-10)


def test_links(spark):
    assert one(spark, fn.logistic(fn.logit(F.lit(0.37))), "x") == pytest.approx(0.37)
    assert one(spark, fn.logistic(F.lit(-800.0)), "x") == pytest.approx(0.0)
    assert one(spark, fn.harmonic(F.lit(30.0), F.lit(60.0)), "x") == 40.0
    assert one(spark, fn.harmonic(F.lit(0.0), F.lit(60.0)), "x") == 0.0
    assert one(spark, fn.bit_code(F.lit(True), F.lit(None).cast("boolean"), F.lit(True)), "x") == 5


def test_payload_hash_ignores_column_order_and_sees_null(spark):
    df = spark.createDataFrame([(1, None), (1, "")], "a int, b string")
    first = df.select(fn.payload_hash("a", "b").alias("h")).collect()
    second = df.select(fn.payload_hash("b", "a").alias("h")).collect()
    assert first == second and first[0] != first[1]


def test_membership_of_null_is_false(spark):
    assert one(spark, fn.member(F.col("x"), ["a"]), None) is False


def test_hash_fold(spark):
    import hashlib

    df = spark.range(50).select("id", fn.hash_fold(F.col("id")).alias("f"))
    for r in df.collect():
        assert r["f"] == int(hashlib.sha256(str(r["id"]).encode()).hexdigest()[:8], 16) % 5
