from pyspark.sql import functions as F

from rankboard import constants as K
from rankboard.functions import (answered_label, clock_label, feedback_text, first_token, grade_points,
                                 is_complete, last_token, medal, progress_label, progress_pct, tier,
                                 truncate_id)


def _one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_grading_strips_unicode_whitespace_and_case(spark):
    rows = [("Parquet", "Parquet"), ("  parquet ", "Parquet"), ("\tPARQUET ", "Parquet"),
            ("Parquet!", "Parquet"), (None, "Parquet"), ("", "Parquet"), (" All of the above\n", "all of the above")]
    got = _one(spark, rows, "a string, c string", grade_points("a", "c").alias("p"))
    assert [g[0] for g in got] == [10, 10, 10, 0, 0, 0, 10]


def test_feedback_is_exact_not_normalised(spark):
    rows = [("Parquet", "Parquet"), (" parquet", "Parquet")]
    got = _one(spark, rows, "a string, c string", feedback_text("a", "c"))
    assert got == [(K.FEEDBACK_CORRECT,), (K.FEEDBACK_INCORRECT_PREFIX + "Parquet",)]


def test_medal_and_tier(spark):
    got = _one(spark, [(1,), (2,), (3,), (4,), (12,)], "r long", medal("r"), tier("r"))
    assert got == [("🥇", "gold"), ("🥈", "silver"), ("🥉", "bronze"), ("#4", "none"), ("#12", "none")]


def test_progress_label_rounds_half_to_even(spark):
    rows = [(12.5,), (13.5,), (100.0,), (120.0,), (0.0,)]
    got = _one(spark, rows, "p double", progress_label("p"), is_complete("p"))
    assert got == [("12%", False), ("14%", False), ("100%", True), ("120%", False), ("0%", False)]


def test_progress_pct_zero_max_and_uncapped(spark):
    got = _one(spark, [(60,)], "t long", progress_pct("t", 50).alias("a"), progress_pct("t", 0).alias("b"))
    assert got == [(120.0, 0.0)]


def test_answered_label(spark):
    assert _one(spark, [(7,)], "n long", answered_label("n", 5)) == [("7/5",)]


def test_name_split_edges(spark):
    rows = [("John Doe",), ("Digital Workshop Admin",), ("",), ("Ann",), ("Ann ",), (" Ann",), (None,)]
    got = _one(spark, rows, "n string", first_token("n"), last_token("n"))
    assert got == [("John", "Doe"), ("Digital", "Admin"), ("", ""), ("Ann", "Ann"), ("Ann", ""),
                   ("", "Ann"), (None, None)]


def test_truncate_id(spark):
    rows = [("demo-user-1",), ("0123456789abcdef",), ("0123456789abcde",)]
    got = _one(spark, rows, "i string", truncate_id("i"))
    assert got == [("demo-user-1",), ("0123456789ab...",), ("0123456789abcde",)]


def test_clock_label(spark):
    df = spark.createDataFrame([("2024-01-01 07:08:09.5",)], "s string").select(
        clock_label(F.to_timestamp("s")).alias("c"))
    assert df.first()["c"] == "07:08:09"
