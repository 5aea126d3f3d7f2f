import datetime

import pytest
from pyspark.sql import functions as F

from roadloom.functions import text
from roadloom.functions.dates import release_date, weeks_between


def _value(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("sentence, number", [
    ("There are 13 pharmacies.", 13.0), ("Es gibt 460,27 Kilometer.", 460.27),
    ("1.542 Segmente", 1542.0), ("1,542 segments", 1542.0), ("about 0.70.", 0.70),
])
def test_number_readings(spark, sentence, number):
    assert any(abs(v - number) < 1e-9 for v in _value(spark, text.number_readings("c"), sentence))


def test_dates_and_versions_do_not_break_readings(spark):
    assert _value(spark, text.number_readings("c"), "v 1.2.3 of 2026") == [123.0, 2026.0, 2026.0, 2026.0]
    assert _value(spark, text.number_readings("c"), "none") == []


@pytest.mark.parametrize("raw, clean", [
    ("Professional_service", "professional service"), ("a -_ b", "a b"), ("  X ", "x"),
])
def test_normalized(spark, raw, clean):
    assert _value(spark, text.normalized("c"), raw) == clean


@pytest.mark.parametrize("raw, clean", [("weird key!", "weird_key_"), ("a.b-c", "a_b_c"), ("", "prop"), ("ok", "ok")])
def test_clean_key(spark, raw, clean):
    assert _value(spark, text.clean_key("c"), raw) == clean


@pytest.mark.parametrize("name, date, model", [
    ("/r/2026-10-05_qwen3_8b.jsonl", "2026-10-05", "qwen3:8b"),
    ("2026-10-09_llama3.1_8b.jsonl", "2026-10-09", "llama3.1:8b"),
    ("2026-10-09_Some--Model-1.jsonl", "2026-10-09", "Some--Model-1"),
])
def test_run_names(spark, name, date, model):
    assert _value(spark, text.run_date("c"), name) == date
    assert _value(spark, text.run_model("c"), name) == model


def test_result_name(spark):
    assert _value(spark, text.result_name("c"), "Org/Model:1") == "Org--Model_1"


@pytest.mark.parametrize("a, b, rel, tol, close", [
    (460.27, 460.3, 0.01, 0.0, True), (470.0, 460.3, 0.01, 0.0, False),
    (0.7, 0.705, 0.0, 0.01, True), (1.0, 1.0 + 1e-10, 0.0, 0.0, True), (1.0, 1.001, 0.0, 0.0, False),
])
def test_close_to(spark, a, b, rel, tol, close):
    df = spark.range(1).select(text.close_to(F.lit(a), F.lit(b), F.lit(rel), F.lit(tol)).alias("v"))
    assert df.first()["v"] is close


def test_release_dates(spark):
    assert _value(spark, release_date("c"), "2026-08-19.0") == datetime.date(2026, 8, 19)
    assert _value(spark, release_date("c"), None) is None
    with pytest.raises(Exception, match="Unrecognised release id"):
        _value(spark, release_date("c"), "not-a-release")


def test_weeks(spark):
    weeks = spark.range(1).select(weeks_between(
        F.lit("2026-07-22").cast("date"), F.lit("2026-08-19").cast("date"), 4, 4).alias("v")).first()["v"]
    assert len(weeks) == 13
    assert (weeks[0], weeks[-1]) == (datetime.date(2026, 6, 24), datetime.date(2026, 9, 16))
