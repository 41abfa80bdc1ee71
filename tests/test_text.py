import pytest
from pyspark.sql import functions as F

from wardcast.operators.text import extract_json_block, parse_or_rule, parse_structured, render_template

GOOD = '{"alertLevel":"high","riskFactors":["a","b"],"recommendedUrgency":"prepare"}'
CASES = [
    (GOOD, "raw", "answer"),
    (f"Sure!\n```json\n{GOOD}\n```\nDone {{}}", "repaired", "answer"),
    (f"```\n{GOOD}```", "repaired", "answer"),
    ("{end_of_range=" + GOOD[1:] + " bye", "repaired", "answer"),
    (GOOD.replace('"alertLevel"', "“alertLevel”") , "repaired", "answer"),
    ("no braces here", "failed", "rule"),
    ("} backwards {", "failed", "rule"),
    ("{broken: json", "failed", "rule"),
    ('{"alertLevel":"high"}', "failed", "rule"),
    (GOOD.replace("high", "severe"), "raw", "rule"),
    (None, "failed", "rule"),
    ("", "failed", "rule"),
]


@pytest.mark.parametrize("text,status,decided", CASES)
def test_answers(spark, text, status, decided):
    df = spark.createDataFrame([(text, "low", "monitor", ["r"])], "t string, alert_level string, urgency string, risk_factors array<string>")
    row = parse_or_rule(df, "t").first()
    assert (row["parse_status"], row["decided_by"]) == (status, decided)
    assert row["alert_level"] == ("high" if decided == "answer" else "low")
    assert row["risk_factors"] == (["a", "b"] if decided == "answer" else ["r"])


def test_whole_long_texts_are_read(spark):
    text = "x" * 200_000 + GOOD + "y" * 200_000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract_json_block(F.col("t"))).first()[0] == GOOD
    assert parse_structured(df, "t").first()["parse_status"] == "repaired"


def test_template(spark):
    df = spark.createDataFrame([(3, "x")], "n int, s string")
    assert df.select(render_template("{{a}} {n}-{s}!", {"n": F.col("n"), "s": F.col("s")})).first()[0] == "{a} 3-x!"
