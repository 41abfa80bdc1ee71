import pytest
from pyspark.sql import functions as F

from wardcast.operators import clean as C


def test_text_in_numeric_columns(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("",), (" 2 ",)], "v string")
    assert [r["v"] for r in C.coerce_numeric(df, ["v"]).collect()] == [1.5, 0.0, 0.0, 0.0, 2.0]


def test_unreadable_dates_become_null(spark):
    df = spark.createDataFrame([("2025-02-28",), ("2025-02-30",), ("soon",)], "date string")
    assert [str(r["date"]) for r in C.coerce_date(df).collect()] == ["2025-02-28", "None", "None"]


def test_duplicates_and_first(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "a", 2.0), (1, "b", 9.0), (2, "a", 1.0), (2, "a", 1.5), (2, "a", 1.0)], "h int, d string, v double")
    assert tuple(C.count_duplicates(df, ["h", "d"]).first()) == (2, 5, 3)
    assert sorted(tuple(r) for r in C.dedup_keep_first(df, ["h", "d"], ["v"]).collect()) == [(1, "a", 2.0), (1, "b", 9.0), (2, "a", 1.0)]
    assert tuple(C.count_duplicates(df.limit(0), ["h", "d"]).first()) == (0, 0, 0)


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    plan = C.dedup_keep_first(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and C.dedup_keep_first(df, ["k"], ["v"]).collect() == [(1, 0)]


def test_quarantine(spark):
    df = spark.createDataFrame([("xgb", 5.0, 0.5), ("odd", 5.0, 0.5), ("tft", -1.0, 2.0), (None, None, 0.0)], "mode string, aqi double, s double")
    marked = C.with_reasons(df, C.mode_rule() | C.score_range_rules("aqi", ["s"]))
    assert [r["reject_reasons"] for r in marked.collect()] == [[], ["mode"], ["aqi_negative", "s_outside_0_1"], ["mode", "aqi_negative"]]
    assert C.valid_rows(marked).count() == 1 and C.rejected_rows(marked).count() == 3


def test_audit_reports_absent_columns_and_require_raises(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "7")], "aqi double, city string")
    rows = {r["column_name"]: r for r in C.column_audit(df, ["aqi", "city", "temp"]).collect()}
    assert (rows["aqi"]["filled"], rows["aqi"]["nulls"], rows["city"]["high"]) == (1, 1, 7.0)
    assert (rows["temp"]["present"], rows["temp"]["nulls"], rows["temp"]["low"]) == (0, 2, None)
    with pytest.raises(ValueError, match="temp"):
        C.require_columns(df, ["aqi", "temp"])


def test_entity_ids(spark, days):
    rows = [("Pune", d, i % 2, i) for i, d in enumerate(days(4))]
    df = spark.createDataFrame(rows, "city string, date date, hospital_id_enc int, row int")
    assert {r["hospital_id"] for r in C.derive_entity_id(df).collect()} == {"Pune_0", "Pune_1"}
    assert {r["hospital_id"] for r in C.derive_entity_id(df.withColumn("group_id", F.lit("G"))).collect()} == {"G"}
    assert sorted(r["hospital_id"] for r in C.number_within(df.drop("hospital_id_enc"), "city", "row").collect()) == [f"Pune_{i}" for i in range(4)]
    with pytest.raises(ValueError):
        C.derive_entity_id(df.drop("hospital_id_enc"))
