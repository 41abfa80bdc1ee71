import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from wardcast.catalog.files import _panel_files
from wardcast.plans.tables import lagged_panel
from wardcast.session import scratch_path
from wardcast.sources import readers as R
from wardcast.sources.schemas import PANEL
from wardcast.sources.writers import sink_plan_json

RECORD = {
    "date": "2023-02-14", "admissions": 31, "aqi": 88, "temp": 11.5, "humidity": 43, "rainfall": 0.5, "wind_speed": 3.0,
    "mobility_index": 20, "outbreak_index": 7, "festival_flag": 0, "holiday_flag": 1, "weekday": 1, "is_weekend": 0,
    "population_density": 900, "hospital_beds": 12, "staff_count": 34, "city_id": 9, "hospital_id_enc": 5,
}


def test_plain_city_files_and_a_bad_one(spark, folder, tmp_path):
    one_city = lagged_panel(spark, folder).where("city = 'ASIA'").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL])
    one_city.toPandas().to_csv(tmp_path / "navi mumbai_xgb.csv", index=False)
    got = R.scan_all_entities(spark, str(tmp_path))
    assert got.count() == one_city.count() and {r["city"] for r in got.select("city").distinct().collect()} == {"Navi mumbai"}
    (tmp_path / "bad_xgb.csv").write_text("date,city\n2025-01-01,Bad\n")
    assert R.scan_all_entities(spark, str(tmp_path)).count() == one_city.count()
    (tmp_path / "odd_xgb.csv").write_text((tmp_path / "navi mumbai_xgb.csv").read_text().split("\n")[0] + "\nnot a date" + ",1" * 22 + "\n")
    rejects = {r["file"].rpartition("/")[2]: (r["reason"], r["rows"]) for r in R.scan_rejects(spark, str(tmp_path)).collect()}
    assert rejects == {"bad_xgb.csv": ("no row in the expected layout", None), "odd_xgb.csv": ("unreadable rows", 1)}
    assert R.scan_all_entities(spark, str(tmp_path)).count() == one_city.count()
    with pytest.raises(Exception):
        R.scan_all_entities(spark, str(tmp_path), skip_bad=False).count()
    assert R.scan_entity_csv(spark, str(tmp_path), "Navi Mumbai").count() == one_city.count()
    with pytest.raises(AnalysisException):
        R.scan_entity_csv(spark, str(tmp_path), "Nowhere")


def test_a_large_file_with_another_header_is_left_out_whole(spark, folder, tmp_path):
    """Its later blocks have as many columns of the same kinds; only its start tells that they are others."""
    one_city = lagged_panel(spark, folder).where("city = 'ASIA'").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL])
    local = one_city.toPandas()
    local.to_csv(tmp_path / "asia_xgb.csv", index=False)
    local.rename(columns={"aqi": "temp", "temp": "aqi"}).to_csv(tmp_path / "other_xgb.csv", index=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert R.scan_all_entities(spark, str(tmp_path)).groupBy("city").count().collect() == [("Asia", len(local))]
        rejects = [(r["file"].rpartition("/")[2], r["reason"], r["rows"]) for r in R.scan_rejects(spark, str(tmp_path)).collect()]
        assert rejects == [("other_xgb.csv", "no row in the expected layout", None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_folder_per_city(spark, folder):
    base = _panel_files(spark, folder)
    picked = R.scan_all_entities(spark, base, cities=["Asia", "europe"])
    with pytest.raises(AnalysisException):
        R.scan_entity_csv(spark, base, "sia")
    assert {r["city"] for r in picked.select("city").distinct().collect()} == {"Asia", "Europe"}


@pytest.mark.parametrize("shape", ["list", "single", "data", "records"])
def test_pretty_printed_requests(spark, tmp_path, shape):
    data = {"list": [RECORD, RECORD], "single": RECORD, "data": {"data": [RECORD]}, "records": {"records": [RECORD]}}[shape]
    (tmp_path / "request.json").write_text(json.dumps({"mode": "tft", "data": data}, indent=2))
    rows = R.scan_json_payload(spark, str(tmp_path), multiline=True).collect()
    assert len(rows) == (2 if shape == "list" else 1)
    r = rows[0]
    assert (r["mode"], r["weight_tft"], r["hospital_id"], r["disease_sensitivity"]) == ("tft", 0.6, "HOSP-001", 0.5)
    assert (r["date"], r["aqi"], r["admissions"], r["hospital_id_enc"]) == ("2023-02-14", 88.0, 31, 5)


def test_tomorrow(spark):
    df = spark.createDataFrame([("2020-01-01",)], "date string")
    assert str(R.restamp_forecast_date(df, F.to_date(F.lit("2024-02-28"))).first()["date"]) == "2024-02-29"


def test_nothing_readable_is_an_error(spark, tmp_path):
    (tmp_path / "bad_xgb.csv").write_text("date,city\n2025-01-01,Bad\n")
    with pytest.raises(ValueError):
        R.scan_all_entities(spark, str(tmp_path))


def test_requests_are_kept_or_rejected(spark, tmp_path):
    lacking = {k: v for k, v in RECORD.items() if k != "aqi"}
    lines = ["\t" + json.dumps({"data": [RECORD, lacking]}), json.dumps({"data": [lacking]}), '{"data": [', json.dumps({"mode": "xgb"}), json.dumps({"data": []}),
             json.dumps({"data": "text"}), json.dumps({"request_id": "own", "data": RECORD}), json.dumps({"request_id": "own", "data": RECORD})]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n\n")
    rows = R.scan_json_payload(spark, str(tmp_path)).collect()
    assert sorted((r["position"], r["aqi"]) for r in rows) == [(0, 88.0), (0, 88.0), (1, None)] and "own" in {r["request_id"] for r in rows}
    reasons = sorted(r["reason"] for r in R.request_rejects(spark, str(tmp_path)).collect())
    assert reasons == ["missing columns: aqi", "no readable data", "no readable data", "no readable data", "not JSON"]


def test_different_requests_with_one_id_are_all_kept(spark, tmp_path):
    texts = [json.dumps({"request_id": "7", "data": {**RECORD, "aqi": aqi}}) for aqi in (10, 20)] + ['{"request_id": "7", "mode": "xgb"}']
    (tmp_path / "a.json").write_text("\n".join([*texts, texts[0]]))
    (tmp_path / "b.json").write_text("\n".join([texts[1], json.dumps({"request_id": "8", "data": RECORD})]))
    rows = R.scan_json_payload(spark, str(tmp_path)).collect()
    assert sorted(r["aqi"] for r in rows) == [10, 20, 20, 88] and len({r["request_id"] for r in rows}) == 4
    rejects = R.request_rejects(spark, str(tmp_path)).collect()
    assert [r["reason"] for r in rejects] == ["no readable data"]
    ids = [r["request_id"] for r in [*rows, *rejects]]
    assert len(set(ids)) == 5 and ids.count("7") == ids.count("8") == 1
    assert sorted(ids) == sorted(r["request_id"] for r in R.scan_requests(spark, str(tmp_path)).collect())


def test_plan_files_are_compressed_and_whole(spark):
    path = scratch_path(spark, "plans")
    plans = spark.range(5000).select(F.struct(F.col("id").alias("requestId"), F.lit("Wear a mask outdoors " * 10).alias("advisory")).alias("plan"))
    for _ in range(2):  # a date written again is replaced
        sink_plan_json(plans, path, F.to_timestamp(F.lit("2025-12-05 10:30:00")))
    back = spark.read.schema(plans.schema.add("run_date", "date")).json(path)
    assert back.agg(F.countDistinct("plan.requestId"), F.count("*")).first()[:2] == (5000, 5000)
    size = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("path like '%.json%'").agg(F.sum("length")).first()[0]
    assert size < 5000 * len("Wear a mask outdoors ")
