"""Reading panels and requests from files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.fixed_values import BLEND_WEIGHT, DEFAULT_HOSPITAL, DEFAULT_MODE, DEFAULT_SENSITIVITY, REQUEST_COLUMNS
from wardcast.functions.scalars import present_items, sentence_case
from wardcast.sources.schemas import FORECAST_PANEL, PANEL, RECORD, REQUEST


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A read-only Parquet table; its footers are read for the schema once per application."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _csv(spark: SparkSession, schema: T.StructType, skip_bad: bool):
    # enforceSchema=false compares the header with the schema instead of trusting positions;
    # without column pruning it does so for all columns, whatever a query selects
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnPruning", False)
        .option("ignoreCorruptFiles", skip_bad)
    )


def _city_glob(base: str, layout: str, cities: Sequence[str] | None = None) -> str:
    """Files ``<city>_<layout>.csv`` or the folders that ``sink_csv_by_entity`` writes."""
    names = "*" if cities is None else "{file=,}{" + ",".join(c.lower() for c in cities) + "}"
    return f"{base.rstrip('/')}/{names}_{layout}.csv"


def scan_entity_csv(spark: SparkSession, base: str, city: str) -> DataFrame:
    """One city's panel; a missing file is an error."""
    return _csv(spark, PANEL, False).csv(_city_glob(base, "xgb", [city]))


def scan_all_entities(
    spark: SparkSession, base: str, cities: Sequence[str] | None = None, skip_bad: bool = True
) -> DataFrame:
    """All panels below ``base`` in one read, the city taken from the file name.

    With ``cities`` only their files are listed. Absent ones, files of another layout and rows that cannot be read or have no date are left
    out and named by ``scan_rejects``; when nothing is left, this raises. Rows of one block stay in the order of the file.
    """
    kept = _panel_rows(spark, base, cities, skip_bad).where("_corrupt_record is null and date is not null").drop("_corrupt_record")
    if skip_bad:  # otherwise another header raises
        # one short row per file; broadcast, so that rows keep their order
        headed = _panel_rows(spark, base, cities, True).where("_metadata.file_block_start = 0").groupBy(F.col("_metadata.file_path").alias("_headed")).agg(F.count("*").alias("_rows"))
        kept = kept.join(F.broadcast(headed), F.col("_metadata.file_path") == F.col("_headed"), "left_semi")
    if kept.isEmpty():
        raise ValueError(f"no readable panel rows below {base}")
    return _with_city(kept, "xgb")


def _panel_rows(spark: SparkSession, base: str, cities: Sequence[str] | None, skip_bad: bool) -> DataFrame:
    kind = T.StructType([*PANEL, T.StructField("_corrupt_record", T.StringType())])
    return _csv(spark, kind, skip_bad).csv(_city_glob(base, "xgb", cities))


def scan_rejects(spark: SparkSession, base: str, cities: Sequence[str] | None = None) -> DataFrame:
    """What ``scan_all_entities`` leaves out: file, reason, rows (null for a whole file).

    A listed file without any row from its first block has another header, is damaged or is empty: the header is compared where a file starts, and later
    blocks of a large file of another layout are read as if it were right. Only names are listed, no content is read twice.
    """
    rows = _panel_rows(spark, base, cities, True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "*")
    seen = rows.groupBy("file").agg(F.count_if(F.expr("_corrupt_record is not null or date is null")).alias("rows"), F.count_if(F.col("start") == 0).alias("first"))
    listed = spark.read.format("binaryFile").load(_city_glob(base, "xgb", cities)).select(F.col("_metadata.file_path").alias("file")).where(~F.col("file").rlike("/_[^/]*$"))
    both = listed.join(seen.where("first > 0"), "file", "left")
    whole, some = F.col("rows").isNull(), F.col("rows") > 0
    return both.where(whole | some).select("file", F.when(whole, F.lit("no row in the expected layout")).otherwise(F.lit("unreadable rows")).alias("reason"), "rows")


def scan_forecast_layout(spark: SparkSession, base: str) -> DataFrame:
    """All panels with known covariates, the city taken from the file name."""
    return _with_city(_csv(spark, FORECAST_PANEL, False).csv(_city_glob(base, "tft")), "tft")


def _with_city(df: DataFrame, layout: str) -> DataFrame:
    stem = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), rf"([^/=]+)_{layout}\.csv", 1)
    return df.withColumn("city", sentence_case(stem))


def scan_flat_csv(spark: SparkSession, path: str, schema: T.StructType = PANEL, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV whose dates arrive as text and are parsed here."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "date" else f for f in schema])
    return _csv(spark, as_text, False).csv(path).withColumn("date", F.try_to_date("date", fmt))


def records_of(text: Column, record: T.StructType | T.MapType = RECORD) -> Column:
    """Array of records from a list, ``{"data": ..}``, ``{"records": ..}`` or a single record."""
    wrapper = F.from_json(text, "data string, records string")
    is_object = text.rlike(r"^\s*\{")
    inner = F.when(is_object, F.coalesce(wrapper["data"], wrapper["records"], text)).otherwise(text)
    if isinstance(record, T.MapType):  # only structs are read from a single object as an array
        return F.when(inner.rlike(r"^\s*\{"), F.array(F.from_json(inner, record))).otherwise(F.from_json(inner, T.ArrayType(record)))
    return F.from_json(inner, T.ArrayType(record))


def scan_requests(spark: SparkSession, path: str, multiline: bool = False, required: Sequence[str] = tuple(REQUEST_COLUMNS)) -> DataFrame:
    """One row per request: settings, ``records`` and ``reject_reasons`` (empty for good requests).

    Requests as JSON lines split across tasks; ``multiline`` reads one pretty-printed request per file. ``request_id`` is the request's own, or else
    a hash of its file and text. The same text twice in a file counts once. Of different requests with one id the one with the smallest file
    (then hash) keeps it, the others get their hash as if they had none. A request is rejected when it
    is no JSON, has no data, no readable record, or when a required column is in none of its records.
    """
    lines = spark.read.text(path, wholetext=multiline).select(F.col("_metadata.file_path").alias("file"), "value")
    return requests_of(lines, required).drop("own")


def requests_of(lines: DataFrame, required: Sequence[str] = tuple(REQUEST_COLUMNS)) -> DataFrame:
    """``scan_requests`` of texts already read (file, value); ``own`` is the hash of a request's file and text."""
    lines = lines.where(F.trim("value", F.lit(" \t\r\n")) != "")
    lines = lines.withColumn("own", F.sha2(F.concat_ws("\n", "file", "value"), 256))
    kind = T.StructType([*REQUEST, T.StructField("request_id", T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    r = F.col("r")
    read = lines.withColumn("r", F.from_json("value", kind)).withColumn("fields", records_of(r["data"], T.MapType(T.StringType(), T.StringType())))
    given = F.array_distinct(F.flatten(F.transform("fields", F.map_keys)))
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), given)
    broken = r.isNull() | r["_corrupt_record"].isNotNull()
    no_data = r["data"].isNull() | (F.size(F.coalesce("fields", F.array().cast("array<map<string,string>>"))) == 0)
    reason = (
        F.when(broken, F.lit("not JSON")).when(no_data, F.lit("no readable data"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
    )
    settings = [r[c].alias(c) for c in ("mode", "weight_tft", "hospital_id", "disease_sensitivity")]
    named = read.select(
        F.coalesce(r["request_id"], "own").alias("request_id"), "own", "file", *settings,
        records_of(r["data"]).alias("records"), present_items(reason).alias("reject_reasons")).dropDuplicates(["own"])
    ids = lines.select("file", "own", F.from_json("value", kind)["request_id"].alias("request_id")).where("request_id is not null")
    used = ids.groupBy("request_id").agg(F.min(F.struct("file", "own")).alias("_first"), F.max(F.struct("file", "own")).alias("_last")).where("_first < _last")
    both = payload_defaults(named).join(used.drop("_last"), "request_id", "left")
    request_id = F.when(F.col("own") != F.col("_first.own"), F.col("own")).otherwise(F.col("request_id"))
    return both.withColumn("request_id", request_id).drop("_first")


def scan_json_payload(spark: SparkSession, path: str, multiline: bool = False, required: Sequence[str] = tuple(REQUEST_COLUMNS)) -> DataFrame:
    """Records of good requests: one row each with its ``request_id``, ``position`` and the request's settings."""
    return request_records(scan_requests(spark, path, multiline, required))


def request_records(requests: DataFrame) -> DataFrame:
    """The records of requests without reject reasons."""
    good = requests.where(F.size("reject_reasons") == 0)
    opened = good.select("request_id", "mode", "weight_tft", "hospital_id", "disease_sensitivity", F.posexplode_outer("records").alias("position", "record"))
    return opened.select("request_id", "position", "mode", "weight_tft", "hospital_id", "disease_sensitivity", "record.*")


def request_rejects(spark: SparkSession, path: str, multiline: bool = False, required: Sequence[str] = tuple(REQUEST_COLUMNS)) -> DataFrame:
    """Requests that ``scan_json_payload`` leaves out: request_id, file, reason."""
    found = scan_requests(spark, path, multiline, required).where(F.size("reject_reasons") > 0)
    return found.select("request_id", "file", F.array_join("reject_reasons", "; ").alias("reason"))


def payload_defaults(df: DataFrame) -> DataFrame:
    """Fill absent request settings."""
    return df.withColumns({
        "mode": F.coalesce("mode", F.lit(DEFAULT_MODE)),
        "weight_tft": F.coalesce("weight_tft", F.lit(BLEND_WEIGHT)),
        "hospital_id": F.coalesce("hospital_id", F.lit(DEFAULT_HOSPITAL)),
        "disease_sensitivity": F.coalesce("disease_sensitivity", F.lit(DEFAULT_SENSITIVITY)),
    })


def restamp_forecast_date(df: DataFrame, as_of: Column, time: str = "date") -> DataFrame:
    """Set every record to the day after ``as_of``."""
    return df.withColumn(time, F.date_add(as_of, 1))
