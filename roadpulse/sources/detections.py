"""Read JSON detections, type them, and keep what was refused together with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.config import VEHICLE_CLASSES
from roadpulse.schemas import DETECTION

# How a moment and a number are written.
ISO_MOMENT = r"^(\d{4}-\d{2}-\d{2}([Tt _]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?)$"
NUMBER = r"^\s*([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)\s*$"
WHOLE = r"^\s*([+-]?\d+)(\.0*)?\s*$"
# Fixed value: numeric times beyond this many seconds are milliseconds.
MAX_EPOCH_SECONDS = 20_000_000_000


def read_detections(spark: SparkSession, source: str, fmt: str = "text", **options: str) -> DataFrame:
    """A1: one JSON text per record as ``value STRING``.

    ``fmt="kafka"`` subscribes to the topic ``source`` from the latest offset on and needs the connector on the
    class path as well as ``kafka.bootstrap.servers`` among the options. Any file format streams a folder.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        stream = reader.option("subscribe", source).option("startingOffsets", "latest").load()
        return stream.select(F.col("value").cast("string").alias("value"))
    return reader.schema("value STRING").load(source)


# Text that may have been a JSON number, boolean or nested value rather than a JSON string.
AMBIGUOUS = r"^(-?\d|true$|false$|[\[{])"

TEXTS = ("camera_id", "vehicle_id", "class", "vehicle_class")
NUMBERS = ("timestamp", "frame_id", "confidence", "lane_id", "speed_estimate")
BOXES = {"bbox": ("x", "y", "w", "h"), "centroid": ("x", "y")}
# Fields in the order in which they are judged.
REQUIRED = ("camera_id", "timestamp", "frame_id", "vehicle_id", "class", "confidence", "bbox", "centroid")
END = "#end"


def _record_schema() -> T.ArrayType:
    """Every leaf as text, so that a value of the wrong type spoils its own field only."""
    text = T.StringType()
    fields = [T.StructField(name, text) for name in (*TEXTS, *NUMBERS, END)]
    for name, edges in BOXES.items():
        fields.append(T.StructField(name, T.StructType([T.StructField(edge, text) for edge in edges])))
    return T.ArrayType(T.StructType(fields))


def _kind(path: str) -> Column:
    """JSON type of a field. A second parse, only reached for the few values whose text leaves it open."""
    document = F.try_parse_json("value")
    return F.schema_of_variant(F.try_variant_get(document, "$." + path, "variant"))


def _text(name: str) -> Column:
    """Text fields must be JSON strings; numbers are not turned into text."""
    text = F.col(f"_record.{name}")
    return F.when(~text.rlike(AMBIGUOUS), text).otherwise(F.when(_kind(name) == "STRING", text))


def _flag(path: str) -> Column:
    """1 or 0 for a JSON boolean, not for the same words in quotes."""
    word = F.col(f"_record.{path}")
    return F.when(word.isin("true", "false"), F.when(_kind(path) == "BOOLEAN", (word == "true").cast("int")))


def _number(path: str) -> Column:
    """Numbers may also come as text or as booleans."""
    digits = F.regexp_extract(f"_record.{path}", NUMBER, 1).try_cast("double")
    return F.coalesce(digits, _flag(path).cast("double"))


def _whole(name: str, kind: str) -> Column:
    """Whole numbers may be written as 7, 7.0 or "7"; 7.5 is refused. Digits are kept as such: a double loses some."""
    digits = F.regexp_extract(f"_record.{name}", WHOLE, 1).try_cast(kind)
    return F.coalesce(digits, _flag(name).cast(kind))


def _moment(name: str) -> Column:
    """ISO-8601 text, or seconds (large values: milliseconds) since 1970."""
    text = f"_record.{name}"
    iso = F.translate(F.regexp_extract(text, ISO_MOMENT, 1), "tz_,", "TZT.").try_cast("timestamp")
    seconds = F.regexp_extract(text, NUMBER, 1).try_cast("double")
    micros = F.when(F.abs(seconds) > MAX_EPOCH_SECONDS, seconds * 1e3).otherwise(seconds * 1e6)
    return F.coalesce(iso, F.timestamp_micros(F.round(micros).try_cast("bigint")))


def _box(name: str) -> Column:
    return F.struct(*[_number(f"{name}.{edge}").alias(edge) for edge in BOXES[name]])


def _complete(name: str) -> Column:
    """A nested object whose every edge is a number, else NULL."""
    box, given = F.col(f"_{name}"), F.lit(True)
    for edge in BOXES[name]:
        given = given & box[edge].isNotNull()
    return F.when(given, box)


def type_detections(df: DataFrame) -> DataFrame:
    """A2: parse ``value`` and add the typed fields and ``reject_reason`` (NULL for accepted records).

    One pass reads all fields as text. The parser stops at the end of a value and would not notice text after it, so
    the record is read as the first element of an array whose end must follow. The typed fields leave through
    ``inline``, so that a filter on them is not pushed below the parsing, where the optimizer would repeat it for
    every use of a field.
    """
    framed = F.concat(F.lit("["), "value", F.lit(f', {{"{END}": 1}}]'))
    parsed = df.select("value", F.from_json(framed, _record_schema()).alias("_records"))
    closed = (F.size("_records") == 2) & (F.get("_records", F.lit(1))[END] == "1")
    records = parsed.select("value", F.when(closed, F.get("_records", F.lit(0))).alias("_record"))
    # Nested conditions, not conjunctions: of those the optimizer would evaluate the costly side for every row.
    no_object = F.when(~F.ltrim("value").startswith("{"), F.when(F.try_parse_json("value").isNotNull(), "not_an_object"))
    fault = F.when(F.col("_record").isNull(), F.coalesce(no_object, F.lit("malformed_json")))
    typed = F.struct(
        fault.alias("_fault"),
        _text("camera_id").alias("camera_id"),
        _moment("timestamp").alias("timestamp"),
        _whole("frame_id", "bigint").alias("frame_id"),
        _text("vehicle_id").alias("vehicle_id"),
        F.when(F.col("_record.class").isNotNull(), _text("class")).otherwise(_text("vehicle_class")).alias("class"),
        _number("confidence").alias("confidence"),
        *[_box(name).alias(f"_{name}") for name in BOXES],
        _whole("lane_id", "int").alias("lane_id"),
        _number("speed_estimate").alias("speed_estimate"),
        F.col("_record.lane_id").isNotNull().alias("_has_lane"),
        F.col("_record.speed_estimate").isNotNull().alias("_has_speed"),
    )
    accepted = records.select("value", F.inline(F.array(typed))).withColumns({name: _complete(name) for name in BOXES})
    return accepted.select("value", *DETECTION.fieldNames(), _reject_reason().alias("reject_reason"))


def _reject_reason() -> Column:
    reason = F.when(F.col("_fault").isNotNull(), F.col("_fault"))
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull(), f"bad_{name}")
    return (
        reason.when(F.col("_has_lane") & F.col("lane_id").isNull(), "bad_lane_id")
        .when(F.col("_has_speed") & F.col("speed_estimate").isNull(), "bad_speed_estimate")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence_out_of_range")
        .when(~F.col("class").isin(*VEHICLE_CLASSES), "unknown_class")
    )


def parse_detections(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: accepted detections, and refused records as ``(value, reject_reason)``. Both work on streams."""
    typed = type_detections(df)
    valid = typed.filter(F.col("reject_reason").isNull()).select(*DETECTION.fieldNames())
    rejected = typed.filter(F.col("reject_reason").isNotNull()).select("value", "reject_reason")
    return valid, rejected


def reject_reasons(rejected: DataFrame) -> DataFrame:
    """Refused records per reason."""
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records"))
