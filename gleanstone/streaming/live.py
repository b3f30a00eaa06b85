"""The row-wise part of ingestion and scoring as Structured Streaming.

Line routing, mapping, coercion, validation and the signals that need no window facts are
projections, so they run on a stream as they are; counters per window of time bear late rows
up to a watermark, and exact duplicates are dropped by fingerprint within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions.text import fingerprint
from gleanstone.operators.ingest import build_records
from gleanstone.sources.mapping import FieldMapping


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JSON files as they arrive; line numbers aren't known on a stream."""
    raw = spark.readStream.text(folder)
    text = F.trim(F.regexp_replace("value", r"^\x{FEFF}", ""))
    payload = F.try_parse_json(text)
    fine = F.coalesce(F.schema_of_variant(payload).startswith("OBJECT"), F.lit(False))
    blank = text == ""
    return raw.select(
        F.lit(None).cast("bigint").alias("line_no"), F.when(fine, payload).alias("payload"), blank.alias("is_blank"),
        F.when(~blank & ~fine, F.lit("line_parse")).alias("error_type"), F.when(~blank & ~fine, F.lit("not one JSON object")).alias("detail"),
    )


def stream_records(lines: DataFrame, mapping: FieldMapping) -> DataFrame:
    """Built rows of a stream, valid and failed ones; sidecars need a batch."""
    return build_records(lines, mapping)


def deduplicated(records: DataFrame, time: str, late: str = "10 minutes", text: str = "input_text") -> DataFrame:
    """One row per fingerprint within the watermark."""
    return records.withColumn("fingerprint", fingerprint(F.col(text))).withWatermark(time, late).dropDuplicatesWithinWatermark(["fingerprint"])


def rates(records: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and failures per window of time."""
    grouped = records.withWatermark(time, late).groupBy(F.window(time, window).alias("span"))
    return grouped.agg(F.count("*").alias("requests"), F.count_if(F.col("error").isNotNull()).alias("failures")).select(F.col("span.start").alias("begins"), F.col("span.end").alias("ends"), "requests", "failures")
