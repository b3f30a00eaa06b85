"""Reading source files line by line: each line is a payload, a failure or blank.

A line's number needs the order of the file, which rows of a DataFrame don't have. Spark keeps
the order within a partition and the partitions of one file in order: a first pass counts the
lines of each partition, and prefix sums of these few numbers (one per partition) make
local numbers global.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.errors import SourceError
from gleanstone.functions.extract import is_one_json, with_last_names
from gleanstone.functions.text import SPACE, first_of
from gleanstone.operators.rejects import WELL_QUOTED, _csv_cells
from gleanstone.session import running

READ_LINE = "line_no bigint, payload variant, is_blank boolean, error_type string, detail string"


def numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, value) of one text file."""
    if "://" not in path and not Path(path).is_file():
        raise SourceError(f"no file at {path}")
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_id"))
    split = raw.withColumn("_part", F.shiftright("_id", 33)).withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition of one file.
    sizes = split.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return split.join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_local") + 1).alias("line_no"), "value")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one file of JSON."""
    return parse_jsonl(numbered_text(spark, path))


def parse_jsonl(lines: DataFrame, *keep: str) -> DataFrame:
    """(line_no, ``keep``, payload, is_blank, error_type, detail) of lines (line_no, value) of JSON.

    A byte order mark is stripped; what isn't exactly one object is a failure that tells no content.
    An object that repeats a name has the last of its values.
    """
    text = F.regexp_replace(F.regexp_replace("value", r"^\x{FEFF}", ""), f"^{SPACE}+|{SPACE}+$", "")
    lines = lines.withColumn("_text", text)
    one = F.coalesce(is_one_json(F.col("_text")), F.lit(False))
    lines = lines.withColumn("_v", F.when(one, F.try_parse_json("_text")).when(F.col("_text") != "", with_last_names(F.col("_text"))))
    single = F.col("_v").isNotNull()
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    detail = first_of((F.col("_text") == "", None), (~single, "not one JSON value"), (~is_object, "not an object"))
    lines = lines.withColumn("detail", detail)
    fine = (F.col("_text") != "") & F.col("detail").isNull()
    return lines.select("line_no", *keep, F.when(fine, F.col("_v")).alias("payload"), (F.col("_text") == "").alias("is_blank"), F.when(F.col("detail").isNotNull(), F.lit("line_parse")).alias("error_type"), "detail")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).select(_csv_cells(F.regexp_replace("value", r"^\x{FEFF}", "")).alias("cells")).first()
    names = [c.strip() for c in first["cells"]] if first else []
    if not names or any(not n for n in names):
        raise SourceError(f"{path}: the header has blank names")
    if len(set(names)) < len(names):
        raise SourceError(f"{path}: the header repeats names")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with header; cells stay strings, missing ones at the end are null, surplus ones a failure.

    A row's number is that of its last line, the header being 0; quoted cells may span lines:
    a line that leaves a quote open is joined with those that follow until it closes.
    """
    names = csv_header(spark, path)
    lines = numbered_text(spark, path)
    quotes = F.length(F.regexp_replace("value", '[^"]', ""))
    # A running count of quotes tells which lines belong to one record; running sums go over the file range by range.
    lines = running(lines.withColumn("_quotes", quotes), [], "line_no", "_quotes", "_upto")
    starts = ((F.col("_upto") - F.col("_quotes")) % 2 == 0).cast("int")
    lines = running(lines.select("line_no", "value", starts.alias("_start")), [], "line_no", "_start", "_record")
    grouped = lines.groupBy("_record").agg(F.max("line_no").alias("last"), F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    rows = grouped.select((F.col("last") - 1).alias("line_no"), text.alias("_text")).where("line_no > 0 or _text is null").where(F.col("line_no") > 0)
    rows = rows.withColumn("_cells", F.when(F.col("_text").rlike(WELL_QUOTED), _csv_cells(F.col("_text"))))
    blank = F.regexp_replace("_text", SPACE, "") == ""
    detail = first_of((blank, None), (F.col("_cells").isNull(), "broken quoting"), (F.size("_cells") > len(names), "more cells than the header"))
    rows = rows.withColumn("detail", detail)
    pairs = F.struct(*[F.get("_cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    fine = ~blank & F.col("detail").isNull()
    payload = F.try_parse_json(F.to_json(pairs, {"ignoreNullFields": "false"}))
    return rows.select("line_no", F.when(fine, payload).alias("payload"), blank.alias("is_blank"), F.when(F.col("detail").isNotNull(), F.lit("line_parse")).alias("error_type"), "detail")


def read_source(spark: SparkSession, path: str, source_format: str) -> DataFrame:
    readers = {"jsonl": read_jsonl, "csv": read_csv}
    if source_format not in readers:
        raise SourceError(f"unknown format {source_format!r}")
    return readers[source_format](spark, path)
