"""From source lines to canonical records, with every line accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.config import Config
from gleanstone.functions import coerce
from gleanstone.functions.extract import extract
from gleanstone.functions.text import first_of
from gleanstone.operators import dedupe
from gleanstone.schema import COUNTS, FIELDS, VERDICTS, record_fault
from gleanstone.session import attach, where_computed
from gleanstone.sources.mapping import REQUIRED, FieldMapping


def _coerced(name: str, value: Column, mapping: FieldMapping) -> coerce.Coerced:
    if name in COUNTS:
        return coerce.integer(value)
    if name == "ts_utc":
        return coerce.timestamp(value, mapping.naive_is_utc)
    if name == "judge_verdicts":
        spec = mapping.fields.get(name)
        return coerce.verdicts(value, spec.criterion_key, spec.passed_key) if spec else coerce.verdicts(value)
    return coerce.text(value, numbers=name == "record_id")


def build_records(lines: DataFrame, mapping: FieldMapping, sidecar: DataFrame | None = None, max_text_chars: int = 20_000) -> DataFrame:
    """Lines with the fields of a record and, where one can't be built, the first failure.

    Order: sidecar, mapped fields, defaults, required fields, truncation of input and output,
    invariants. ``error_type`` is line_parse, sidecar_miss, missing_field, field_type or
    invalid_record; ``detail`` names the field, never its value. Blank lines have neither.
    """
    df, faults = lines, []
    if mapping.sidecar:
        digest = coerce.text(extract(F.col("payload"), mapping.sidecar.key_field))[0]
        side = sidecar.select(F.col("text_sha256").alias("_digest"), F.col("text").alias("_side"))
        df = attach(df.withColumn("_digest", digest), side, ["_digest"])
        faults.append((F.col("payload").isNotNull() & F.col("_side").isNull(), "sidecar_miss", mapping.sidecar.target))
    raw = {}
    for name in FIELDS:
        spec, default = mapping.fields.get(name), mapping.defaults.get(name)
        value = extract(F.col("payload"), spec.path, spec.extractor) if spec else F.lit(None).cast("variant")
        if default is not None:
            import json

            value = F.when(coerce.absent(value), F.parse_json(F.lit(json.dumps(default)))).otherwise(value)
        raw[f"_{name}"] = value
    df = df.withColumns(raw)
    values, fine = {}, {}
    for name in FIELDS:
        value, ok = _coerced(name, F.col(f"_{name}"), mapping)
        if mapping.sidecar and name == mapping.sidecar.target:
            value, ok = F.col("_side"), F.lit(True)
        gone = coerce.absent(F.col(f"_{name}")) if not (mapping.sidecar and name == mapping.sidecar.target) else F.lit(False)
        if name != "judge_verdicts":
            value = F.when(~gone, value)
        values[name], fine[f"_ok_{name}"] = value, ok
    df = df.withColumns(fine).withColumns(values)
    faults += [(F.col(name).isNull() & F.col(f"_ok_{name}"), "missing_field", name) for name in REQUIRED]
    faults += [(~F.col(f"_ok_{name}"), "field_type", name) for name in FIELDS]
    cut = {n: coerce.truncated(F.col(n), max_text_chars) for n in ("input_text", "output_text")}
    was_cut = F.coalesce(F.length("input_text") > max_text_chars, F.lit(False)).cast("int") + F.coalesce(F.length("output_text") > max_text_chars, F.lit(False)).cast("int")
    df = df.withColumn("truncated_texts", was_cut).withColumns(cut)
    df = df.withColumn("judge_verdicts", F.coalesce("judge_verdicts", F.array().cast(VERDICTS)))
    df = df.withColumn("_fault", record_fault())
    there = F.col("payload").isNotNull()
    kind = first_of((F.col("is_blank") | ~there, F.col("error_type")), *[(c, k) for c, k, _ in faults], (F.col("_fault").isNotNull(), "invalid_record"))
    what = first_of((F.col("is_blank") | ~there, F.col("detail")), *[(c, f) for c, _, f in faults], otherwise=F.col("_fault"))
    df = df.withColumns({"_kind": kind, "_what": what})
    return df.select("line_no", "is_blank", F.col("_kind").alias("error_type"), F.col("_what").alias("detail"), "truncated_texts", *FIELDS)


def records_of(built: DataFrame) -> DataFrame:
    return where_computed(built, F.col("error_type").isNull() & ~F.col("is_blank"))


def failures_of(built: DataFrame) -> DataFrame:
    """(line_no, error_type, detail) of the lines that became no record."""
    return where_computed(built, F.col("error_type").isNotNull()).select("line_no", "error_type", "detail")


def error_histogram(failures: DataFrame) -> DataFrame:
    return failures.groupBy("error_type").agg(F.count("*").alias("lines"))


def accounts(built: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of counters in which lines = rows + blank + unparsed and rows = written + duplicates + invalid."""
    parse = F.col("error_type") == "line_parse"
    sums = built.agg(
        F.count("*").alias("lines"),
        F.count_if("is_blank").alias("blank"),
        F.count_if(F.coalesce(parse, F.lit(False))).alias("unparsed"),
        F.count_if(F.col("error_type").isNotNull() & ~F.coalesce(parse, F.lit(False))).alias("invalid"),
        F.coalesce(F.sum(F.when(F.col("error_type").isNull() & ~F.col("is_blank"), F.col("truncated_texts"))), F.lit(0)).alias("truncated"),
    )
    out = sums.withColumns({"written": F.lit(kept.count()), "rows": F.col("lines") - F.col("blank") - F.col("unparsed")})
    return out.withColumn("duplicates", F.col("rows") - F.col("invalid") - F.col("written"))


def ingest(lines: DataFrame, mapping: FieldMapping, config: Config | None = None, sidecar: DataFrame | None = None, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, failures, accounts) of one source; ``existing`` holds fingerprints that are written already."""
    config = config or Config()
    built = build_records(lines, mapping, sidecar, config.ingest.max_text_chars)
    records = records_of(built)
    kept = dedupe.first_per_fingerprint(records, "input_text", ["line_no"], existing) if config.dedupe.dedupe else records
    return kept.select("line_no", *FIELDS), failures_of(built), accounts(built, kept)
