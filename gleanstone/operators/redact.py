"""Replacing personal data by tokens that are stable within a run, and the guard before writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.config import NAME_ALLOWLIST
from gleanstone.errors import LeakError
from gleanstone.functions import pii
from gleanstone.schema import TEXTS
from gleanstone.session import attach, materialize, numbered


def record_spans(records: DataFrame, order: str = "line_no", fields: tuple[str, ...] = TEXTS, allowlist: tuple[str, ...] = NAME_ALLOWLIST, classes: tuple[str, ...] = pii.CLASSES) -> DataFrame:
    """(order, field, field_ord, start, stop, pii_class, value, canonical) of all texts of records.

    The criteria of verdicts come first, in their order, then the text fields.
    """
    texts = [F.struct(F.lit(f).alias("field"), F.lit(1000 + i).alias("field_ord"), F.col(f).alias("text")) for i, f in enumerate(fields)]
    each = F.array(*texts)
    if "judge_verdicts" in records.columns:
        criteria = F.transform(F.coalesce("judge_verdicts", F.array().cast("array<struct<criterion:string,passed:boolean>>")), lambda v, i: F.struct(F.concat(F.lit("criterion:"), i.cast("string")).alias("field"), i.alias("field_ord"), v["criterion"].alias("text")))
        each = F.concat(criteria, each)
    rows = records.select(F.col(order).alias("row"), F.inline(each)).where("text is not null")
    rows = rows.withColumn("spans", pii.find_spans(F.col("text"), allowlist, classes))
    out = rows.select("row", "field", "field_ord", F.inline("spans"))
    return out.withColumn("canonical", pii.canonical(F.col("pii_class"), F.col("value")))


def numbered_tokens(spans: DataFrame) -> DataFrame:
    """(pii_class, canonical, token): the index of a value is its place of first appearance within its class.

    Only distinct values are ranked, range by range.
    """
    first = spans.groupBy("pii_class", "canonical").agg(F.min(F.struct("row", "field_ord", "start")).alias("first"))
    placed = numbered(first, [F.asc("first")], ["pii_class"], "index")
    return placed.select("pii_class", "canonical", F.format_string("[%s_%d]", "pii_class", "index").alias("token"))


def redact(records: DataFrame, order: str = "line_no", fields: tuple[str, ...] = TEXTS, allowlist: tuple[str, ...] = NAME_ALLOWLIST, classes: tuple[str, ...] = pii.CLASSES) -> tuple[DataFrame, DataFrame]:
    """(records with tokens in place of personal data, report by class).

    The report has spans and distinct values per class. Records without spans pass unchanged.
    """
    spans = materialize(record_spans(records, order, fields, allowlist, classes))
    tokens = materialize(numbered_tokens(spans))
    placed = attach(spans, tokens, ["pii_class", "canonical"], "inner")
    per_text = placed.groupBy("row", "field").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "token"))).alias("spans"))
    per_row = per_text.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("field", "spans"))).alias("_spans"))
    joined = records.join(per_row.withColumnRenamed("row", order), order, "left")
    out = joined
    for f in fields:
        here = F.try_element_at("_spans", F.lit(f))
        out = out.withColumn(f, F.when(here.isNotNull() & F.col(f).isNotNull(), pii.replaced(F.col(f), here)).otherwise(F.col(f)))
    if "judge_verdicts" in records.columns:
        def criterion(v, i):  # noqa: ANN001, ANN202
            here = F.try_element_at(F.col("_spans"), F.concat(F.lit("criterion:"), i.cast("string")))
            return F.struct(F.when(here.isNotNull(), pii.replaced(v["criterion"], here)).otherwise(v["criterion"]).alias("criterion"), v["passed"].alias("passed"))

        out = out.withColumn("judge_verdicts", F.transform("judge_verdicts", criterion))
    report = spans.groupBy("pii_class").agg(F.count("*").alias("found"), F.count_distinct("canonical").alias("distinct_values"))
    return out.drop("_spans"), report


def leaks(records: DataFrame, fields: tuple[str, ...] = TEXTS) -> DataFrame:
    """(field, pii_class, texts) of structural classes still in the texts."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    rows = records.select(F.inline(each)).where("text is not null")
    return rows.select("field", F.explode(pii.leaked(F.col("text"))).alias("pii_class")).groupBy("field", "pii_class").agg(F.count("*").alias("texts"))


def guard(records: DataFrame, fields: tuple[str, ...] = TEXTS) -> None:
    """Refuses the whole batch if a structural class is left; the message names class and field, never a value."""
    found = leaks(records, fields).orderBy("field", "pii_class").collect()  # at most fields x classes rows
    if found:
        raise LeakError("; ".join(f"{r['pii_class']} in {r['field']} of {r['texts']} records" for r in found))


def redact_text(spark, text: str, allowlist: tuple[str, ...] = NAME_ALLOWLIST) -> str:  # noqa: ANN001
    """A preview of one text; nothing is written."""
    one = spark.createDataFrame([(1, text)], "line_no int, input_text string")
    return redact(one, fields=("input_text",), allowlist=allowlist)[0].first()["input_text"]
