"""Exact duplicates by fingerprint of the normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.functions.text import fingerprint


def first_per_fingerprint(records: DataFrame, text: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The first row, in ``order``, of each fingerprint that ``existing`` (column ``fingerprint``) lacks.

    The first is found as a minimum, which is combined before the shuffle, so a text with a third
    of all rows is no burden; its row is then looked up by the order columns, which must be unique.
    """
    keyed = records.withColumn("fingerprint", fingerprint(F.col(text)))
    if existing is not None:
        keyed = keyed.join(existing.select("fingerprint").distinct(), "fingerprint", "left_anti")
    firsts = keyed.groupBy("fingerprint").agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return keyed.join(firsts, order, "left_semi").drop("fingerprint")


def distinct_inputs(records: DataFrame, text: str = "input_text") -> DataFrame:
    return records.agg(F.count_distinct(fingerprint(F.col(text))).alias("distinct_inputs"))


def duplicate_histogram(records: DataFrame, text: str = "input_text") -> DataFrame:
    """How many fingerprints have how many rows."""
    sizes = records.groupBy(fingerprint(F.col(text)).alias("fingerprint")).agg(F.count("*").alias("copies"))
    return sizes.groupBy("copies").agg(F.count("*").alias("texts"))


def already_ingested(manifest_sources: DataFrame, sha256: str, path: str) -> bool:
    return bool(manifest_sources.where((F.col("path") == path) & (F.col("sha256") == sha256)).limit(1).count())
