"""Queries of the general training-data problems; those of language-model data are in ``gleanstone.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanstone.operators import rejects, timestamps
from gleanstone.plans.problems_sql import ORACLES  # noqa: F401
from gleanstone.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda name: table(spark, sf_dir, name)
    sources = [
        ("records", at("records"), "record_id", "ts_utc"),
        ("support_tickets", at("support_tickets"), "ticket_id", "opened_at"),
        ("judged_summaries", at("judged_summaries"), "request_id", "ts_utc"),
    ]
    return timestamps.untidy_instants(sources, at("field_mappings"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected_lines(table(spark, sf_dir, "raw_lines"))


def p7_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.line_accounts(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "ingest_counts"))


QUERIES = {"p3_found": p3_found, "p7_found": p7_found, "p7_accounts": p7_accounts}
