"""Queries of the language-model problems."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from gleanstone.llm import bpe, layout_duplicates, offensive, pair_defects, personal_data, quota_sample, source_mix, top_per_group
from gleanstone.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_duplicates.copies(table(spark, sf_dir, "records"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_duplicates.collapsed(table(spark, sf_dir, "records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_per_group.top_n(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "scores"))
    return best.select("cluster_id", "record_id")


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_per_group.top_n(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "scores"))
    return best.withColumnRenamed("rank", "place")


def _quota(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "strata"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(quota_sample.short_strata, spark, sf_dir)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(quota_sample.sample, spark, sf_dir)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(quota_sample.report, spark, sf_dir)


def p4_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(quota_sample.margins, spark, sf_dir)


def _personal(query, spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    allowed = personal_data.allow_list(table(spark, sf_dir, "name_allowlist"))
    # Who wants the same replacements in another run names a key; otherwise each run has its own.
    key = spark.conf.get("spark.gleanstone.key", None) or secrets.token_hex(32)
    return query(table(spark, sf_dir, "records"), key, allowed, **options)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(personal_data.occurrences, spark, sf_dir).select("record_id", "field_name", "pii_class", "start_pos")


def p5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(personal_data.occurrences, spark, sf_dir)


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(personal_data.redacted, spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf_dir, "records"))


def p6_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.tag_pairs(table(spark, sf_dir, "records"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def _offensive(query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offensive(offensive.found, spark, sf_dir)


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offensive(offensive.scores, spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offensive(offensive.rates, spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_ranked": p2_ranked, "p4_found": p4_found, "p4_sample": p4_sample, "p4_report": p4_report, "p4_margins": p4_margins, "p5_found": p5_found, "p5_surrogates": p5_surrogates, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_tagged": p6_tagged, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}

_TOP = """
    WITH s AS (SELECT record_id, max(score) AS score FROM scores WHERE score IS NOT NULL GROUP BY record_id),
         m AS (SELECT DISTINCT cluster_id, record_id FROM candidates WHERE cluster_id IS NOT NULL),
         r AS (SELECT cluster_id, record_id, score, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, record_id) AS INTEGER) AS place FROM m JOIN s USING (record_id))
"""
_SHORT = """
    SELECT s.window_id, s.stratum FROM strata s LEFT JOIN (
        SELECT window_id, lower(trim(stratum)) AS name, count(DISTINCT record_id) AS n FROM candidates WHERE stratum IS NOT NULL GROUP BY ALL
    ) c ON c.window_id = s.window_id AND c.name = lower(trim(s.stratum)) WHERE s.quota > coalesce(c.n, 0)
"""
_REPORT = """
    WITH c AS (SELECT window_id, lower(trim(stratum)) AS name, count(DISTINCT record_id) AS available FROM candidates WHERE stratum IS NOT NULL GROUP BY ALL),
         s AS (SELECT window_id, lower(trim(stratum)) AS name, max(stratum) AS stratum, max(target_share) AS target_share, max(min_rows) AS min_rows, max(quota) AS quota FROM strata GROUP BY ALL),
         w AS (SELECT s.*, greatest(quota, coalesce(min_rows, 0), 0) AS wanted, coalesce(available, 0) AS available FROM s LEFT JOIN c USING (window_id, name)),
         t AS (SELECT *, least(wanted, available) AS selected FROM w)
    SELECT window_id, stratum, target_share, min_rows, quota, wanted, available, selected, selected - least(greatest(quota, 0), available) AS repaired,
        coalesce(round(selected / nullif(sum(selected) OVER (PARTITION BY window_id), 0), 6), 0) AS reached_share, wanted - selected AS gap, selected >= coalesce(min_rows, 0) AS floor_met FROM t
"""
ORACLES = {
    "p4_found": _SHORT,
    "p4_report": _REPORT,
    "p2_found": _TOP + "SELECT cluster_id, record_id FROM r WHERE place <= 3",
    "p2_ranked": _TOP + "SELECT cluster_id, record_id, score, place FROM r WHERE place <= 3",
}
