"""Queries for the engine's own operators on the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.config import NEGATIVE_WORDS, POSITIVE_WORDS, Cluster, Health, Select
from gleanstone.functions import coerce, pii, stats
from gleanstone.functions.extract import at_path
from gleanstone.operators import cluster, dedupe, drift, emit, health, label, redact, select, signals, similarity
from gleanstone.plans.reference_sql import ORACLES  # noqa: F401
from gleanstone.schema import record_fault
from gleanstone.session import materialize, once, table

#: The near-duplicate stages on documents take five words and a similarity of 0.8.
NEAR = Cluster(shingle_words=5, jaccard_threshold=0.8)
GOLDEN_SOURCE = "golden_drafts"


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records once each: rows delivered twice are one."""
    return table(spark, d, "records").dropDuplicates(["record_id"])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "documents").where("text is not null"), "doc_id")


def record_faults(spark, d):  # noqa: ANN001, ANN201
    rows = _records(spark, d).select("record_id", record_fault().alias("fault"))
    return rows.groupBy(F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count("*").alias("records"))


def fingerprint_dedupe(spark, d):  # noqa: ANN001, ANN201
    return dedupe.first_per_fingerprint(_records(spark, d), "input_text", ["received_at", "record_id"]).select("record_id")


def duplicate_histogram(spark, d):  # noqa: ANN001, ANN201
    return dedupe.duplicate_histogram(_records(spark, d))


def distinct_inputs(spark, d):  # noqa: ANN001, ANN201
    return dedupe.distinct_inputs(_records(spark, d))


def percentile_context(spark, d):  # noqa: ANN001, ANN201
    return signals.window_context(_records(spark, d), by=["window_id"])


def version_disagreement(spark, d):  # noqa: ANN001, ANN201
    return signals.disagreements(_records(spark, d))


def scored(spark, d):  # noqa: ANN001, ANN201
    out = signals.score_records(_records(spark, d), by=["window_id"])
    return out.select("window_id", "record_id", "score", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("fired"))


def signal_histogram(spark, d):  # noqa: ANN001, ANN201
    return signals.signal_histogram(signals.score_records(_records(spark, d), by=["window_id"]))


def _ranked(spark, d):  # noqa: ANN001, ANN201
    """Scores as delivered, with stratum and cluster; one row per record."""
    scores = table(spark, d, "scores").where("score is not null").dropDuplicates(["record_id"])
    clusters = table(spark, d, "candidates").where("cluster_id is not null").groupBy("record_id").agg(F.min("cluster_id").alias("cluster_id"))
    return scores.join(clusters, "record_id").select("record_id", "score", signals.stratum(F.col("signals")).alias("stratum"), "cluster_id")


def strata_of_scores(spark, d):  # noqa: ANN001, ANN201
    return _ranked(spark, d).select("record_id", "stratum")


def quota_topk(spark, d):  # noqa: ANN001, ANN201
    return select.quota_topk(_ranked(spark, d)).select("stratum", "record_id", "place")


def cluster_topk(spark, d):  # noqa: ANN001, ANN201
    return select.cluster_topk(_ranked(spark, d)).select("cluster_id", "record_id")


def greedy(spark, d):  # noqa: ANN001, ANN201
    return select.greedy_select(_ranked(spark, d), Select())


def greedy_strata(spark, d):  # noqa: ANN001, ANN201
    rows = _ranked(spark, d)
    return select.stratum_accounts(select.greedy_select(rows), rows)


def orphan_scores(spark, d):  # noqa: ANN001, ANN201
    return select.orphans(table(spark, d, "scores"), table(spark, d, "candidates"))


def error_rates(spark, d):  # noqa: ANN001, ANN201
    """Rates of every window against the next one's."""
    hits = {"error": F.col("error").isNotNull(), "negative_feedback": F.lower(F.trim("feedback")).isin(*NEGATIVE_WORDS)}
    out = drift.rate_shifts(_records(spark, d), "window_id", hits)
    rounded = [F.round(c, 6).alias(c) for c in ("rate_a", "rate_b", "low_a", "high_a", "low_b", "high_b", "delta")]
    return out.select("earlier", "later", "measure", "n_a", "hits_a", "n_b", "hits_b", *rounded, "separated")


def latency_shift(spark, d):  # noqa: ANN001, ANN201
    """Latencies of every window against the next one's."""
    out = drift.value_shifts(_records(spark, d), "window_id", "latency_ms")
    return out.select("earlier", "later", F.round("ks", 6).alias("ks"), "n_first", "n_second", "median_a", "median_b")


def length_shift(spark, d):  # noqa: ANN001, ANN201
    """The earliest window's request lengths against the latest one's."""
    rows = _records(spark, d).withColumn("chars", F.length("input_text"))
    ends = rows.agg(F.min("window_id").alias("a"), F.max("window_id").alias("b")).first()
    out = drift.input_length_shift(rows, "window_id", ends["a"], ends["b"], "chars")
    return out.select(F.round("ks", 6).alias("ks"), "n_first", "n_second", "median_a", "median_b")


def coerced_counts(spark, d):  # noqa: ANN001, ANN201
    """Durations of tickets, flat strings, as whole numbers."""
    t = table(spark, d, "support_tickets").dropDuplicates(["ticket_id"])
    value = F.try_variant_get(F.try_parse_json(F.to_json(F.struct("duration_ms"))), "$.duration_ms", "variant")
    n, ok = coerce.integer(value)
    return t.select("ticket_id", n.alias("duration"), ok.alias("ok"))


def event_paths(spark, d):  # noqa: ANN001, ANN201
    n, _ = coerce.integer(at_path(F.try_parse_json("props"), "k"))
    return table(spark, d, "events").select("event_id", n.alias("k"))


def epochs(spark, d):  # noqa: ANN001, ANN201
    """Epochs of events in seconds and milliseconds come back to one form."""
    seconds = F.unix_timestamp("ts")
    make = lambda c: coerce.timestamp(F.try_parse_json(c.cast("string")))[0]
    return table(spark, d, "events").select("event_id", make(seconds).alias("from_seconds"), make(seconds * 1000).alias("from_millis"))


def slugs(spark, d):  # noqa: ANN001, ANN201
    return _records(spark, d).select("record_id", emit.case_id(F.col("window_id"), F.col("record_id")).alias("case_id"))


def truncations(spark, d):  # noqa: ANN001, ANN201
    return _docs(spark, d).select("doc_id", coerce.truncated(F.col("text"), 200).alias("cut"))


def shingle_stats(spark, d):  # noqa: ANN001, ANN201
    return similarity.shingle_sizes(similarity.shingles(_docs(spark, d), "doc_id", "text"), "doc_id")


def near_duplicates(spark, d):  # noqa: ANN001, ANN201
    return cluster.classes(_docs(spark, d), NEAR)


def clusters(spark, d):  # noqa: ANN001, ANN201
    out = cluster.cluster_records(_docs(spark, d), None, NEAR, "doc_id", "text", exact=True)
    return out.select("cluster_id", "representative_id", "size", F.round("min_link_jaccard", 6).alias("min_link_jaccard"))


def _overlaps(spark, d):  # noqa: ANN001, ANN202
    docs = _docs(spark, d)
    golden = docs.where(F.col("source") == GOLDEN_SOURCE)
    traffic = docs.where(F.coalesce(F.col("source") != GOLDEN_SOURCE, F.lit(True)))
    return similarity.shingle_hashes(traffic, "doc_id", "text"), materialize(similarity.shingle_hashes(golden.withColumnRenamed("doc_id", "golden_id"), "golden_id", "text"))


def best_overlap(spark, d):  # noqa: ANN001, ANN201
    traffic, golden = _overlaps(spark, d)
    return similarity.best_overlap(traffic, golden, "doc_id", "golden_id").select("doc_id", F.round("best_overlap", 6).alias("best_overlap"))


def stale_goldens(spark, d):  # noqa: ANN001, ANN201
    traffic, golden = _overlaps(spark, d)
    return health.staleness(golden, traffic, "golden_id", "doc_id", Health(neighbour_jaccard=0.2)).select("golden_id", F.round("best_overlap", 6).alias("best_overlap"))


def redundant_goldens(spark, d):  # noqa: ANN001, ANN201
    golden = _overlaps(spark, d)[1]
    return health.redundancy(golden, "golden_id", Health(neighbour_jaccard=0.05)).select("golden_id", "other", F.round("jaccard", 6).alias("jaccard"))


def golden_coverage(spark, d):  # noqa: ANN001, ANN201
    """Share of near-duplicate classes of documents with a member that overlaps a golden draft."""
    traffic, golden = _overlaps(spark, d)
    members = cluster.classes(_docs(spark, d).where(F.coalesce(F.col("source") != GOLDEN_SOURCE, F.lit(True))), NEAR).select("doc_id", F.col("class_id").alias("component"))
    covered = health.covered_records(similarity.best_overlap(traffic, golden, "doc_id", "golden_id"), Health(neighbour_jaccard=0.2))
    out = health.coverage(covered, members, "doc_id")
    return out.select("clusters", "covered_clusters", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


def email_spans(spark, d):  # noqa: ANN001, ANN201
    spans = pii.matches(F.col("input_text"), pii.EMAIL, "EMAIL")
    return _records(spark, d).select("record_id", F.size(spans).alias("emails"), F.coalesce(F.try_element_at(spans, F.lit(1))["start"], F.lit(-1)).alias("first_at")).where("emails > 0")


def pii_counts(spark, d):  # noqa: ANN001, ANN201
    r = _records(spark, d).select(F.col("record_id").alias("line_no"), *redact.TEXTS)
    return redact.record_spans(r).groupBy("field", "pii_class").agg(F.count("*").alias("spans"), F.count_distinct("canonical").alias("distinct_values"))


def redacted(spark, d):  # noqa: ANN001, ANN201
    r = _records(spark, d).select(F.col("record_id").alias("line_no"), *redact.TEXTS)
    return redact.redact(r)[0].withColumnRenamed("line_no", "record_id")


def dry_run_cases(spark, d):  # noqa: ANN001, ANN201
    """The shortlist's cases with placeholder criteria."""
    rows = _ranked(spark, d)
    chosen = select.greedy_select(rows)
    texts = _records(spark, d).select("record_id", "input_text", "output_text", "judge_verdicts")
    listed = chosen.where("rank is not null").join(rows, "record_id").join(texts, "record_id").withColumn("reasons", F.array("stratum"))
    listed = materialize(listed)
    return emit.cases(listed, label.label_candidates(listed), "win").select("rank", "id", F.size("criteria").alias("criteria"), F.array_join("tags", ",").alias("tags"))


def spread_by_sign(spark, d):  # noqa: ANN001, ANN201
    """Whether failing calls have fewer positive ratings: counts and a one-sided exact p."""
    ok = F.lower(F.trim("feedback")).isin(*POSITIVE_WORDS)
    r = _records(spark, d).where("feedback is not null")
    t = r.agg(F.count_if(F.col("error").isNotNull() & ok).alias("a"), F.count_if(F.col("error").isNotNull() & ~ok).alias("b"), F.count_if(F.col("error").isNull() & ok).alias("c"), F.count_if(F.col("error").isNull() & ~ok).alias("e")).first()
    p = stats.fisher_lower(t["a"], t["b"], t["c"], t["e"])
    return spark.createDataFrame([(t["a"], t["b"], t["c"], t["e"], p)], "failed_positive bigint, failed_other bigint, fine_positive bigint, fine_other bigint, p double").withColumn("p", F.round("p", 6))


QUERIES = {
    "q_record_faults": record_faults, "q_fingerprint_dedupe": fingerprint_dedupe, "q_duplicate_histogram": duplicate_histogram, "q_distinct_inputs": distinct_inputs,
    "q_percentile_context": percentile_context, "q_version_disagreement": version_disagreement, "q_scored": scored, "q_signal_histogram": signal_histogram,
    "q_strata_of_scores": strata_of_scores, "q_quota_topk": quota_topk, "q_cluster_topk": cluster_topk, "q_greedy_select": greedy, "q_greedy_strata": greedy_strata,
    "q_orphan_scores": orphan_scores, "q_error_rates": error_rates, "q_latency_shift": latency_shift, "q_length_shift": length_shift, "q_coerced_counts": coerced_counts, "q_event_paths": event_paths,
    "q_epochs": epochs, "q_case_ids": slugs, "q_truncations": truncations, "q_shingle_stats": shingle_stats,
    "q_near_duplicates": near_duplicates, "q_clusters": clusters, "q_best_overlap": best_overlap, "q_stale_goldens": stale_goldens, "q_redundant_goldens": redundant_goldens,
    "q_golden_coverage": golden_coverage, "q_email_spans": email_spans, "q_pii_counts": pii_counts, "q_redacted": redacted, "q_dry_run_cases": dry_run_cases, "q_fisher": spread_by_sign,
}
