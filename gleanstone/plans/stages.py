"""Queries of ingestion, privacy, selection, health and drift on the driver's tables; their SQL twins are in ``stages_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.config import POSITIVE_WORDS, Drift, Health
from gleanstone.functions import pii
from gleanstone.functions.text import fingerprint
from gleanstone.operators import dedupe, drift, emit, health, ingest, label, redact, select, signals, similarity
from gleanstone.plans.reference import GOLDEN_SOURCE, NEAR, _docs, _ranked, _records
from gleanstone.plans.stages_sql import ORACLES  # noqa: F401
from gleanstone.schema import TEXTS
from gleanstone.session import materialize, table
from gleanstone.sources import lines, mapping

TICKETS = mapping.parse("""
schema_version = 1
source_format = "csv"
[timestamp]
naive_is_utc = true
[defaults]
arm = "none"
[fields]
record_id = { path = "ticket_id" }
ts_utc = { path = "opened_at" }
input_text = { path = "question" }
output_text = { path = "answer" }
arm = { path = "variant" }
latency_ms = { path = "duration_ms" }
feedback = { path = "rating" }
""")
JUDGED = mapping.parse("""
schema_version = 1
source_format = "jsonl"
[fields]
record_id = { path = "request_id" }
ts_utc = { path = "ts_utc" }
input_text = { path = "question" }
output_text = { path = "answer" }
prompt_version = { path = "prompt_label" }
error = { path = "error_type" }
latency_ms = { path = "latency_ms" }
judge_verdicts = { path = "verdicts", criterion_key = "criterion", passed_key = "ok" }
""")
KEPT_APART = mapping.parse("""
schema_version = 1
source_format = "jsonl"
[defaults]
output_text = "kept"
[sidecar]
target = "input_text"
key_field = "digest"
[fields]
record_id = { path = "id" }
ts_utc = { path = "at" }
""")
CHATS = mapping.parse("""
schema_version = 1
source_format = "jsonl"
[fields]
record_id = { path = "id" }
ts_utc = { path = "created" }
input_text = { path = "messages", extractor = "openai_last_user_message" }
output_text = { path = "messages", extractor = "openai_assistant_message" }
prompt_version = { path = "tags.-1" }
arm = { path = "parts", extractor = "join_text" }
feedback = { path = "rated.by.0" }
""")


def _payload(rows: DataFrame, key: str) -> DataFrame:
    """Rows as if read: one object each, in the order of their key."""
    body = F.try_parse_json(F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"}))
    return rows.select(F.col(key).alias("line_no"), body.alias("payload"), F.lit(False).alias("is_blank"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("detail"))


def _tickets(spark: SparkSession, d: str) -> DataFrame:
    return ingest.build_records(_payload(table(spark, d, "support_tickets").dropDuplicates(["ticket_id"]).drop("mapping_name"), "ticket_id"), TICKETS)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return ingest.build_records(_payload(table(spark, d, "judged_summaries").dropDuplicates(["request_id"]).drop("mapping_name"), "request_id"), JUDGED)


def ticket_records(spark, d):  # noqa: ANN001, ANN201
    """Tickets through the mapping: every row a record, or the first fault."""
    return _tickets(spark, d).select("line_no", "error_type", "detail", *[F.when(F.col("error_type").isNull(), F.col(c)).alias(c) for c in ("record_id", "ts_utc", "input_text", "output_text", "arm", "latency_ms", "feedback")])


def judged_records(spark, d):  # noqa: ANN001, ANN201
    """Judged summaries through the mapping, verdicts from objects with other keys."""
    said = F.array_join(F.transform("judge_verdicts", lambda v: F.concat_ws("=", v["criterion"], v["passed"].cast("string"))), "; ")
    return _judged(spark, d).select("line_no", "error_type", "detail", F.when(F.col("error_type").isNull(), said).alias("verdicts"), F.when(F.col("error_type").isNull(), F.col("ts_utc")).alias("ts_utc"))


def ingest_accounts(spark, d):  # noqa: ANN001, ANN201
    """The counters of a run over the tickets, exact copies dropped."""
    built = materialize(_tickets(spark, d))
    kept = dedupe.first_per_fingerprint(ingest.records_of(built), "input_text", ["line_no"])
    return ingest.accounts(built, kept).withColumn("written", F.col("written").cast("bigint"))


def ingest_faults(spark, d):  # noqa: ANN001, ANN201
    return ingest.error_histogram(ingest.failures_of(_tickets(spark, d).unionByName(_judged(spark, d))))


def jsonl_lines(spark, d):  # noqa: ANN001, ANN201
    """Raw lines of the JSON exports: blank, unparsed and object lines of each source."""
    raw = table(spark, d, "raw_lines").where("source_format = 'jsonl'").select("source_path", "line_no", F.col("line").alias("value"))
    out = lines.parse_jsonl(raw, "source_path")
    return out.groupBy("source_path").agg(F.count("*").alias("lines"), F.count_if("is_blank").alias("blank"), F.count_if(F.col("error_type").isNotNull()).alias("unparsed"), F.count_if(F.col("payload").isNotNull()).alias("objects"))


def sidecar_records(spark, d):  # noqa: ANN001, ANN201
    """Rows that keep only a digest of their text meet the texts of a sidecar that lacks every tenth of them."""
    r = _records(spark, d)
    side = r.select("input_text").distinct().select(F.sha2("input_text", 256).alias("text_sha256"), F.col("input_text").alias("text")).where(F.substring("text_sha256", 1, 1) != "0")
    rows = r.select(F.col("record_id").alias("id"), F.lit("2026-01-05T10:00:00Z").alias("at"), F.sha2("input_text", 256).alias("digest"))
    out = ingest.build_records(_payload(rows, "id"), KEPT_APART, side)
    return out.select("line_no", "error_type", "detail", F.when(F.col("error_type").isNull(), F.length("input_text")).alias("n"))


def chat_records(spark, d):  # noqa: ANN001, ANN201
    """Conversations made of records: last user message, assistant message in parts, list elements from the end, joined texts."""
    r = _records(spark, d).where("input_text is not null")
    said = lambda role, content: F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")))
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit("first").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("none").alias("text")), F.struct(F.lit("text").alias("type"), F.col("record_id").alias("text")))
    messages = F.concat(F.lit("["), said("user", F.lit("earlier")), F.lit(","), said("user", F.col("input_text")), F.lit(","), said("assistant", parts), F.lit("]"))
    body = F.concat(
        F.lit('{"id":'), F.to_json(F.struct(F.col("record_id").alias("x"))), F.lit(',"created":'), F.unix_timestamp("received_at").cast("string"), F.lit(',"messages":'), messages,
        F.lit(',"tags":["a",'), F.concat(F.lit('"'), F.coalesce("arm", F.lit("b")), F.lit('"')), F.lit('],"parts":["x",1,"y"],"rated":{"by":["z"]}}'),
    )
    payload = F.try_parse_json(F.regexp_replace(body, r'^\{"id":\{"x":("[^"]*")\}', r'{"id":$1'))
    rows = r.select(F.col("record_id").alias("line_no"), payload.alias("payload"), F.lit(False).alias("is_blank"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("detail"))
    return ingest.build_records(rows, CHATS).select("line_no", "error_type", "ts_utc", F.length("input_text").alias("asked"), "output_text", "prompt_version", "arm", "feedback")


def new_inputs(spark, d):  # noqa: ANN001, ANN201
    """Records of later windows whose text the first window lacks."""
    r = _records(spark, d)
    first = r.agg(F.min("window_id")).first()[0]
    known = r.where(F.col("window_id") == first).select(fingerprint(F.col("input_text")).alias("fingerprint"))
    return dedupe.first_per_fingerprint(r.where(F.col("window_id") != first), "input_text", ["received_at", "record_id"], known).select("window_id", "record_id")


def pii_flags(spark, d):  # noqa: ANN001, ANN201
    """Which classes of personal data a record's request holds, checks applied, before overlaps are resolved."""
    r = _records(spark, d).select("record_id", pii.candidates(F.col("input_text")).alias("spans")).where(F.size("spans") > 0)
    classes = F.transform("spans", lambda s: s["pii_class"])
    return r.select("record_id", *[F.array_contains(classes, c).alias(c.lower()) for c in pii.CLASSES])


def email_redacted(spark, d):  # noqa: ANN001, ANN201
    """Records with numbered tokens in place of e-mail addresses."""
    r = _records(spark, d).select(F.col("record_id").alias("line_no"), *TEXTS)
    out = redact.redact(r, classes=("EMAIL",))[0]
    touched = [F.coalesce(F.contains(F.col(c), F.lit("[EMAIL_")), F.lit(False)) for c in TEXTS]
    return out.where(touched[0] | touched[1] | touched[2] | touched[3]).withColumnRenamed("line_no", "record_id")


def email_report(spark, d):  # noqa: ANN001, ANN201
    r = _records(spark, d).select(F.col("record_id").alias("line_no"), *TEXTS)
    return redact.redact(r, classes=("EMAIL",))[1]


def leaked_classes(spark, d):  # noqa: ANN001, ANN201
    """Texts that the guard would refuse, by field and class; only spaced or dashed numbers, addresses of mail and hosts count."""
    r = _records(spark, d).select("record_id", *TEXTS)
    return redact.leaks(r).where("pii_class = 'EMAIL'")


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Four minima per document from a digest that SQL knows."""
    return similarity.signatures(_docs(spark, d), "doc_id", "text", permutations=4, digest="md5")


def minhash(spark, d):  # noqa: ANN001, ANN201
    return _signed(spark, d).select("doc_id", *[F.get("signature", F.lit(i)).cast("string").alias(f"h{i}") for i in range(4)])


def minhash_estimates(spark, d):  # noqa: ANN001, ANN201
    """Estimated likeness of each document and the next."""
    s = materialize(_signed(spark, d))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("signature").alias("other"))
    return s.join(after, "doc_id").select("doc_id", similarity.estimated_jaccard(F.col("signature"), F.col("other")).alias("estimate"))


def band_pairs(spark, d):  # noqa: ANN001, ANN201
    """Pairs of documents that agree in one of two bands of two rows."""
    return similarity.candidate_pairs(similarity.bands(_signed(spark, d), "doc_id", 2), "doc_id")


def near_duplicate_pairs(spark, d):  # noqa: ANN001, ANN201
    """Verified links between the smallest documents of different texts."""
    links, _ = similarity.near_duplicate_links(_docs(spark, d), "doc_id", "text", NEAR.shingle_words, NEAR.permutations, NEAR.bands, NEAR.seed, NEAR.jaccard_threshold, exact=True)
    return links.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _best_of_records(spark: SparkSession, d: str) -> DataFrame:
    """Best overlap of each request with a golden draft, on shingles of two words.

    Rows delivered twice are met twice and dropped afterwards, so that no text is shuffled.
    """
    golden = _docs(spark, d).where(F.col("source") == GOLDEN_SOURCE)
    requests = similarity.shingle_hashes(table(spark, d, "records"), "record_id", "input_text", 2)
    return similarity.best_overlap(requests, similarity.shingle_hashes(golden, "doc_id", "text", 2), "record_id", "doc_id").dropDuplicates(["record_id"])


def scored_with_goldens(spark, d):  # noqa: ANN001, ANN201
    """All thirteen signals: JSON expected, golden drafts given."""
    out = signals.score_records(_records(spark, d), by=["window_id"], expect_json=True, overlaps=_best_of_records(spark, d))
    return out.select("window_id", "record_id", "score", F.array_join(F.transform("signals", lambda s: s["name"]), ",").alias("fired"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").where("cluster_id is not null").groupBy("record_id").agg(F.min("cluster_id").alias("component"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").where("score is not null").dropDuplicates(["record_id"])


SOME = Health(neighbour_jaccard=0.06, max_recommendations=10)


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return health.covered_records(_best_of_records(spark, d), SOME)


def cluster_coverage(spark, d):  # noqa: ANN001, ANN201
    out = health.coverage(_covered(spark, d), _members(spark, d), "record_id")
    return out.select("clusters", "covered_clusters", *[F.round(c, 6).alias(c) for c in ("share", "low", "high")])


def coverage_gaps(spark, d):  # noqa: ANN001, ANN201
    out = health.gaps(_covered(spark, d), _members(spark, d), _scores(spark, d), "record_id", SOME)
    return out.select("component", "size", F.round("best_overlap", 6).alias("best_overlap"), "score", F.array_join("signals", ",").alias("signals"))


def signal_coverage(spark, d):  # noqa: ANN001, ANN201
    return health.signal_coverage(_covered(spark, d), _scores(spark, d), "record_id")


def covered_by_signal(spark, d):  # noqa: ANN001, ANN201
    """Whether clusters with a signal are covered less often than ordinary ones: counts and a one-sided exact p."""
    t = health.signalled_against_ordinary(_covered(spark, d), _members(spark, d), table(spark, d, "scores").where("score is not null"), "record_id")
    return spark.createDataFrame([tuple(t.values())], "signalled_covered bigint, signalled bigint, ordinary_covered bigint, ordinary bigint, p double").withColumn("p", F.round("p", 6))


def novel_clusters(spark, d):  # noqa: ANN001, ANN201
    """Documents of the later half unlike all of the earlier half."""
    docs = _docs(spark, d)
    middle = docs.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id)")).first()[0]
    later = similarity.shingle_hashes(docs.where(F.col("doc_id") > middle), "doc_id", "text")
    earlier = similarity.shingle_hashes(docs.where(F.col("doc_id") <= middle).withColumnRenamed("doc_id", "earlier_id"), "earlier_id", "text")
    out = drift.novel_clusters(later, earlier, "doc_id", "earlier_id", Drift())
    return out.select("doc_id", F.round("best_overlap", 6).alias("best_overlap"), "novel")


def drops(spark, d):  # noqa: ANN001, ANN201
    return select.drop_accounts(select.greedy_select(_ranked(spark, d)))


def shortlist_cases(spark, d):  # noqa: ANN001, ANN201
    """The shortlist's cases with placeholder criteria, their tags and notes."""
    rows = _ranked(spark, d)
    chosen = select.greedy_select(rows)
    texts = _records(spark, d).select("record_id", "input_text", "output_text", "judge_verdicts")
    listed = materialize(chosen.where("rank is not null").join(rows, "record_id").join(texts, "record_id").withColumn("reasons", F.array("stratum")))
    out = emit.cases(listed, label.label_candidates(listed), "win")
    return out.select("rank", "id", F.array_join("tags", ",").alias("tags"), F.size("criteria").alias("criteria"), "notes", F.length("input").alias("input_chars"))


def label_rows(spark, d):  # noqa: ANN001, ANN201
    """One row per shortlisted record: what chose it, and the draft of a dry run."""
    rows = _ranked(spark, d)
    chosen = select.greedy_select(rows)
    texts = _records(spark, d).select("record_id", "input_text", "output_text", "judge_verdicts")
    listed = materialize(chosen.where("rank is not null").join(rows, "record_id").join(texts, "record_id").withColumn("reasons", F.array("stratum")))
    out = label.label_candidates(listed)
    return out.select("record_id", "stratum", "score", F.array_join("signals", ",").alias("signals"), F.size("criteria").alias("criteria"), "notes", "draft_error", "model_id", "dry_run", F.length("prompt_sha256").alias("digest"))


def run_verdicts(spark, d):  # noqa: ANN001, ANN201
    """What a run concludes: the exit code of the selection, the JSON expectation of the sources, the model of the labels, the complete tables."""
    rows = _ranked(spark, d)
    code = select.exit_code(materialize(select.greedy_select(rows)))
    expectation = signals.json_expectation(table(spark, d, "field_mappings"), "naive_is_utc")
    context = signals.window_context(_records(spark, d)).first().asDict()
    reasons = sorted(n for n, _, _ in signals.not_evaluated(context, True, expectation, False))
    return spark.createDataFrame([(code, expectation, ",".join(reasons), sum(b for _, _, b in signals.not_evaluated(context, True, expectation, False)))], "exit_code bigint, expectation string, not_evaluated string, blocking bigint")


def spread_by_rating(spark, d):  # noqa: ANN001, ANN201
    """Requests, failures and rated rows of each window, with the medians of their latency."""
    r = _records(spark, d)
    per = drift.medians(r, "window_id", "latency_ms")
    liked = F.lower(F.trim("feedback")).isin(*POSITIVE_WORDS)
    counts = r.groupBy("window_id").agg(F.count("*").alias("requests"), F.count("error").alias("failures"), F.count_if(F.coalesce(liked, F.lit(False))).alias("liked"))
    return counts.join(per, "window_id").select("window_id", "requests", "failures", "liked", "median", F.col("n").alias("timed"))


QUERIES = {
    "q_ticket_records": ticket_records, "q_judged_records": judged_records, "q_ingest_accounts": ingest_accounts, "q_ingest_faults": ingest_faults, "q_jsonl_lines": jsonl_lines,
    "q_sidecar_records": sidecar_records, "q_chat_records": chat_records, "q_new_inputs": new_inputs, "q_pii_flags": pii_flags, "q_email_redacted": email_redacted, "q_email_report": email_report,
    "q_leaked_emails": leaked_classes, "q_minhash": minhash, "q_minhash_estimates": minhash_estimates, "q_band_pairs": band_pairs, "q_near_duplicate_pairs": near_duplicate_pairs,
    "q_scored_with_goldens": scored_with_goldens, "q_cluster_coverage": cluster_coverage, "q_coverage_gaps": coverage_gaps, "q_signal_coverage": signal_coverage, "q_covered_by_signal": covered_by_signal,
    "q_novel_documents": novel_clusters, "q_drops": drops, "q_shortlist_cases": shortlist_cases, "q_label_rows": label_rows, "q_run_verdicts": run_verdicts, "q_window_rates": spread_by_rating,
}
