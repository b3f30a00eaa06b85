"""Command line: each stage reads a window's artefacts and writes its own.

Exit codes: 0 fine, 1 partly, 2 nothing produced, 3 could not run.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanstone import config as settings
from gleanstone.errors import GleanstoneError
from gleanstone.operators import cluster, drift, emit, health, ingest, label, redact, select, signals, similarity
from gleanstone.session import local_session, materialize, ship_package
from gleanstone.sinks import storage
from gleanstone.sinks.window import COUNTERS, Window, write_report
from gleanstone.sources import files, lines, mapping

OK, PARTIAL, NOTHING, FAILED = 0, 1, 2, 3


def _window(spark: SparkSession, args: argparse.Namespace, name: str | None = None) -> Window:
    return Window(spark, f"{args.root.rstrip('/')}/{name or args.window}")


def run_ingest(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    m = mapping.load(args.mapping, args.mappings)
    window = _window(spark, args)
    window.check_writable(args.append)
    digest = files.source_sha256(args.source)
    window.refuse_again(args.source, digest)
    if (args.sidecar is None) != (m.sidecar is None):
        raise GleanstoneError("the mapping and the command disagree about a sidecar")
    side = files.load_sidecar(spark, args.sidecar, m.sidecar.text_field) if m.sidecar else None
    built = materialize(ingest.build_records(lines.read_source(spark, args.source, m.source_format), m, side, cfg.ingest.max_text_chars))
    records, report = ingest.records_of(built), None
    if cfg.privacy.redact:
        records, report = redact.redact(records, allowlist=cfg.privacy.name_allowlist)
    if cfg.dedupe.dedupe:
        from gleanstone.operators.dedupe import first_per_fingerprint

        records = first_per_fingerprint(records, "input_text", ["line_no"], window.fingerprints() if args.append else None)
    records = materialize(records)
    counts = ingest.accounts(built, records).first().asDict()
    if not counts["written"]:
        return NOTHING
    window.append_records(records, guarded=cfg.privacy.redact)
    failures = ingest.failures_of(built)
    window.append_errors(failures)
    by_type = {r["error_type"]: r["lines"] for r in ingest.error_histogram(failures).collect()}
    found = {r["pii_class"]: r["found"] for r in report.collect()} if report is not None else {}
    source = {"path": args.source, "sha256": digest, "mapping": m.name, "mapping_sha256": m.sha256, "source_format": m.source_format, "bytes": Path(args.source).stat().st_size, "expect_output_json": m.expect_output_json}
    window.commit(source, {k: counts[k] for k in COUNTERS}, by_type, found, cfg.dedupe.dedupe)
    return PARTIAL if by_type else OK


def run_score(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    window = _window(spark, args)
    records, manifest = window.records(), window.manifest() or {"sources": [], "dedupe_enabled": True}
    sources = [bool(s.get("expect_output_json")) for s in manifest["sources"]]
    expectation = "all" if sources and all(sources) else "mixed" if any(sources) else "none"
    overlaps = None
    if args.existing:
        goldens = similarity.shingle_hashes(files.load_goldens(spark, args.existing), "id", "input", cfg.cluster.shingle_words)
        overlaps = similarity.best_overlap(similarity.shingle_hashes(records, "record_id", "input_text", cfg.cluster.shingle_words), goldens, "record_id", "id")
        wordless = records.select("record_id").join(overlaps, "record_id", "left_anti").select("record_id", F.lit(0.0).alias("best_overlap"))
        overlaps = overlaps.select("record_id", "best_overlap").unionByName(wordless)
    scores = signals.score_records(records, cfg.score, expect_json=expectation == "all", disagreement=not manifest["dedupe_enabled"], overlaps=overlaps)
    window.write_artefact("scores", scores)
    write_report(window, "scores", "Signals", signals.signal_histogram(window.artefact("scores", "score")).orderBy(F.desc("records")))
    context = signals.window_context(records, cfg.score).first().asDict()
    blocking = [x for x in signals.not_evaluated(context, manifest["dedupe_enabled"], expectation, bool(args.existing)) if x[2]]
    return PARTIAL if blocking else OK


def run_cluster(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    window = _window(spark, args)
    records, scores = window.records(), window.artefact("scores", "score")
    grouped, _ = cluster.memberships(records, cfg.cluster)
    window.write_artefact("members", grouped)
    window.write_artefact("clusters", cluster.cluster_records(records, scores, cfg.cluster))
    return OK


def run_select(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    window = _window(spark, args)
    records, scores = window.records(), window.artefact("scores", "score")
    select.check_complete(records, scores, "scores")
    members = window.artefact("members", "cluster").withColumnRenamed("component", "cluster_id")
    scored = scores.join(members, "record_id").withColumn("stratum", signals.stratum(F.col("signals"), cfg.score.weights))
    if args.existing:
        goldens = similarity.shingle_hashes(files.load_goldens(spark, args.existing), "id", "input", cfg.cluster.shingle_words)
        best = similarity.best_overlap(similarity.shingle_hashes(records, "record_id", "input_text", cfg.cluster.shingle_words), goldens, "record_id", "id")
        scored = scored.join(best.select("record_id", (F.col("best_overlap") >= cfg.score.novelty_max_jaccard).alias("held")), "record_id", "left")
    chosen = materialize(select.greedy_select(scored, cfg.select, args.max_candidates))
    reasons = F.transform("signals", lambda s: s["name"])
    rows = chosen.where("rank is not null").join(scored, "record_id").join(records, "record_id").select("rank", "record_id", "score", "stratum", "cluster_id", reasons.alias("reasons"), "input_text", "output_text", "judge_verdicts")
    window.write_artefact("candidates", rows)
    write_report(window, "selection", "Strata", select.stratum_accounts(chosen, scored, cfg.select.quotas))
    write_report(window, "dropped", "Omissions", select.drop_accounts(chosen))
    return select.exit_code(chosen)


def run_label(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    window = _window(spark, args)
    labels = label.label_candidates(window.artefact("candidates", "select"), settings=cfg.label)
    window.write_artefact("labels", labels)
    write_report(window, "labels_report", "Drafts by outcome", labels.groupBy(F.coalesce("draft_error", F.lit("drafted")).alias("outcome"), "model_id").count())
    return PARTIAL if labels.where("draft_error is not null").limit(1).count() else OK


def run_emit(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:  # noqa: ARG001
    window = _window(spark, args)
    candidates, labels = window.artefact("candidates", "select"), window.artefact("labels", "label")
    window.write_text("review.md", emit.review(candidates, labels, args.window))
    return emit.emit(emit.cases(candidates, labels, args.window), lambda text: window.write_text("cases.yaml", text), labels.where("draft_error is not null").count())


def run_promote(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:  # noqa: ARG001
    emit.promote(storage.read_text(spark, _window(spark, args).at("cases.yaml")), args.target, args.ids, args.reviewer)
    return OK


def run_health(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    window = _window(spark, args)
    size = cfg.cluster.shingle_words
    records, scores, members = window.records(), window.artefact("scores", "score"), window.artefact("members", "cluster")
    traffic = materialize(similarity.shingle_hashes(records, "record_id", "input_text", size))
    goldens = materialize(similarity.shingle_hashes(files.load_goldens(spark, args.existing), "id", "input", size))
    covered = materialize(health.covered_records(similarity.best_overlap(traffic, goldens, "record_id", "id"), cfg.health))
    write_report(window, "health", "Coverage", health.coverage(covered, members, "record_id"))
    write_report(window, "health_gaps", "Uncovered clusters", health.gaps(covered, members, scores, "record_id", cfg.health))
    write_report(window, "health_stale", "Cases unlike any record", health.staleness(goldens, traffic, "id", "record_id", cfg.health))
    write_report(window, "health_redundant", "Cases that say nearly the same", health.redundancy(goldens, "id", cfg.health))
    clusters = window.artefact("clusters", "cluster")
    told = health.signalled_against_ordinary(covered, members, scores, "record_id")
    write_report(window, "health_comparison", "Signalled and ordinary clusters, novelty aside (one-sided exact test)", spark.createDataFrame([tuple(told.values())], "signalled_covered bigint, signalled bigint, ordinary_covered bigint, ordinary bigint, p double"))
    write_report(window, "health_clusters", "Clusters by size", clusters.groupBy("size").agg(F.count("*").alias("clusters")).orderBy("size"))
    write_report(window, "health_signals", "Signals covered", health.signal_coverage(covered, scores, "record_id").orderBy("place"))
    return OK


def run_drift(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    early, late = _window(spark, args, args.earlier), _window(spark, args, args.later)
    a, b = early.records(), late.records()
    rows = a.withColumn("w", F.lit("a")).unionByName(b.withColumn("w", F.lit("b"))).withColumn("input_len", F.length("input_text"))
    hits = {"error": F.col("error").isNotNull(), "negative_feedback": F.lower(F.trim("feedback")).isin(*cfg.score.negative_feedback_words)}
    fired = [w.artefact("scores", "score").select("record_id", F.transform("signals", lambda x: x["name"]).alias("fired")) for w in (early, late)]
    rows = a.withColumn("w", F.lit("a")).join(fired[0], "record_id", "left").unionByName(b.withColumn("w", F.lit("b")).join(fired[1], "record_id", "left")).withColumn("input_len", F.length("input_text"))
    hits |= {f"signal:{n}": F.array_contains("fired", n) for n in settings.SIGNAL_WEIGHTS}
    write_report(late, "drift_rates", "Rates", drift.rate_shift(rows, "w", "a", "b", hits))
    write_report(late, "drift_length", "Input length", drift.input_length_shift(rows, "w", "a", "b", "input_len"))
    heads = late.artefact("clusters", "cluster").select(F.col("representative_id").alias("record_id")).join(b, "record_id")
    size = cfg.cluster.shingle_words
    novel = drift.novel_clusters(similarity.shingle_hashes(heads, "record_id", "input_text", size), similarity.shingle_hashes(a, "record_id", "input_text", size).withColumnRenamed("record_id", "earlier_id"), "record_id", "earlier_id", cfg.drift)
    write_report(late, "drift_novelty", "New clusters", novel.groupBy("novel").agg(F.count("*").alias("clusters")))
    return OK


def run_redact(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:
    print(redact.redact_text(spark, args.text, cfg.privacy.name_allowlist))
    return OK


def run_window(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:  # noqa: ARG001
    if args.action == "list":
        print("\n".join(files.list_windows(spark, args.root)))
        return OK
    import json

    print(json.dumps(_window(spark, args).manifest(), indent=2, sort_keys=True))
    return OK


def run_mappings(spark: SparkSession, cfg: settings.Config, args: argparse.Namespace) -> int:  # noqa: ARG001
    print("\n".join(mapping.available(args.mappings)))
    return OK


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gleanstone")
    top.add_argument("--config")
    top.add_argument("--root", default="windows")
    top.add_argument("--mappings", default="mappings")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, window: bool = True) -> argparse.ArgumentParser:  # noqa: ANN001
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if window:
            p.add_argument("--window", required=True)
        return p

    p = add("ingest", run_ingest)
    p.add_argument("source")
    p.add_argument("--mapping", required=True)
    p.add_argument("--sidecar")
    p.add_argument("--append", action="store_true")
    add("score", run_score).add_argument("--existing")
    add("cluster", run_cluster)
    p = add("select", run_select)
    p.add_argument("--existing")
    p.add_argument("--max-candidates", type=int)
    add("label", run_label)
    add("emit", run_emit)
    p = add("promote", run_promote)
    p.add_argument("--target", required=True)
    p.add_argument("--reviewer", required=True)
    p.add_argument("ids", nargs="+")
    add("health", run_health).add_argument("--existing", required=True)
    p = add("drift", run_drift, window=False)
    p.add_argument("--earlier", required=True)
    p.add_argument("--later", required=True)
    add("redact", run_redact, window=False).add_argument("text")
    p = add("window", run_window, window=False)
    p.add_argument("action", choices=("show", "list"))
    p.add_argument("--window")
    add("mappings", run_mappings, window=False).add_argument("action", choices=("list",))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        cfg = settings.load(args.config) if args.config else settings.Config()
        spark = spark or local_session()
        ship_package(spark)
        return args.run(spark, cfg, args)
    except GleanstoneError as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
