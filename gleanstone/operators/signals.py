"""Thirteen transparent signals, their evidence and the score, in one projection beside small window facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.config import ORDINARY, SIGNAL_WEIGHTS, Score
from gleanstone.functions.extract import is_one_json, with_last_names
from gleanstone.functions.text import fingerprint, first_of
from gleanstone.schema import SIGNALS
from gleanstone.session import attach, materialize

# The named patterns of injections and refusals, in order.
INJECTIONS = (
    ("override_instructions", r"\b(?:ignore|disregard|forget)\b[^.!?\n]{0,40}?\b(?:instruction|instructions|prompt|rules?|guidelines?)\b"),
    ("reveal_system_prompt", r"\b(?:system|initial|original)\s+(?:prompt|message|instructions)\b"),
    ("repeat_the_above", r"\brepeat\b[^.!?\n]{0,30}?\b(?:above|preceding|everything)\b"),
    ("roleplay_jailbreak", r"\byou are now\b|\b(?:dan|do anything now)\s+mode\b|\bpretend (?:you are|to be) (?:a |an )?(?:different|another|unrestricted)\b|\bwith no (?:rules|restrictions|filters)\b"),
)
REFUSALS = (
    ("cannot_help", r"\bi\s*(?:'m|’m|\s+am)?\s*(?:really |very |so )?(?:sorry|afraid)[,\s]*(?:but\s+)?i\s*(?:can\s?not|can'?t|can’t|won'?t|will not)\b|\bi\s*(?:can\s?not|cannot|can'?t|can’t)\s+(?:help|assist|provide|comply|answer|continue|do that)\b"),
    ("unable_to", r"\bi\s*(?:am|'m|’m)?\s*(?:not able|unable)\s+to\b"),
    ("as_an_ai", r"\bas an ai(?:\s+(?:language\s+)?model)?\b"),
)


def first_match(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Name of the first pattern that a text holds."""
    return first_of(*[(text.rlike(f"(?i){p}"), name) for name, p in patterns], otherwise=F.lit(None).cast("string"))


def _failed(verdicts: Column) -> Column:
    return F.filter(verdicts, lambda v: ~v["passed"])


def window_context(records: DataFrame, settings: Score | None = None, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by``) of nearest-rank percentiles; null where fewer than ``min_outlier_sample`` rows have the value."""
    s = settings or Score()
    p = s.outlier_percentile / 100
    frame = records.select(*(by or []), F.col("latency_ms").alias("_lat"), F.length("input_text").alias("_in"), F.length("output_text").alias("_out"))
    aggregates = []
    for value, name in (("_lat", "latency_p"), ("_in", "input_len_p"), ("_out", "output_len_p")):
        exact = F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
        aggregates += [F.when(F.count(value) >= s.min_outlier_sample, exact).cast("bigint").alias(name), F.count(value).alias(f"{name}_n")]
    return frame.groupBy(*(by or [])).agg(*aggregates) if by else frame.agg(*aggregates)


def disagreements(records: DataFrame, version: str = "prompt_version") -> DataFrame:
    """(fingerprint, versions): texts for which at least two prompt versions have different sets of outcomes."""
    failed = F.col("error").isNotNull() | (F.size(_failed(F.col("judge_verdicts"))) > 0)
    rows = records.where(F.col(version).isNotNull()).select(fingerprint(F.col("input_text")).alias("fingerprint"), F.col(version).alias("version"), F.when(failed, "failed").otherwise("passed").alias("outcome"))
    sets = rows.groupBy("fingerprint", "version").agg(F.array_join(F.sort_array(F.collect_set("outcome")), "/").alias("outcomes"))
    grouped = sets.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_distinct("outcomes").alias("kinds"), F.array_join(F.sort_array(F.collect_list(F.format_string("%s (%s)", "version", "outcomes"))), ", ").alias("versions"))
    return grouped.where("n >= 2 and kinds >= 2").select("fingerprint", "versions")


def json_expectation(sources: DataFrame, column: str = "expect_output_json") -> str:
    """all, none or mixed over the sources of a window."""
    row = sources.agg(F.bool_and(column).alias("every"), F.bool_or(column).alias("some")).first()
    return "all" if row["every"] else "mixed" if row["some"] else "none"


def not_evaluated(context: dict, dedupe_enabled: bool, expectation: str, goldens: bool) -> list[tuple[str, str, bool]]:
    """(signal, reason, blocking) of signals that this window can't have."""
    out = []
    if context["latency_p"] is None:
        out.append(("latency_outlier", f"only {context['latency_p_n']} records have a latency", False))
    if context["input_len_p"] is None:
        out.append(("length_outlier", f"only {context['input_len_p_n']} records", False))
    if dedupe_enabled:
        out.append(("version_disagreement", "records were deduplicated by their input", True))
    if not goldens:
        out.append(("novelty", "no golden cases were given", False))
    if expectation != "all":
        out.append(("format_violation", "no source expects JSON" if expectation == "none" else "sources disagree about JSON", expectation == "mixed"))
    return out


def score_records(records: DataFrame, settings: Score | None = None, by: list[str] | None = None, expect_json: bool = False, disagreement: bool = True, overlaps: DataFrame | None = None) -> DataFrame:
    """(by, record_id, score, signals) of every record.

    ``overlaps`` (record_id, best_overlap) with golden cases turns novelty on. The context joins as a
    broadcast of one row per window; disagreements join on the fingerprint, only where asked for.
    """
    s = settings or Score()
    w = {**SIGNAL_WEIGHTS, **s.weights}
    context = window_context(records, s, by)
    df = records.withColumn("_feedback", F.lower(F.trim("feedback")))
    if by:
        df = attach(df, materialize(context), by)
    else:
        row = context.first()
        df = df.withColumns({c: F.lit(row[c]).cast("bigint") for c in context.columns})
    if disagreement:
        # A text may be a third of all rows: its one partner is broadcast, or the rows are salted.
        told = materialize(disagreements(records).withColumnRenamed("fingerprint", "_fp"))
        df = attach(df.withColumn("_fp", fingerprint(F.col("input_text"))), told, ["_fp"])
    else:
        df = df.withColumn("versions", F.lit(None).cast("string"))
    df = df.join(overlaps.select("record_id", "best_overlap"), "record_id", "left") if overlaps is not None else df.withColumn("best_overlap", F.lit(None).cast("double"))
    col, failed = F.col, _failed(F.col("judge_verdicts"))
    bad_verdict = F.coalesce(F.size(failed) > 0, F.lit(False))
    share = F.length(F.regexp_replace("input_text", r"[\x00-\x7F]", "")) / F.length("input_text")
    long_in, long_out = F.length("input_text") >= col("input_len_p"), F.length("output_text") >= col("output_len_p")
    evidence = {
        "error": F.when(col("error").isNotNull(), F.format_string("the call failed with %s", "error")),
        "judge_failure": F.when(bad_verdict, F.format_string("%d of %d judged criteria failed: %s", F.size(failed), F.size("judge_verdicts"), F.array_join(F.transform(failed, lambda v: v["criterion"]), "; "))),
        "negative_feedback": F.when(col("_feedback").isin(*s.negative_feedback_words), F.format_string("the feedback was %s", "_feedback")),
        "feedback_conflict": F.when(col("_feedback").isin(*s.positive_feedback_words) & (col("error").isNotNull() | bad_verdict), F.lit("a failure with positive feedback")),
        "version_disagreement": col("versions"),
        "injection_pattern": first_match(col("input_text"), INJECTIONS),
        "refusal_pattern": first_match(col("output_text"), REFUSALS),
        "format_violation": F.when(F.lit(expect_json) & col("output_text").isNotNull() & ~F.coalesce(is_one_json(col("output_text")) | with_last_names(col("output_text")).isNotNull(), F.lit(False)), F.lit("the output is no JSON")),
        "novelty": F.when(F.lit(overlaps is not None) & (F.coalesce("best_overlap", F.lit(0.0)) < s.novelty_max_jaccard), F.format_string("best overlap %.2f", F.coalesce("best_overlap", F.lit(0.0)))),
        "latency_outlier": F.when(col("latency_ms") >= col("latency_p"), F.format_string("%d ms, the window's limit is %d", "latency_ms", "latency_p")),
        "length_outlier": F.when(long_in, F.format_string("input of %d", F.length("input_text"))).when(long_out, F.format_string("output of %d", F.length("output_text"))),
        "non_ascii_ratio": F.when(share > s.non_ascii_threshold, F.format_string("%.2f of the input isn't ASCII", share)),
        "tiny_input": F.when(F.length(F.trim("input_text")) < s.tiny_input_chars, F.format_string("%d characters", F.length(F.trim("input_text")))),
    }
    df = df.withColumns({f"_e_{name}": e for name, e in evidence.items()})
    fired = F.array(*[F.when(col(f"_e_{n}").isNotNull(), F.struct(F.lit(n).alias("name"), F.lit(w[n]).alias("weight"), col(f"_e_{n}").alias("evidence"))) for n in SIGNAL_WEIGHTS])
    df = df.withColumn("signals", F.filter(fired, lambda x: x.isNotNull()).cast(SIGNALS))
    total = F.aggregate("signals", F.lit(0), lambda a, x: a + x["weight"])
    return df.withColumn("score", total).select(*(by or []), "record_id", "score", "signals")


def signal_histogram(scores: DataFrame) -> DataFrame:
    return scores.select(F.explode("signals").alias("s")).groupBy(F.col("s.name").alias("signal")).agg(F.count("*").alias("records"))


def stratum(signals: Column, weights: dict[str, int] | None = None) -> Column:
    """The fired signal of the highest weight, ties by registry order; ``ordinary`` without any."""
    w = {**SIGNAL_WEIGHTS, **(weights or {})}
    ranked = [F.struct(F.lit(-w[n]).alias("weight"), F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(SIGNAL_WEIGHTS)]
    names = F.transform(signals, lambda x: x["name"])
    mine = F.filter(F.array(*ranked), lambda r: F.array_contains(names, r["name"]))
    return F.coalesce(F.array_min(mine)["name"], F.lit(ORDINARY))
