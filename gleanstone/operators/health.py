"""How well golden cases cover a window's traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.config import SIGNAL_WEIGHTS, Health
from gleanstone.functions import stats
from gleanstone.operators import similarity


def covered_records(best: DataFrame, settings: Health | None = None) -> DataFrame:
    """(key, best_overlap, covered) from best overlaps with the golden inputs."""
    s = settings or Health()
    return best.withColumn("covered", F.col("best_overlap") >= s.neighbour_jaccard)


def coverage(covered: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """One row: clusters, clusters with any covered member, share and Wilson bounds."""
    per = membership.join(covered, key, "left").groupBy("component").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"))
    sums = per.agg(F.count("*").alias("clusters"), F.count_if("covered").alias("covered_clusters"))
    low, high = stats.wilson(F.col("covered_clusters"), F.col("clusters"))
    return sums.select("clusters", "covered_clusters", (F.col("covered_clusters") / F.col("clusters")).alias("share"), low.alias("low"), high.alias("high"))


def gaps(covered: DataFrame, membership: DataFrame, scores: DataFrame, key: str, settings: Health | None = None) -> DataFrame:
    """The largest uncovered clusters with best overlap, highest score and signals in registry order; at most ``max_recommendations``."""
    s = settings or Health()
    rows = membership.join(covered, key, "left").join(scores, key, "left")
    per = rows.groupBy("component").agg(
        F.count("*").alias("size"), F.max(F.coalesce("best_overlap", F.lit(0.0))).alias("best_overlap"), F.max(F.coalesce("score", F.lit(0))).alias("score"),
        F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"),
        *[F.bool_or(F.array_contains(F.transform("signals", lambda x: x["name"]), n)).alias(f"_s_{n}") for n in SIGNAL_WEIGHTS],
    )
    fired = F.filter(F.array(*[F.when(F.col(f"_s_{n}"), F.lit(n)) for n in SIGNAL_WEIGHTS]), lambda x: x.isNotNull())
    return per.where("not covered").select("component", "size", "best_overlap", "score", fired.alias("signals")).orderBy(F.desc("size"), F.desc("score"), "component").limit(s.max_recommendations)


def staleness(goldens: DataFrame, traffic: DataFrame, golden_key: str, key: str, settings: Health | None = None) -> DataFrame:
    """Cases whose best overlap with any record is below the threshold, least first. Both sides: sets of hashes."""
    s = settings or Health()
    best = similarity.best_overlap(goldens, traffic, golden_key, key)
    return best.where(F.col("best_overlap") < s.neighbour_jaccard).orderBy("best_overlap", golden_key)


def redundancy(goldens: DataFrame, golden_key: str, settings: Health | None = None) -> DataFrame:
    """Pairs of cases (sets of hashes) that say nearly the same, most alike first."""
    s = settings or Health()
    return similarity.similar_pairs(goldens, golden_key, s.neighbour_jaccard).orderBy(F.desc("jaccard"), golden_key, "other")


def signal_coverage(covered: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(signal, firing, covered): records on which it fires, and those of them that are covered; every signal has a row."""
    spark = covered.sparkSession
    names = spark.createDataFrame([(n, i) for i, n in enumerate(SIGNAL_WEIGHTS)], "signal string, place int")
    fired = scores.select(key, F.explode("signals").alias("s")).select(key, F.col("s.name").alias("signal"))
    per = fired.join(covered.select(key, "covered"), key, "left").groupBy("signal").agg(F.count("*").alias("firing"), F.count_if("covered").alias("covered"))
    return names.join(per, "signal", "left").na.fill(0, ["firing", "covered"]).select("signal", "place", "firing", "covered")


def signalled_against_ordinary(covered: DataFrame, membership: DataFrame, scores: DataFrame, key: str) -> dict:
    """Whether clusters with a signal (novelty aside) are covered less often than ordinary ones: 2 x 2 counts and a one-sided p.

    One row of each key of ``scores`` counts; signals are reduced to what they say before they are shuffled.
    """
    told = scores.select(key, F.exists("signals", lambda x: x["name"] != "novelty").alias("told")).dropDuplicates([key])
    rows = membership.join(covered.select(key, "covered"), key, "left").join(told, key, "left")
    per = rows.groupBy("component").agg(F.bool_or(F.coalesce("covered", F.lit(False))).alias("covered"), F.bool_or(F.coalesce("told", F.lit(False))).alias("told"))
    t = per.agg(F.count_if(F.col("told") & F.col("covered")).alias("a"), F.count_if(F.col("told") & ~F.col("covered")).alias("b"), F.count_if(~F.col("told") & F.col("covered")).alias("c"), F.count_if(~F.col("told") & ~F.col("covered")).alias("d")).first()
    return {"signalled_covered": t["a"], "signalled": t["a"] + t["b"], "ordinary_covered": t["c"], "ordinary": t["c"] + t["d"], "p": stats.fisher_lower(t["a"], t["b"], t["c"], t["d"])}
