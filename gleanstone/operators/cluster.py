"""Near-duplicate clusters of a window's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.config import Cluster
from gleanstone.errors import GleanstoneError
from gleanstone.operators import similarity
from gleanstone.operators.components import connected_components
from gleanstone.session import materialize, numbered


def memberships(records: DataFrame, settings: Cluster | None = None, key: str = "record_id", text: str = "input_text", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, component), links): every record with its component, wordless ones on their own."""
    s = settings or Cluster()
    links, members = similarity.near_duplicate_links(records, key, text, s.shingle_words, s.permutations, s.bands, s.seed, s.jaccard_threshold, exact)
    links = materialize(links)
    roots = connected_components(links)
    joined = members.join(roots, members["representative"] == roots["node"], "left")
    blank = similarity.normalised(F.col(text)) == ""
    # Texts that normalise to nothing are no evidence of likeness: each stays alone.
    wordless = records.where(blank).select(F.col(key).alias("_k"))
    component = F.when(F.col("_k").isNotNull(), F.col(key)).otherwise(F.coalesce("component", "representative"))
    out = joined.join(wordless, F.col(key) == F.col("_k"), "left").select(key, component.alias("component"))
    return out, links


def cluster_records(records: DataFrame, scores: DataFrame | None = None, settings: Cluster | None = None, key: str = "record_id", text: str = "input_text", exact: bool = False) -> DataFrame:
    """(cluster_id, representative_id, size, min_link_jaccard, component) of every cluster.

    The representative has the highest score, then the smallest key. Labels follow size, then
    representative; the clusters are numbered range by range.
    """
    if records.groupBy(key).count().where("count > 1").limit(1).count():
        raise GleanstoneError(f"{key} is not unique")
    grouped, links = memberships(records, settings, key, text, exact)
    grouped = materialize(grouped)
    scored = grouped.join(scores.select(key, "score"), key, "left") if scores is not None else grouped.withColumn("score", F.lit(0))
    heads = scored.groupBy("component").agg(F.min_by(key, F.struct(-F.coalesce("score", F.lit(0)), F.col(key))).alias("representative_id"), F.count("*").alias("size"))
    weakest = links.join(grouped, links["a"] == grouped[key]).groupBy("component").agg(F.min("jaccard").alias("min_link_jaccard"))
    out = numbered(heads.join(weakest, "component", "left"), [F.desc("size"), F.asc("representative_id")], output="rank")
    out = out.withColumn("cluster_id", F.format_string("c-%04d", "rank"))
    return out.select("cluster_id", "representative_id", "size", "min_link_jaccard", "component")


def classes(docs: DataFrame, settings: Cluster | None = None, key: str = "doc_id", text: str = "text", exact: bool = True) -> DataFrame:
    """One row per document: its class and its number of links to representatives of other texts; no link is lost unless ``exact`` is given up."""
    grouped, links = memberships(docs, settings, key, text, exact)
    degree = links.select(F.col("a").alias(key)).union(links.select("b")).groupBy(key).agg(F.count("*").alias("links"))
    return grouped.join(degree, key, "left").select(key, F.col("component").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
