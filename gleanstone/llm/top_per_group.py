"""Top N items within every group, ties by ascending identifier.

Groups are counted exactly with partial counts. A group with more rows than
``heavy_rows``, by default a task's fair share of all rows, is heavy: its rows are
salted into parts of about so many rows, range-partitioned by (group, salt) and
sorted there; each part keeps its N best and a second ranking merges the few
survivors. Light groups take an ordinary window. The results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.session import BROADCAST_ROWS, fair_share, materialize

#: Rows from which a group may be heavy, however few rows a task has.
LEAST_HEAVY = 1_000


def scored_members(items: DataFrame, scores: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """Distinct (group, item, score) of the items that have a group and a score.

    Both sides are distinct before they meet, partially before the shuffle, so rows delivered
    twice and items in many windows shrink first. Several scores of one item count as the largest.
    """
    one = scores.where(F.col(score).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(score).alias("score"))
    pairs = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("grp"), F.col(item).alias("item")).distinct()
    return pairs.join(one, "item").select("grp", "item", "score")


def top_n(items: DataFrame, scores: DataFrame, n: int = 3, group: str = "cluster_id", item: str = "record_id", score: str = "score", heavy_rows: int | None = None) -> DataFrame:
    """(group, item, score, rank) of the up to ``n`` best items of each group.

    Null groups, items without a score and null scores take no part; equal scores rank by
    ascending item; repeated rows count once; NaN ranks above all numbers, as Spark orders it;
    empty tables give no rows; other columns are ignored.
    """
    grouped = items.where(F.col(group).isNotNull())
    limit = fair_share(grouped.count(), items.sparkSession, LEAST_HEAVY) if heavy_rows is None else heavy_rows
    sizes = grouped.groupBy(F.col(group).alias("grp")).count().where(F.col("count") > limit)
    heavy = materialize(sizes.select("grp", F.ceil(F.col("count") / max(limit, 1)).alias("parts")))
    many = heavy.limit(BROADCAST_ROWS + 1).count()
    side = F.broadcast(heavy) if many <= BROADCAST_ROWS else heavy
    members = scored_members(items, scores, group, item, score)
    if many:  # both branches read them
        members = materialize(members)
    best = [F.desc("score"), F.asc("item")]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= n)

    out = ranked(members.join(side, "grp", "left_anti") if many else members, "grp")
    if many:
        salted = members.join(side, "grp").withColumn("salt", F.pmod(F.xxhash64("item"), F.col("parts"))).drop("parts")
        # Range partitions of (group, salt) keep each pair whole: the first ranking sorts in place.
        parts = ranked(salted.repartitionByRange("grp", "salt"), "grp", "salt").drop("rank", "salt")
        out = out.unionByName(ranked(parts, "grp"))
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
