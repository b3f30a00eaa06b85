"""What changed between two windows of traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.config import Drift
from gleanstone.functions import stats
from gleanstone.operators import similarity
from gleanstone.session import attach, materialize, running


def _compared(both: DataFrame) -> DataFrame:
    """Adds rates, Wilson bounds, delta and whether the intervals are apart to n_a, hits_a, n_b, hits_b."""
    la, ha = stats.wilson(F.col("hits_a"), F.col("n_a"))
    lb, hb = stats.wilson(F.col("hits_b"), F.col("n_b"))
    out = both.withColumns({"rate_a": F.when(F.col("n_a") > 0, F.col("hits_a") / F.col("n_a")), "rate_b": F.when(F.col("n_b") > 0, F.col("hits_b") / F.col("n_b")), "low_a": la, "high_a": ha, "low_b": lb, "high_b": hb})
    return out.withColumns({"delta": F.col("rate_b") - F.col("rate_a"), "separated": (F.col("low_b") > F.col("high_a")) | (F.col("low_a") > F.col("high_b"))})


def _sums(rows: DataFrame, window: str, hits: dict[str, Column]) -> DataFrame:
    """(window, n, measure, hits): one aggregation for all measures."""
    sums = rows.groupBy(window).agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"h_{m}") for m, c in hits.items()])
    return sums.select(window, "n", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"h_{m}").alias("hits")) for m in hits])))


def rate_shift(rows: DataFrame, window: str, earlier: str, later: str, hits: dict[str, Column]) -> DataFrame:
    """(measure, rates and Wilson bounds of both windows, delta, separated): separated if the intervals don't meet."""
    long = _sums(rows.where(F.col(window).isin(earlier, later)), window, hits)
    pick = lambda w, c: F.max(F.when(F.col(window) == w, F.col(c)))
    both = long.groupBy("measure").agg(pick(earlier, "n").alias("n_a"), pick(earlier, "hits").alias("hits_a"), pick(later, "n").alias("n_b"), pick(later, "hits").alias("hits_b"))
    return _compared(both.na.fill(0, ["n_a", "hits_a", "n_b", "hits_b"]))


def rate_shifts(rows: DataFrame, window: str, hits: dict[str, Column]) -> DataFrame:
    """``rate_shift`` between every window and the next by name: (earlier, later, measure, ...). Null windows take no part."""
    long = _sums(rows.where(F.col(window).isNotNull()), window, hits)
    nth = Window.partitionBy("measure").orderBy(window)  # a row per window
    both = long.select(
        F.lag(window).over(nth).alias("earlier"), F.col(window).alias("later"), "measure", F.lag("n").over(nth).alias("n_a"), F.lag("hits").over(nth).alias("hits_a"), F.col("n").alias("n_b"), F.col("hits").alias("hits_b")
    )
    return _compared(both.where("earlier is not null"))


def value_shifts(rows: DataFrame, window: str, value: str) -> DataFrame:
    """(earlier, later, ks, n_first, n_second, median_a, median_b) between every window and the next by name.

    Equal values of a window are counted together first; the running sums of each pair of windows then pass
    over its distinct values range by range. Null windows and values take no part.
    """
    known = rows.where(F.col(window).isNotNull() & F.col(value).isNotNull())
    counts = known.groupBy(F.col(window).alias("w"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    counts = materialize(counts)
    names = counts.groupBy("w").agg(F.sum("k").alias("n"))
    pairs = names.select(F.lag("w").over(Window.orderBy("w")).alias("earlier"), F.col("w").alias("later"), F.lag("n").over(Window.orderBy("w")).alias("na"), F.col("n").alias("nb")).where("earlier is not null")  # a row per window
    side = lambda key, a, b: attach(counts, pairs.withColumn("w", F.col(key)), ["w"], "inner").select("earlier", "later", "na", "nb", "v", F.lit(a) * F.col("k") / F.col("na") - F.lit(b) * F.col("k") / F.col("nb"))
    steps = side("earlier", 1.0, 0.0).toDF("earlier", "later", "na", "nb", "v", "step").unionByName(side("later", 0.0, 1.0).toDF("earlier", "later", "na", "nb", "v", "step"))
    steps = steps.groupBy("earlier", "later", "na", "nb", "v").agg(F.sum("step").alias("step"))
    gaps = running(steps, ["earlier", "later"], "v", "step", "gap")
    ks = gaps.groupBy("earlier", "later", "na", "nb").agg(F.max(F.abs("gap")).alias("ks"))
    middle = medians(known, window, value).select(F.col(window).alias("w"), "median")
    out = ks.join(middle.select(F.col("w").alias("earlier"), F.col("median").alias("median_a")), "earlier").join(middle.select(F.col("w").alias("later"), F.col("median").alias("median_b")), "later")
    return out.select("earlier", "later", "ks", F.col("na").alias("n_first"), F.col("nb").alias("n_second"), "median_a", "median_b")


def medians(rows: DataFrame, window: str, value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(window).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def input_length_shift(rows: DataFrame, window: str, earlier: str, later: str, value: str) -> DataFrame:
    """One row: the KS distance of a measure between two windows and both medians."""
    ks = stats.ks_distance(rows, window, value, earlier, later)
    m = {r[window]: r["median"] for r in medians(rows.where(F.col(window).isin(earlier, later)), window, value).collect()}  # two rows
    return ks.withColumns({"median_a": F.lit(m.get(earlier)).cast("double"), "median_b": F.lit(m.get(later)).cast("double")})


def novel_clusters(representatives: DataFrame, earlier: DataFrame, key: str, other: str, settings: Drift | None = None) -> DataFrame:
    """Later clusters whose representative is unlike every earlier record; both sides sets of hashes."""
    s = settings or Drift()
    best = similarity.best_overlap(representatives, earlier, key, other)
    return best.withColumn("novel", F.col("best_overlap") < s.novel_cluster_jaccard)
