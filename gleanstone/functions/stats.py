"""Small statistics: intervals, exact tests, distances between distributions."""

from __future__ import annotations

from math import fsum, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959964
#: Share of the most likely term below which terms of an exact test vanish in a double.
LEAST = 1e-300


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval of a rate; null without observations."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(middle - half, F.lit(0.0))), F.when(ok, F.least(middle + half, F.lit(1.0)))


def wilson_bounds(hits: int, n: int, z: float = Z) -> tuple[float, float] | None:
    if n <= 0:
        return None
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return max(middle - half, 0.0), min(middle + half, 1.0)


def fisher_lower(a: int, b: int, c: int, d: int) -> float | None:
    """One-sided exact p of a or fewer hits in the first row of the table ((a, b), (c, d)); None for an empty group.

    Terms follow from their neighbours, from the most likely one outwards until they vanish, and are divided by their sum:
    a few dozen standard deviations, however large the table, and no binomial of its size.
    """
    first, second, hits = a + b, c + d, a + c
    if not first or not second:
        return None
    low, high = max(0, hits - second), min(first, hits)
    mode = min(high, max(low, (first + 1) * (hits + 1) // (first + second + 2)))
    terms, k, term = {mode: 1.0}, mode, 1.0
    while k < high and term > LEAST:
        term *= (first - k) / (k + 1) * ((hits - k) / (second - hits + k + 1))
        terms[k := k + 1] = term
    k, term = mode, 1.0
    while k > low and term > LEAST:
        term *= k / (first - k + 1) * ((second - hits + k) / (hits - k + 1))
        terms[k := k - 1] = term
    return min(1.0, fsum(x for k, x in terms.items() if k <= a) / fsum(terms.values()))


def ks_distance(values: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row with the largest gap between two empirical distributions.

    Equal values are counted together first; the running sums then pass over the distinct values
    only, cut into ranges whose totals are added ahead, so no task sorts them all.
    """
    rows = values.where(F.col(value).isNotNull() & F.col(group).isin(first, second))
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    ranged = counts.repartitionByRange("v").withColumn("_part", F.spark_partition_id())
    from gleanstone.session import materialize

    ranged = materialize(ranged)
    totals = ranged.groupBy("_part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = totals.select("_part", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("sb"))
    sums = totals.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    upto = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({"ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto)}).join(F.broadcast(starts), "_part")
    na, nb = sums["na"] or 0, sums["nb"] or 0
    gap = F.abs((F.col("sa") + F.col("ca")) / F.lit(na) - (F.col("sb") + F.col("cb")) / F.lit(nb)) if na and nb else F.lit(None).cast("double")
    return running.agg(F.max(gap).alias("ks"), F.lit(na).alias("n_first"), F.lit(nb).alias("n_second"))
