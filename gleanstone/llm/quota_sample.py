"""A sample that meets target proportions, floors included, with a report of what could not be met.

Per window the counts of the cells (stratum x further categories) are raked by
iterative proportional fitting to several margins: the strata to their quotas, or
where none is given to their target shares, the further categories to their
shares of the pool. The fitted strata tell how many rows each is to give; a row's
weight is its cell's fitted count over its cell's rows. Rows get weighted
exponential keys ``-ln(u) / weight`` with ``u`` from a digest of seed, window and
identifier, and each stratum gives the rows of its smallest keys. What was drawn
is then counted: strata below their minimum are repaired with their next rows,
and the gaps that remain are reported for the strata and for all other margins.

Taking the k smallest keys of a stratum needs no sort of the stratum: keys fall
into ``BUCKETS`` ordered buckets that are counted with partial counts; buckets
below the k-th row are taken whole and only the one that holds it is ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.session import attach, materialize

BUCKETS = 4096
ROUNDS = 50
SEED = 20260105
ANY = "(all)"


def _tidy(stratum: Column) -> Column:
    return F.lower(F.regexp_replace(stratum, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def pool(candidates: DataFrame) -> DataFrame:
    """Distinct (window_id, stratum, record_id) with further categories; rows without one of the three count nowhere."""
    size = F.max("cluster_size")
    band = F.when(size.isNull(), "unknown").when(size <= 1, "single").when(size <= 4, "small").otherwise("large")
    given = F.max(F.coalesce(F.size("reasons"), F.lit(0)))
    reasons = F.when(given > 1, "several").when(given == 1, "one").otherwise("none")
    keys = [F.col("window_id"), _tidy(F.col("stratum")).alias("stratum"), F.col("record_id")]
    known = candidates.where("window_id is not null and stratum is not null and record_id is not null")
    return known.groupBy(*keys).agg(band.alias("band"), reasons.alias("reasons"))


CELLS = "window_id string, stratum string, band string, reasons string, n bigint, fitted double, planned bigint"


def rake(cells: pd.DataFrame) -> pd.DataFrame:
    """Fits the cells of one window: ``n`` rows, ``quota`` and ``share`` of the stratum and ``total`` of the window become ``fitted`` and ``planned``.

    A stratum's target is its quota, else its share of the total; without any quota in the window the total is
    the largest that all shares can be met with. ``planned`` is the fitted stratum, rounded so that totals agree.
    """
    cells = cells.sort_values(["stratum", "band", "reasons"]).reset_index(drop=True)
    n = cells["n"].to_numpy(float)
    codes, first = {}, None
    for c in ("stratum", "band", "reasons"):
        _, at, codes[c] = np.unique(cells[c].to_numpy(str), return_index=True, return_inverse=True)
        first = at if c == "stratum" else first
    s = codes["stratum"]
    quota, share = (np.clip(np.nan_to_num(cells[c].to_numpy(float)[first], nan=fill), fill, None) for c, fill in (("quota", -1.0), ("share", 0.0)))
    there = np.bincount(s, n)
    total = cells["total"].to_numpy(float)[0]
    if np.isnan(total):
        total = min((h / p for h, p in zip(there, share) if p > 0), default=0.0)
    target = np.where(quota >= 0, quota, share * total)
    margins = [(s, target)]
    wanted = target[s] > 0
    for c in ("band", "reasons"):  # shares of those rows of the pool that can be drawn at all
        held = np.bincount(codes[c], n * wanted)
        margins.append((codes[c], held / max(held.sum(), 1.0) * target.sum()))
    fitted = n * wanted
    for _ in range(ROUNDS):
        before = fitted
        for code, goal in reversed(margins):  # the strata come last: their margin holds exactly
            now = np.bincount(code, fitted, len(goal))
            fitted = fitted * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if np.abs(fitted - before).max() <= 1e-9 * max(target.sum(), 1.0):
            break
    sums = np.bincount(s, fitted)
    planned = np.floor(sums + 1e-9)
    loose = np.argsort(planned - sums, kind="stable")[: int(round(sums.sum() - planned.sum()))]
    planned[loose] += 1
    planned = np.where(quota >= 0, quota, planned).astype(np.int64)
    return cells.assign(fitted=fitted, planned=planned[s])[[c.split()[0] for c in CELLS.split(", ")]]


def wanted_rows(strata: DataFrame) -> DataFrame:
    """One row per window and stratum with its quota, share and floor, and the window's ``total`` that the quotas stand for (null without any)."""
    rows = strata.withColumn("name", _tidy(F.col("stratum"))).where("window_id is not null and name is not null")
    rows = rows.groupBy("window_id", "name").agg(*[F.max(c).alias(c) for c in ("stratum", "target_share", "min_rows", "quota")])
    over = lambda c: F.sum(F.when(F.col("quota").isNotNull(), F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))).over(Window.partitionBy("window_id"))
    held = over(F.col("target_share"))
    return rows.withColumn("total", F.when(held > 0, over(F.col("quota")) / held))


def fitted_cells(candidates: DataFrame, strata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool, raked cells). A window has as many cells as strata x bands x reasons, however many rows; windows are raked side by side."""
    goals = wanted_rows(strata).select("window_id", F.col("name").alias("stratum"), F.col("target_share").alias("share"), "quota", "total")
    rows = pool(candidates)
    cells = rows.groupBy("window_id", "stratum", "band", "reasons").agg(F.count("*").alias("n")).join(goals, ["window_id", "stratum"], "left")
    # Small as they are, windows stay apart: raking takes time, not bytes.
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows, materialize(cells.repartition(parts, "window_id").groupBy("window_id").applyInPandas(rake, CELLS))


def _smallest(keyed: DataFrame, goals: DataFrame) -> DataFrame:
    """The rows of the ``goals.k`` smallest keys of each window and stratum."""
    counts = keyed.groupBy("window_id", "stratum", "bucket").count()
    upto = Window.partitionBy("window_id", "stratum").orderBy("bucket")
    edges = counts.withColumn("upto", F.sum("count").over(upto)).join(goals, ["window_id", "stratum"])
    edges = edges.groupBy("window_id", "stratum", "k").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("k"), F.col("bucket"))), F.lit(BUCKETS + 1)).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("k"), F.col("upto"))), F.lit(0)).alias("below"),
    )
    marked = attach(keyed, materialize(edges), ["window_id", "stratum"], "inner")
    order = Window.partitionBy("window_id", "stratum").orderBy("draw_key", "record_id")
    partly = marked.where("bucket = edge").withColumn("place", F.row_number().over(order)).where("place <= k - below").drop("place")
    return marked.where("bucket < edge").unionByName(partly).drop("k", "edge", "below")


def _drawn(candidates: DataFrame, strata: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the sample, the raked cells)."""
    rows, cells = fitted_cells(candidates, strata)
    # The weight relative to the stratum's mean makes its keys follow one scale.
    mean = F.sum("fitted").over(Window.partitionBy("window_id", "stratum")) / F.sum("n").over(Window.partitionBy("window_id", "stratum"))
    weights = cells.select("window_id", "stratum", "band", "reasons", (F.col("fitted") / F.col("n")).alias("weight"), mean.alias("mean"))
    keyed = attach(rows, weights, ["window_id", "stratum", "band", "reasons"], "inner")
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "window_id", "record_id"), 256), 1, 13), 16, 10).cast("double")
    u = (digest + 0.5) / float(1 << 52)
    relative = F.when(F.col("mean") > 0, F.col("weight") / F.col("mean")).otherwise(F.lit(1.0))
    # A cell that raking emptied comes last, but comes if the stratum needs it.
    keyed = keyed.withColumn("draw_key", -F.log(u) / F.greatest(relative, F.lit(1e-12)))
    keyed = keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("draw_key"))) * BUCKETS).cast("int"))
    keyed = materialize(keyed.select("window_id", "stratum", "record_id", "band", "reasons", "weight", "draw_key", "bucket"))

    planned = cells.groupBy("window_id", "stratum").agg(F.max("planned").alias("k"))
    drawn = materialize(_smallest(keyed, planned))
    # Repair: what was drawn is counted, and strata below their minimum get their next rows.
    got = planned.join(drawn.groupBy("window_id", "stratum").agg(F.count("*").alias("got")), ["window_id", "stratum"], "left").na.fill(0, ["got"])
    floors = wanted_rows(strata).select("window_id", F.col("name").alias("stratum"), F.coalesce("min_rows", F.lit(0)).alias("k"))
    short = materialize(floors.join(got.select("window_id", "stratum", "got"), ["window_id", "stratum"]).where("got < k").select("window_id", "stratum", "k"))
    marked = drawn.withColumn("repaired", F.lit(False))
    if short.limit(1).count():
        more = _smallest(attach(keyed, short.select("window_id", "stratum"), ["window_id", "stratum"], "left_semi"), short)
        more = more.join(drawn.select("window_id", "stratum", "record_id"), ["window_id", "stratum", "record_id"], "left_anti")
        marked = marked.unionByName(more.withColumn("repaired", F.lit(True)))
    return marked.drop("bucket"), cells


def sample(candidates: DataFrame, strata: DataFrame, seed: int = SEED) -> DataFrame:
    """(window_id, stratum, record_id, weight, draw_key, repaired) of the selected rows; ``stratum`` in tidy spelling.

    Rows repeated whole and other spellings of a stratum are one; null windows, strata and
    identifiers take no part; ties of keys fall to the smaller identifier; a stratum without
    target gets nothing; empty tables give no rows.
    """
    return _drawn(candidates, strata, seed)[0].drop("band", "reasons")


def margins(candidates: DataFrame, strata: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per window, margin (stratum, band, reasons) and category: rows aimed at by raking, selected, and the residual."""
    taken, cells = _drawn(candidates, strata, seed)
    taken = materialize(taken.groupBy("window_id", "stratum", "band", "reasons").agg(F.count("*").alias("selected")))
    both = cells.join(taken, ["window_id", "stratum", "band", "reasons"], "left").na.fill(0, ["selected"])
    each = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in ("stratum", "band", "reasons")])
    sums = both.select("window_id", "fitted", "selected", F.inline(each)).groupBy("window_id", "margin", "category").agg(F.sum("fitted").alias("aimed"), F.sum("selected").alias("selected"))
    return sums.select("window_id", "margin", "category", F.round("aimed", 3).alias("aimed"), "selected", F.round(F.col("selected") - F.col("aimed"), 3).alias("residual"))


def report(candidates: DataFrame, strata: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per window and stratum: wanted, available and selected rows, what repair added, shares aimed at and reached, and the gap."""
    drawn, cells = _drawn(candidates, strata, seed)
    taken = drawn.groupBy("window_id", F.col("stratum").alias("name")).agg(F.count("*").alias("selected"), F.count_if("repaired").alias("repaired"))
    there = cells.groupBy("window_id", F.col("stratum").alias("name")).agg(F.sum("n").alias("available"), F.max("planned").alias("planned"))
    out = wanted_rows(strata).join(there, ["window_id", "name"], "left").join(taken, ["window_id", "name"], "left").na.fill(0, ["available", "selected", "repaired"])
    # A stratum without rows has no cells; its quota or share is wanted all the same.
    aimed = F.coalesce("planned", "quota", F.round(F.col("target_share") * F.col("total")).cast("bigint"), F.lit(0))
    out = out.withColumn("wanted", F.greatest(aimed, F.coalesce("min_rows", F.lit(0)), F.lit(0)))
    reached = F.round(F.try_divide(F.col("selected"), F.sum("selected").over(Window.partitionBy("window_id"))), 6)
    return out.select(
        "window_id", "stratum", "target_share", "min_rows", "quota", "wanted", "available", "selected", "repaired",
        F.coalesce(reached, F.lit(0.0)).alias("reached_share"),
        (F.col("wanted") - F.col("selected")).alias("gap"),
        (F.col("selected") >= F.coalesce("min_rows", F.lit(0))).alias("floor_met"),
    )


def short_strata(candidates: DataFrame, strata: DataFrame, seed: int = SEED) -> DataFrame:
    """(window_id, stratum) whose quota the sample could not fill."""
    return report(candidates, strata, seed).where("quota > selected").select("window_id", "stratum")
