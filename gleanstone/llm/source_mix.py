"""Mixing sources to target weights, with repetition caps and the shares reached.

Sizes are tokens of a public tokenizer. A source of weight w is to give w x total
tokens: some whole passes over its documents and one partial pass, at most
``max_repeats`` uses of any document. Documents of a source fall, by a digest,
into blocks. Which blocks go to which output shard is decided by a splitting tree
that halves the shards again and again and draws how many blocks of each source go
left from the multivariate hypergeometric distribution, so every shard's quota is
exact and sources mix as if all blocks had been shuffled. The driver draws the
upper levels, down to at most ``SUBTREES`` subtrees, from one number per source;
the lower levels are drawn per subtree on the executors. Nothing on the driver
grows with documents, tokens, blocks or shards. Each shard takes its quota from a
permutation of the source's blocks, disjoint from the others', and orders its
documents locally.

The one block in which a partial pass ends is cut exactly: its documents in
digest order up to the wanted size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.llm.bpe import token_counts
from gleanstone.session import attach, materialize

#: Fewest blocks of a source and shards; both grow with the tokens, so that a shard keeps a size that sorts in one task.
BLOCKS = 256
SHARDS = 16
SHARD_TOKENS = 1 << 28
SEED = 20260106
#: Subtrees that the driver deals to.
SUBTREES = 256


def split_quotas(quotas: np.ndarray, sizes: list[int], rng: np.random.Generator) -> np.ndarray:
    """Distributes ``quotas[s]`` units of each source over parts of ``sizes`` shards: rows are parts, columns sum to the quotas exactly."""
    if len(sizes) == 1:
        return quotas[None, :]
    middle = len(sizes) // 2
    share = int(round(quotas.sum() * sum(sizes[:middle]) / sum(sizes)))
    # Of all units in random order, the left part's draw: as many of each source as this distribution gives.
    drawn = rng.multivariate_hypergeometric(quotas, share, method="marginals") if quotas.sum() else np.zeros_like(quotas)
    return np.vstack([split_quotas(drawn, sizes[:middle], rng), split_quotas(quotas - drawn, sizes[middle:], rng)])


USES = "source string, pass int, block int, shard int, keep double"


def _deal_subtree(sizes: list[int], seed: int):
    """Deals one subtree's units to its shards."""
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def deal(units: pd.DataFrame) -> pd.DataFrame:
        subtree = int(units["subtree"].iloc[0])
        rng = np.random.default_rng([seed, subtree])
        units = units.sort_values(["source", "pass", "block"]).reset_index(drop=True)
        names, codes = np.unique(units["source"].to_numpy(str), return_inverse=True)
        dealt = split_quotas(np.bincount(codes, minlength=len(names)).astype(np.int64), [1] * sizes[subtree], rng)
        shard = np.empty(len(units), dtype=np.int64)
        for k in range(len(names)):
            shard[rng.permutation(np.flatnonzero(codes == k))] = np.repeat(np.arange(len(dealt)), dealt[:, k])
        return units.assign(shard=shard + starts[subtree])[["source", "pass", "block", "shard", "keep"]]

    return deal


def _uses(blocks: DataFrame, wish: dict[str, tuple[float, int]], total: float, shards: int, seed: int) -> DataFrame:
    """Rows of ``USES``: every block used, once per pass; ``keep`` is null where it is used whole. ``blocks``: source, block, n."""
    spark = blocks.sparkSession
    there = {r["source"]: float(r["n"]) for r in blocks.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a number per listed source
    plan = []
    for source, (weight, cap) in sorted(wish.items()):
        held = there.get(source, 0.0)
        if held > 0 and weight > 0 and cap > 0:
            want = min(weight * total, cap * held)
            passes = min(int(want / held + 1e-9), cap)
            plan.append((source, passes, want - passes * held if passes < cap else 0.0))
    mine = blocks.join(F.broadcast(spark.createDataFrame(plan, "source string, passes int, rest double")), "source")
    whole = mine.where("passes > 0").select("source", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"), "block", F.lit(None).cast("double").alias("keep"))
    # Blocks, not documents, in random order: so many millions of tokens each.
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    partial = mine.where("rest > 0.5").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < rest")
    partial = partial.select("source", F.col("passes").alias("pass"), "block", F.when(F.col("before") + F.col("n") > F.col("rest"), F.col("rest") - F.col("before")).alias("keep"))
    units = whole.unionByName(partial)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "pass", "block"), "pass", "block"))
    units = materialize(units.withColumn("place", place))

    counts = {r["source"]: r["count"] for r in units.groupBy("source").count().collect()}  # a number per listed source
    names, parts = sorted(counts), min(shards, SUBTREES)
    sizes = [shards // parts + (g < shards % parts) for g in range(parts)]
    dealt = split_quotas(np.array([counts[s] for s in names], dtype=np.int64), sizes, np.random.default_rng(seed))
    cuts = spark.createDataFrame([(s, np.cumsum(dealt[:, k])[:-1].tolist()) for k, s in enumerate(names)], "source string, cuts array<bigint>")
    placed = units.join(F.broadcast(cuts), "source").withColumn("subtree", F.size(F.filter("cuts", lambda c: c < F.col("place"))))
    return placed.select("subtree", "source", "pass", "block", "keep").groupBy("subtree").applyInPandas(_deal_subtree(sizes, seed), USES)


def sized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, order_key) of documents with tokens, each doc_id and source once."""
    known = docs.where("source is not null and doc_id is not null")
    counted = token_counts(known, ["doc_id", "source"], path=path).where("n_tokens > 0")
    once = counted.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    return once.withColumn("order_key", F.xxhash64(F.lit(SEED), F.col("doc_id")))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, shards: int | None = None, seed: int = SEED, path: str | None = None) -> DataFrame:
    """(shard, position, doc_id, source, pass, n_tokens): the mixture, one row per use of a document.

    ``total_tokens`` defaults to what the listed sources hold once. Documents without source or
    tokens, unlisted sources and sources that do not exist give nothing; a null weight or cap counts
    as 0; a source listed twice counts once. Empty tables give no rows.
    """
    spark = docs.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("w"), F.max("max_repeats").alias("r"))
    # The list of sources to mix is a parameter table, read whole on purpose.
    wish = {r["source"]: (float(r["w"] or 0.0), int(r["r"] or 0)) for r in goals.collect()}
    rows = materialize(attach(sized(docs, path), goals.select("source"), ["source"], "left_semi"))
    total = _total(rows, total_tokens)
    shards = shards or max(SHARDS, math.ceil(total / SHARD_TOKENS))
    rows = rows.withColumn("block", F.pmod("order_key", F.lit(max(BLOCKS, 4 * shards))).cast("int"))
    uses = materialize(_uses(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), wish, total, shards, seed))
    # Several passes use a block: collected first, so that the side is unique by block.
    per_block = uses.groupBy("source", "block").agg(F.collect_list(F.struct("pass", "shard", "keep")).alias("uses"))
    used = attach(rows, per_block, ["source", "block"], "inner").select("doc_id", "source", "n_tokens", "order_key", "block", F.inline("uses"))
    whole = used.where("keep is null")
    running = F.sum("n_tokens").over(Window.partitionBy("source", "block", "pass").orderBy("order_key", "doc_id"))
    cut = used.where("keep is not null").withColumn("upto", running).where("upto <= keep").drop("upto")
    chosen = whole.unionByName(cut)
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "pass", "doc_id"), "doc_id", "pass")
    return chosen.withColumn("position", F.row_number().over(local)).select("shard", "position", "doc_id", "source", "pass", "n_tokens")


def _total(rows: DataFrame, total_tokens: float | None) -> float:
    return float((rows.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0) if total_tokens is None else total_tokens)


def shares(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, path: str | None = None) -> DataFrame:
    """Per listed source: weight and tokens aimed at, tokens used, shares of what came together and of what was wanted, most uses of a document, and why they differ."""
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    known = materialize(attach(sized(docs, path), goals.select("source"), ["source"], "left_semi"))
    total = _total(known, total_tokens)
    mixed = mix(docs, targets, total, path=path)
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    held = known.groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"))
    out = goals.join(held, "source", "left").join(got, "source", "left").na.fill(0, ["held_tokens", "tokens", "most_uses", "documents"])
    out = out.withColumn("wanted_tokens", F.coalesce("target_weight", F.lit(0.0)) * total)
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per listed source
    share = F.coalesce(F.round(F.col("tokens") / all_tokens, 6), F.lit(0.0))
    capped = F.col("wanted_tokens") > F.col("held_tokens") * F.coalesce("max_repeats", F.lit(0))
    reason = F.when(F.col("wanted_tokens") <= 0, None).when(F.col("held_tokens") == 0, "no documents").when(capped, "repetition cap").when(share > F.col("target_weight") + 1e-4, "other sources fall short")
    return out.select(
        "source", "target_weight", "max_repeats", "documents", "tokens", F.round("wanted_tokens").cast("bigint").alias("wanted_tokens"), "most_uses", share.alias("reached_share"),
        F.round(share - F.col("target_weight"), 6).alias("gap"), F.coalesce(F.round(F.try_divide(F.col("tokens"), F.lit(total)), 6), F.lit(0.0)).alias("share_of_wanted"), reason.alias("missed_because"),
    )
