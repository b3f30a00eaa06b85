"""The shortlist under four ordered caps, with a reason for every omission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.config import QUOTAS, Select
from gleanstone.errors import GleanstoneError
from gleanstone.session import materialize


def rank_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "record_id")


def quota_topk(scored: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """The rows within their stratum's quota, by score, then identifier."""
    quotas = {**QUOTAS, **(quotas or {})}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("stratum"))
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("score"), "record_id"))
    # The bound of the largest quota lets each task drop all but so many rows of a stratum before the shuffle.
    best = scored.withColumn("place", place).where(F.col("place") <= max(quotas.values()))
    return best.where(F.col("place") <= F.coalesce(limit, F.lit(0)))


def cluster_topk(scored: DataFrame, most: int = 1) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "record_id"))
    return scored.withColumn("place", place).where(F.col("place") <= most)


def orphans(left: DataFrame, right: DataFrame, key: str = "record_id") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def check_complete(records: DataFrame, other: DataFrame, what: str, key: str = "record_id") -> None:
    for a, b, text in ((records, other, f"records without {what}"), (other, records, f"{what} of unknown records")):
        if orphans(a, b, key).limit(1).count():
            raise GleanstoneError(text)


#: Rows fetched at once while the shortlist is filled.
FETCH = 2_000


def _taken(slim: DataFrame, quotas: dict[str, int], most: int, cap: int) -> list[tuple]:
    """The taken rows in order. Each fetch asks for the best rows that the caps so far leave open; at least one of them is taken."""
    taken: list[tuple] = []
    filled: dict[str, int] = {}
    used: dict[str, int] = {}
    last = None
    while len(taken) < cap:
        full = [c for c, n in used.items() if n >= most]
        open_strata = [t for t, q in quotas.items() if filled.get(t, 0) < q]
        rest = slim.where(~F.col("held") & F.col("stratum").isin(open_strata))
        if full:
            rest = rest.where(~F.coalesce(F.col("cluster_id").isin(full), F.lit(False)))
        if last is not None:
            rest = rest.where(F.struct(-F.col("score"), F.col("record_id")) > F.struct(F.lit(-last[1]), F.lit(last[0])))
        rows = rest.orderBy(F.desc("score"), "record_id").limit(FETCH).collect()
        for r in rows:
            last = (r["record_id"], r["score"])
            if used.get(r["cluster_id"], 0) >= most or filled.get(r["stratum"], 0) >= quotas.get(r["stratum"], 0):
                continue
            taken.append((r["record_id"], r["score"], r["stratum"], r["cluster_id"], len(taken) + 1))
            filled[r["stratum"]] = filled.get(r["stratum"], 0) + 1
            used[r["cluster_id"]] = used.get(r["cluster_id"], 0) + 1
            if len(taken) >= cap:
                break
        if len(rows) < FETCH:
            break
    return taken


def greedy_select(scored: DataFrame, settings: Select | None = None, max_candidates: int | None = None) -> DataFrame:
    """(record_id, rank, reason): rank of the taken, reason of the others (already_in_goldens, cluster_cap, quota:..., max_candidates).

    ``scored``: record_id, score, stratum, cluster_id and optionally held. In rank order the caps are tried one
    after the other and count only what was taken, so the taken rows, at most ``max_candidates``, decide
    everything: they are found by a few distributed top-k fetches, and each other row's reason follows
    from comparing its place with the taken row that filled its cluster, stratum or the list.
    """
    s = settings or Select()
    cap = s.max_candidates if max_candidates is None else max_candidates
    if cap < 1:
        raise GleanstoneError("at least one candidate must be allowed")
    spark, quotas = scored.sparkSession, dict(s.quotas)
    held = F.coalesce(F.col("held"), F.lit(False)) if "held" in scored.columns else F.lit(False)
    # Each fetch reads these rows again.
    slim = materialize(scored.select("record_id", F.coalesce(F.col("score"), F.lit(0)).cast("int").alias("score"), "stratum", "cluster_id", held.alias("held")))
    taken = _taken(slim, quotas, s.max_per_cluster, cap)
    chosen = spark.createDataFrame([(t[0], t[4]) for t in taken], "record_id string, rank int")
    cuts: dict[str, tuple] = {}
    per_cluster: dict[str, list] = {}
    per_stratum: dict[str, list] = {}
    for t in taken:
        per_cluster.setdefault(t[3], []).append(t)
        per_stratum.setdefault(t[2], []).append(t)
    for c, rows in per_cluster.items():
        if c is not None and len(rows) >= s.max_per_cluster:
            cuts[c] = rows[s.max_per_cluster - 1]
    full = spark.createDataFrame([(c, -t[1], t[0]) for c, t in cuts.items()], "cluster_id string, cut_score int, cut_id string")
    place = F.struct((-F.col("score")).alias("cut_score"), F.col("record_id").alias("cut_id"))
    after = lambda t: place > F.struct(F.lit(-t[1]).alias("cut_score"), F.lit(t[0]).alias("cut_id"))
    out = slim.join(F.broadcast(chosen), "record_id", "left").join(F.broadcast(full), "cluster_id", "left")  # both have at most max_candidates rows
    beyond_cluster = F.col("cut_id").isNotNull() & (place > F.struct("cut_score", "cut_id"))
    stratum_full = F.lit(False)
    for name, quota in quotas.items():
        rows = per_stratum.get(name, [])
        if quota == 0:
            stratum_full = stratum_full | (F.col("stratum") == name)
        elif len(rows) >= quota:
            stratum_full = stratum_full | ((F.col("stratum") == name) & after(rows[quota - 1]))
    stratum_full = stratum_full | ~F.col("stratum").isin(*quotas)
    reason = F.when(F.col("rank").isNotNull(), None).when(F.col("held"), "already_in_goldens").when(beyond_cluster, "cluster_cap").when(stratum_full, F.concat(F.lit("quota:"), "stratum")).otherwise("max_candidates")
    return out.select("record_id", "rank", reason.alias("reason"))


def stratum_accounts(chosen: DataFrame, scored: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """(stratum, quota, selected, unfilled) of every stratum."""
    quotas = {**QUOTAS, **(quotas or {})}
    rows = chosen.sparkSession.createDataFrame(list(quotas.items()), "stratum string, quota int")
    got = chosen.where("rank is not null").join(scored.select("record_id", "stratum"), "record_id").groupBy("stratum").agg(F.count("*").alias("selected"))
    out = rows.join(got, "stratum", "left").na.fill(0, ["selected"])
    return out.withColumn("unfilled", F.greatest(F.col("quota") - F.col("selected"), F.lit(0)))


def drop_accounts(chosen: DataFrame) -> DataFrame:
    return chosen.where("reason is not null").groupBy("reason").agg(F.count("*").alias("records"))


def exit_code(chosen: DataFrame) -> int:
    """2 if nothing was taken, 1 if the cap on all candidates cut the list, else 0."""
    row = chosen.agg(F.count("rank").alias("taken"), F.count_if(F.col("reason") == "max_candidates").alias("cut")).first()
    return 2 if not row["taken"] else 1 if row["cut"] else 0
