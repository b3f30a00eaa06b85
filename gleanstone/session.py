"""Session helpers: defaults, reliable materialisation and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of its values up to which it may be broadcast; rows alone say nothing of long texts.
BROADCAST_BYTES = 32_000_000
#: Repeated keys that are sent to the executors as a list.
ONCE_KEYS = 1_000
#: Rows of one key that a join leaves to one task in any case.
HOT_ROWS = 10_000


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanstone")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's reliable checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a local
    one is made only where none is configured and the master is local, as in tests.
    Unlike a local checkpoint the files survive the loss of executors.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gleanstone-"))
    return df.checkpoint(eager=True)


def broadcast_within(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``small`` for broadcast only after counting that it has at most ``max_rows`` rows."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def fair_share(rows: int, spark: SparkSession, least: int) -> int:
    """Rows that one task of a shuffle has if they spread evenly, but at least ``least``: what has more of one key is hot."""
    return max(least, rows // int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each ``key``. Keys are counted by themselves first: only rows whose key is there again are shuffled, if these keys may be broadcast."""
    again = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    keys = [r[0] for r in again.limit(ONCE_KEYS + 1).collect()]
    if not keys:
        return df
    if len(keys) > ONCE_KEYS:
        return df.dropDuplicates([key])
    among = F.coalesce(F.col(key).isin([k for k in keys if k is not None]), F.lit(None in keys))
    return df.where(~among).unionByName(df.where(among).dropDuplicates([key]))


def where_computed(df: DataFrame, condition) -> DataFrame:
    """Filter on computed columns without letting the optimizer copy their expressions below the projections.

    A filter is pushed through projections by substitution, which evaluates long
    expression chains twice or more; a projection that isn't deterministic stops that.
    """
    return df.withColumn("_fence", F.spark_partition_id()).where(condition & (F.col("_fence") >= 0)).drop("_fence")


def _small_enough(small: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``small`` has at most so many rows and bytes, counted over no more than one row too many."""
    width = [F.octet_length(c) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(c))) if "<" in kind or kind == "variant" else F.lit(8) for c, kind in small.dtypes]
    held = small.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum(sum((F.coalesce(w, F.lit(0)) for w in width), F.lit(0)).cast("bigint")).alias("bytes")).first()
    return held["rows"] <= max_rows and (held["bytes"] or 0) <= max_bytes


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = 16, hot_rows: int = HOT_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a side that is unique by ``keys``: broadcast while its counted rows and bytes allow, shuffled beyond.

    One key may hold a third of the big side's rows. Keys with more than a task's fair share, null among them, are counted
    first; their rows are salted over ``salts`` tasks and only their rows of the small side are copied, all others go once. The
    salt is a digest of the row, so that a task that runs again sends its rows where they went before.
    """
    if _small_enough(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), keys, how)
    per = big.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count("*").alias("n"))
    held = per.agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") > hot_rows, F.struct("h", "n"))).alias("large")).first()
    share = fair_share(held["rows"] or 0, big.sparkSession, hot_rows)
    hot = [x["h"] for x in held["large"] if x["n"] > share]
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, F.lit(salts - 1)).otherwise(F.lit(0)))))
    plain = [c for c, kind in big.dtypes if "map<" not in kind and "variant" not in kind]
    salted = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list[Column], within: list[str] | None = None, output: str = "n") -> DataFrame:
    """``df`` with the place, from 1, of each row in a total order of all rows (of each group of ``within``).

    Rows are cut into ranges; each range is ranked by itself and starts where the counts of the
    ranges before it end, so no task sorts all rows, nor all rows of a group.
    """
    within = within or []
    ranged = df.repartitionByRange(*[F.col(c) for c in within], *order)
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy(*within, "__range").agg(F.count("*").alias("__size"))  # a row per range and group that it touches
    before = Window.partitionBy(*within or [F.lit(1)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(*within, "__range").orderBy(*order))
    placed = attach(ranged.withColumn("__local", local), starts, [*within, "__range"])
    return placed.withColumn(output, F.col("__start") + F.col("__local")).drop("__range", "__start", "__local")


def running(df: DataFrame, within: list[str], order: str, value: str, output: str) -> DataFrame:
    """``df`` with the running sum of ``value`` up to each row in each group; (``within``, ``order``) is unique.

    Ranges sum by themselves and start from the sums of the ranges before, so no task takes a whole group.
    """
    ranged = materialize(df.repartitionByRange(*[F.col(c) for c in within], F.col(order)).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(*within, "__range").agg(F.sum(value).alias("__sum"))  # a row per range and group that it touches
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*within, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    local = F.sum(value).over(Window.partitionBy(*within, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    placed = attach(ranged.withColumn("__local", local), starts, [*within, "__range"])
    return placed.withColumn(output, F.col("__start") + F.col("__local")).drop("__range", "__start", "__local")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they need no copy of the repository."""
    import shutil
    from pathlib import Path

    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_gleanstone_shipped", None) is None:
        folder = tempfile.mkdtemp(prefix="gleanstone-")
        shutil.copytree(package, f"{folder}/zip/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/zip"))
        sc._gleanstone_shipped = True
