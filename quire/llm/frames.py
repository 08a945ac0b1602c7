"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quire.session import checkpoint_dir


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name and by position, so that extra columns whose names
    differ only in case, or repeat, are no obstacle. The first exact match is taken."""
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_c{df.columns.index(n)}").alias(n) for n in names])


def unpick(df: DataFrame, columns: list[str]) -> DataFrame:
    """Give the columns of ``df`` these names, by position."""
    return df.toDF(*columns)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-llm/{name}_{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as a table in the shared folder and read it back, so that a lost
    executor restarts from the table and several readers share one computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))



def ordered(df: DataFrame, order: list, name: str, index: str = "_index") -> DataFrame:
    """``df`` with a dense 0-based ``index`` in the given order, written to the shared folder.

    Rows are range-partitioned and numbered within their partition, so no task sees them all; the
    offsets are one row per partition. Pass narrow columns: this sorts and writes them.
    """
    spark = df.sparkSession
    n = max(1, shuffle_partitions(spark))
    at = F.monotonically_increasing_id()  # partition number above bit 33, row number below
    t = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                  .withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), name)
    counts = t.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (t.join(F.broadcast(before), "_part")  # at most one row per shuffle partition
             .withColumn(index, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))


#: a key with more than this part of all rows is joined map-side; there are at most so many of them
HOT_KEYS = 4096


def attach(df: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``df`` with the columns of ``groups`` (one row per non-null ``key``, ``n`` rows of ``df`` have it; ``total``
    is their sum). Keys that hold more than ``total / HOT_KEYS`` rows are at most ``HOT_KEYS``, so their groups
    are broadcast and their rows are not shuffled; no task of the other join gets more rows of one key than that."""
    hot = groups.where(F.col(n) > total // HOT_KEYS)
    names = hot.select(F.col(key).alias("_hot"))
    rest = df.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti")
    return (df.join(F.broadcast(hot), key)
              .unionByName(rest.join(groups.where(F.col(n) <= total // HOT_KEYS), key)))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (node, component), the component being its
    smallest node. Alternating large-star and small-star rounds; each round is written to the shared
    folder, hubs are split by adaptive execution, and only a checksum comes to the driver.
    Nodes without edges do not appear."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    for _ in range(max_rounds):
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last or mark[0] == 0:
            return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
                     .union(e.select(F.col("b"), F.col("b")).distinct()))
        last = mark
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
