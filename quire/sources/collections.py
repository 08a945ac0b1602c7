"""One ordered collection out of many objects, without one task that holds them all.

Objects are range-partitioned and sorted, and every task writes its range as one JSON-lines part. A manifest names the
parts in order with the position of their first object; it is put in place last, by one rename, so a reader sees
the old collection or the new one, never a part of either, and parts of a writer that died are not read. Parts
laid end to end in the manifest's order are the whole collection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.records import read_records

MANIFEST = "folder string, part string, first bigint, n bigint, bytes bigint"
_NO_QUOTE = "\u0001"  # JSON escapes it: every line is one object


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_collection(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Write the rows of ``df`` as one collection of JSON objects in the order of ``order`` (ties: of their text), in place of
    the one at ``path``. Returns the manifest."""
    spark, path = df.sparkSession, path.rstrip("/")
    folder = f"parts-{uuid.uuid4().hex[:12]}"
    d = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                  F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    o = [f"_o{i}" for i in range(len(order))]
    d.repartitionByRange(*o).sortWithinPartitions(*o, "value").select("value").write.text(f"{path}/{folder}")
    parts = spark.read.text(f"{path}/{folder}").groupBy(F.col("_metadata.file_name").alias("part")).agg(
        F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part
    manifest = parts.select(F.lit(folder).alias("folder"), "part", F.coalesce(before, F.lit(0)).cast("bigint").alias("first"), "n", "bytes")
    manifest.coalesce(1).write.json(f"{path}/{folder}-manifest")
    fs, final = _fs(spark, f"{path}/manifest")
    fresh = _fs(spark, f"{path}/{folder}-manifest")[1]
    if fs.exists(final):
        fs.rename(final, _fs(spark, f"{path}/{folder}-before")[1])
    if not fs.rename(fresh, final):
        raise OSError(f"the manifest of {path} was not put in place")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, part, first, n, bytes) of the parts of a collection."""
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a collection with their 0-based ``position``."""
    m = read_manifest(spark, path)
    folder = m.select("folder").first()
    if folder is None:
        return spark.createDataFrame([], f"position bigint, {schema}")
    r = read_records(spark, f"{path.rstrip('/')}/{folder[0]}", glob="part-*", quote=_NO_QUOTE)
    r = r.withColumn("part", F.element_at(F.split("source_file", "/"), -1))
    j = r.join(m.select("part", "first").withColumnRenamed("first", "_first"), "part")
    return j.select((F.col("_first") + F.col("record_no")).alias("position"), F.from_json("text", schema).alias("_j")).select("position", "_j.*")
