"""Exact dedup against a persistent digest index.

The index is a table of text digests, bucketed and sorted by digest, in a folder that outlives the session. A
batch of documents is reduced to one row per digest (combined before the shuffle), sort-merge anti-joined with the
index, whose buckets are read where they lie, and what is new is appended to them. Each entry holds the digest,
the doc_id that stays for it and the batch that brought it.

Texts are equal when identical after lower-casing A-Z only; the digest is SHA-256 of the UTF-8 bytes. Within a
batch the row with the largest doc_id stays; a text that an earlier batch brought stays with that batch's row.
So a table is deduplicated to its largest ids by ingesting it in descending ranges of doc_id.

Restarts: a batch has a name, and entries of the same name are its own. A batch that is ingested again after its
entries were committed appends nothing and gets the same verdicts. :func:`compact` rewrites the index with
one sorted file per bucket under a new folder; the old one stays until its owner deletes it.

Scale: texts are read once, where they are hashed; only digests and ids (about 45 bytes a document) are shuffled. The
index is never shuffled: a batch's distinct digests are dealt to the index's buckets. Rows of a text that
holds more than 1/4096 of a batch get their verdict map-side, from a broadcast of at most 4,096 entries.

Defined results: a null text is the empty text; a null doc_id is smaller than any other; of rows equal in doc_id
and text one stays; an empty table gives no rows and appends nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.frames import attach, pick, scratch_path, shuffle_partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BUCKETS = 4096


class DigestIndex:
    """A digest index in the folder ``path``: opened if it is there, else created with ``buckets`` buckets
    (default: the shuffle partitions, at most 4,096). ``id_type`` is the type of document ids."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        facts = self._facts()
        if facts is None:
            self.buckets = buckets or min(max(1, shuffle_partitions(spark)), MAX_BUCKETS)
            self.id_type = id_type
            spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").coalesce(1).write.json(f"{self.path}/about")
        else:
            self.buckets, self.id_type = facts
        self.table = f"quire_digests_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'")

    def _facts(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/about/_SUCCESS")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return None
        row = self.spark.read.schema("buckets int, id_type string").json(f"{self.path}/about").first()
        return row.buckets, row.id_type

    def entries(self) -> DataFrame:
        """(digest, keep_id, batch), one row per text."""
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Add entries. Each bucket gets one sorted file."""
        (fresh.select("digest", F.col("keep_id").cast(self.id_type).alias("keep_id"), "batch").repartition(self.buckets, "digest")
              .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
              .option("path", f"{self.path}/entries").saveAsTable(self.table))

    def ingest(self, digests: DataFrame, batch: str) -> int:
        """Append what is new in ``digests`` (see :func:`digests`), by a sort-merge anti-join. Returns the entries
        appended."""
        known = self.entries()
        # written first: the optimizer would move the anti-join below the aggregation, and shuffle every row of a text
        texts = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id")), "digest_batch")
        new = texts.join(known.select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        before = known.count()
        self.append(new)
        self.spark.catalog.refreshTable(self.table)
        return self.entries().count() - before

    def verdicts(self, digests: DataFrame, batches: list[str]) -> DataFrame:
        """Per row of ``digests``, all ingested as ``batches``: doc_id, keep_id (the row that stays; of an earlier
        batch where that one brought the text), group_size (rows of ``digests`` with the text), kept, text_sha256."""
        groups = digests.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("_best"))
        entries = self.entries().select("digest", "keep_id", F.col("batch").isin(batches).alias("_own")).hint("merge")
        groups = written(groups.join(entries, "digest").select(
            "digest", "group_size", "keep_id", F.when(F.col("_own"), F.col("_best.row")).alias("_stays")), "digest_groups")
        total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        return attach(digests, groups, "digest", "group_size", total).select(
            "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("_stays"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, path: str) -> "DigestIndex":
        """The same index in a new folder, one sorted file per bucket."""
        out = DigestIndex(self.spark, path, self.buckets, self.id_type)
        out.append(self.entries())
        return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, row, digest) of every row, written to the shared folder; ``row`` tells equal rows apart."""
    d = pick(docs, "doc_id", "text")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return written(d.select("doc_id", F.monotonically_increasing_id().alias("row"),
                            F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All of ``docs`` through an index that starts empty: the upper half of the id range first, then the rest,
    so that the largest id of every text stays."""
    spark = docs.sparkSession
    rows = digests(docs)
    index = DigestIndex(spark, path or scratch_path(spark, "digest_index"), id_type=rows.schema["doc_id"].dataType.simpleString())
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        cut = low + (high - low) // 2
        index.ingest(rows.where(F.col("doc_id") > cut), "upper")
        index.ingest(rows.where(F.col("doc_id").isNull() | (F.col("doc_id") <= cut)), "lower")
    else:
        index.ingest(rows, "lower")
    return index.verdicts(rows, ["upper", "lower"])
