"""File sources and sinks.

Reads take explicit schemas (no inference pass over the data), discover files
recursively with a glob filter, and carry the source path from ``_metadata``; order
is a column, never file order. Writes stay distributed (one file per task) unless a
single file is asked for. Scratch output goes under the shared folder named by
``spark.checkpoint.dir`` (see :func:`quire.session.checkpoint_dir`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.constants import TRACKER_DOCS, TRACKER_EXAMPLE, TRACKER_TABLE
from quire.session import checkpoint_dir

EXAMPLE_SCHEMA = schemas.EXAMPLE
CORRUPT = "_corrupt_record"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/quire-io/{name}-{uuid.uuid4().hex[:12]}"


def read_json_dir(spark: SparkSession, path: str, schema: str, multiline: bool = True,
                  glob: str = "*.json") -> DataFrame:
    """S1 + S3: every JSON file under ``path`` (recursively), with ``source_file``."""
    df = (spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).json(path))
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_json_tolerant(spark: SparkSession, path: str, schema: str, multiline: bool = True,
                       glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) — files (or lines) that do not decode do not
    fail the read; they come back in the second DataFrame with their text.

    Files are read as text (whole files when ``multiline``) and decoded with
    ``from_json``; validity is the strict JSON test of :func:`quire.operators.jsonops.is_json`.
    No corrupt-record column is involved, so either side can be queried on its own.
    """
    raw = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
           .text(path, wholetext=multiline)
           .select(F.col("_metadata.file_path").alias("source_file"), F.col("value")))
    from quire.operators.jsonops import is_json

    ok = is_json("value")
    good = raw.where(ok).select("source_file", F.from_json("value", schema).alias("_j")).select("source_file", "_j.*")
    bad = raw.where(~ok).select("source_file", F.col("value").alias(CORRUPT))
    return good, bad


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite",
               single_file: bool = False) -> None:
    """Write rows as JSON lines (partitioned by run columns when given). ``single_file`` is for small results; one
    ordered collection of any size is :func:`quire.sources.collections.write_collection` (S4)."""
    out = df.coalesce(1) if single_file else df
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Columnar write; ``mode`` is ``overwrite`` (rebuild) or ``append``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """Result tables as CSV with a header line."""
    df.write.mode(mode).option("header", header).csv(path)


def read_seed_tables(spark: SparkSession, path: str, delimiter: str = "#", glob: str = "*.csv") -> DataFrame:
    """``#``-delimited tables with a header line, one table per file, in table form (table_id, row_idx,
    header, cells, error).

    Files of any size are read by byte ranges, quoted line breaks included (:mod:`quire.sources.records`); tables
    may have different headers. The table id is the file path. A row longer than its header, or a record whose
    quote stays open, has ``error`` set and no cells; :func:`accepted_tables` leaves such tables out. Callers apply
    the size gate (F3) before any per-table work.
    """
    from quire.operators.tables import parse_records
    from quire.sources.records import read_records

    r = read_records(spark, path, glob).withColumnRenamed("source_file", "table_id")
    # the header is known where a file's first split is read; rows of its later splits fetch it by a join
    body = r.where("record_no > 0").withColumn("row_idx", F.col("record_no").cast("int"))
    here = body.where("first IS NOT NULL").select("table_id", "row_idx", F.col("first").alias("header_text"), "text", "closed")
    headers = r.where("record_no = 0").select("table_id", F.col("text").alias("header_text"))
    away = body.where("first IS NULL").join(headers, "table_id").select(*here.columns)
    rows = here.unionByName(away)
    return parse_records(rows, delimiter)


def accepted_tables(tables: DataFrame) -> DataFrame:
    """F8 for tables read row by row: the rows of tables without any error."""
    bad = tables.where("error IS NOT NULL").select("table_id").distinct()
    return tables.join(bad, "table_id", "left_anti").drop("error")


def tracker_for_write(df: DataFrame) -> DataFrame:
    """Tracker columns under their file headers."""
    return df.select(F.col("example_id").cast("string").alias(TRACKER_EXAMPLE),
                     F.col("table_validity").cast("int").alias(TRACKER_TABLE),
                     F.col("docs_validity").cast("int").alias(TRACKER_DOCS))


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Validity tracker CSV keyed by example id; a blank label is NULL (unlabelled)."""
    schema = f"`{TRACKER_EXAMPLE}` string, `{TRACKER_TABLE}` int, `{TRACKER_DOCS}` int"
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(F.col(TRACKER_EXAMPLE).alias("example_id"), F.col(TRACKER_TABLE).alias("table_validity"),
                     F.col(TRACKER_DOCS).alias("docs_validity"))


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Keyed append — new rows replace old rows with the same key, the rest are kept."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def filter_runs(runs: DataFrame, skip: DataFrame | None = None, include: DataFrame | None = None, key: str = "path") -> DataFrame:
    """the runs on the include list when one is given, else those not on the skip list.
    Lists are one-column frames; they may grow with the runs, so the planner decides how to join."""
    if include is not None:
        return runs.join(include.select(key).distinct(), key, "left_semi")
    return runs if skip is None else runs.join(skip.select(key).distinct(), key, "left_anti")


def run_params(path) -> list[Column]:
    """``.../{reasoning_type}/{model}/{prompt_type}_score.json`` -> run columns."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    return [F.element_at(parts, -3).alias("reasoning_type"), F.element_at(parts, -2).alias("model"),
            F.substring_index(name, "_", 1).alias("prompt_type")]


def run_path(root: str, validity: Column, dataset: Column) -> Column:
    """Run file path in the evaluation layout."""
    return F.concat_ws("/", F.lit(root), validity, dataset, F.col("reasoning_type"), F.col("model"),
                       F.concat(F.col("prompt_type"), F.lit("_score.json")))


def example_id_from_path(path) -> Column:
    """Parent folder, cut at the first ``.``, part after ``raw_data/``, ``/`` -> ``_``."""
    p = F.col(path) if isinstance(path, str) else path
    parent = F.regexp_replace(p, "/[^/]*$", "")
    cut = F.substring_index(parent, ".", 1)
    return F.replace(F.try_element_at(F.split(cut, "raw_data/"), F.lit(2)), F.lit("/"), F.lit("_"))


def rebuild_dataset(df: DataFrame, path: str, key: str, n_train: int = 1, seed=0) -> None:
    """S10 (rebuild): split with W1 and overwrite the dataset, partitioned by split."""
    from quire.operators.sampling import train_test_split

    out = train_test_split(df, key, n_train=n_train, seed=seed).withColumn("batch_id", F.lit(0).cast("bigint"))
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def append_to_dataset(df: DataFrame, path: str, batch_id: int) -> None:
    """S10 (append): new examples all go to the test split, tagged with their batch."""
    (df.withColumn("split", F.lit("test")).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
       .write.mode("append").partitionBy("split").parquet(path))


def read_dataset(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The dataset as of now: per (split, key) the row of the latest batch (an appended
    example replaces the test copy with the same id; a train copy stays)."""
    from quire.operators.completions import latest_per_key

    t = spark.read.parquet(path).withColumn("_k", F.struct("split", key))
    latest = latest_per_key(t.drop("split", key), "_k", "batch_id")
    return latest.select("_k.*", *[c for c in latest.columns if c not in ("_k", "batch_id")])
