"""Session helpers.

The session is configured for a cluster first: adaptive execution re-plans joins
from runtime sizes (so a broadcast only happens after the planner has measured the
side), skew-join splitting is on, and timestamps are UTC so results agree with the
DuckDB oracle.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "quire", extra: dict | None = None) -> SparkSession:
    """Create or reuse a session with the engine defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared folder and is only read here.
    When it is unset and the session is local (tests, benches), a fresh folder
    under the system temp directory is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="quire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


#: intermediate tables by application
_SCRATCH: dict[str, list[str]] = {}


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote with :func:`materialize`; frames that
    read them end with it. Returns their number."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


#: buckets of a stored table, whatever the number of shuffle partitions
MAX_BUCKETS = 4096


def materialize(df, name: str = "table", bucket_by: list[str] | None = None, buckets: int | None = None):
    """Cut lineage: write ``df`` as a parquet table in the shared checkpoint folder and
    read it back.

    Used where one intermediate feeds several readers: it is computed once, readers get a
    columnar table (with pushdown and pruning), and a lost executor restarts from the
    table instead of the whole plan. With ``bucket_by`` the table is bucketed (and sorted)
    on those columns: later joins on them against a table bucketed the same way run
    without a shuffle on either side. The bucketed table is an external table whose files
    live in the same shared folder.
    """
    import uuid

    spark = df.sparkSession
    tag = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/quire-tables/{tag}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    if not bucket_by:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    n = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    # one task writes one bucket: as many files as buckets
    (df.repartition(n, *bucket_by).write.mode("overwrite").format("parquet").option("path", path)
       .bucketBy(n, *bucket_by).sortBy(*bucket_by).saveAsTable(f"quire_{tag}"))
    return spark.table(f"quire_{tag}")


def cluster_conf(input_bytes: int, executor_memory_bytes: int = 16 << 30, executor_cores: int = 4,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized so that the widest shuffle (at most about the input,
    since text columns are pruned and aggregations combine map-side) lands near
    ``target_partition_bytes`` per partition, and a task's share of executor memory holds
    several such partitions before spilling; adaptive execution then coalesces the small
    shuffles (reports, histograms) down to a few partitions and splits skewed ones.
    Pass the result as ``extra`` to :func:`get_spark`.
    """
    per_task = executor_memory_bytes // max(executor_cores, 1)
    part = min(target_partition_bytes, max(per_task // 4, 32 << 20))
    # at most 100k shuffle partitions (shuffle metadata grows with mappers x reducers):
    # beyond that the partitions grow instead, up to half a task's memory share
    part = min(max(part, -(-input_bytes // 100_000)), max(per_task // 2, part))
    shuffle_partitions = max(200, -(-input_bytes // part))
    return {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(part),
        "spark.sql.files.maxPartitionBytes": str(min(part, 512 << 20)),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * part),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
