"""Grid cells that fail alone.

Each cell of an experiment grid is a job of its own: it runs on its own thread under its own tag, its rows are written
when it ends, and a cell that fails leaves a row in the error table while the others go on. The folder keeps what is
done: a second run computes only the cells without rows, so a driver that was lost goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

#: cells that run at the same time
PARALLEL = 4
REASON_CHARS = 500


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def reason_of(e: BaseException) -> str:
    """The message of an error without class paths and stacks: what the failed expression or function said."""
    text = str(e)
    for mark in ("[USER_RAISED_EXCEPTION] ", "org.apache.spark.SparkRuntimeException: "):
        if mark in text:
            text = text[text.index(mark) + len(mark):]
    return text.strip().split("\n")[0][:REASON_CHARS].removesuffix(" SQLSTATE: P0001")


def run_cells(spark: SparkSession, cells: Mapping[str, Callable[[], DataFrame]], path: str, schema: str,
              parallel: int = PARALLEL) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): the rows (cell, .. ``schema``) of the cells that ended, and (cell, error, reason) of those that
    failed. ``cells`` gives a frame of that schema per name; frames are built inside their thread, so a cell may also
    fail while it is planned. Results are folders below ``path``."""
    folder = lambda name: f"{path.rstrip('/')}/cell={quote(name, safe='')}"

    def run(name: str):
        sc = spark.sparkContext
        sc.addJobTag(f"cell-{quote(name, safe='').replace(',', '%2C')}")
        try:
            if not _exists(spark, f"{folder(name)}/_SUCCESS"):
                cells[name]().write.mode("overwrite").parquet(folder(name))
            return None
        except Exception as e:  # noqa: BLE001  (a failed cell is a row of the error table)
            return name, type(e).__name__, reason_of(e)
        finally:
            sc.clearJobTags()

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), name) for name in cells]
        failed = [r for r in (j.result() for j in jobs) if r is not None]
    bad = {name for name, *_ in failed}
    rows = None
    for name in cells:
        if name not in bad:
            part = spark.read.schema(schema).parquet(folder(name)).select(F.lit(name).alias("cell"), "*")
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], f"cell string, {schema}")
    return rows, spark.createDataFrame(failed, "cell string, error string, reason string")
