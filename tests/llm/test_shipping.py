"""Executors need no installed copy: worker-side code travels by value."""

import os
import pickle
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_queries_run_from_another_directory(tmp_path, edge_dir):
    """Every query and the pipeline, by a driver started elsewhere with a plain session."""
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
     .config("spark.sql.warehouse.dir", {str(tmp_path / "warehouse")!r}).config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
for name, query in m.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(s, {edge_dir!r}).write.format("noop").mode("overwrite").save()
        print("done", name)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    from quire.llm import queries
    assert r.returncode == 0, r.stderr[-3000:]
    assert set(r.stdout.split()) - {"done"} == set(queries.QUERIES) | {"pipeline"}


def test_workers_unpickle_without_the_package():
    """What a worker gets can be read where the package is not."""
    from pyspark import cloudpickle

    from quire.llm import lloyd, neardup, periods, substrings
    sent = [neardup.shortened, neardup.sketch, neardup.similar, neardup._sketches(4, 0.8), periods._worker(12, True, True),
            lloyd._resident([], None), lloyd._integers(16, 256), substrings._count(13, 2)]
    blobs = [cloudpickle.dumps(f) for f in sent]
    code = "import sys, pickle\nfor b in pickle.load(sys.stdin.buffer): pickle.loads(b)\nassert 'quire.llm' not in sys.modules\nprint('OK')"
    r = subprocess.run([sys.executable, "-I", "-c", code], input=pickle.dumps(blobs), capture_output=True, timeout=120)
    assert r.returncode == 0 and b"OK" in r.stdout, r.stderr[-2000:]
