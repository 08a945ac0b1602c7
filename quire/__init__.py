"""quire: build, score and report on multi-document QA benchmarks with Spark SQL.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column`` expression
builder in :mod:`quire.functions`). Nothing is collected to the driver.
"""

from quire.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
