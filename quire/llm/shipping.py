"""Send worker-side functions by value, so that executors need no installed package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Pickle what ``module`` defines by value. Worker-side modules import only each other and
    third-party libraries, so their whole closure travels."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
