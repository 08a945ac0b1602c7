"""Named query plans over the test tables, and their independent SQL oracles."""

from quire.plans.catalog import FLAGSHIP, QUERIES
from quire.plans.oracle import ORACLE
from quire.plans import q_logs, q_prompts, q_sources, q_tables  # noqa: F401  (registers queries)

__all__ = ["QUERIES", "ORACLE", "FLAGSHIP"]
