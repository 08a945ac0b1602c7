"""Content hashes and hash-derived deterministic randomness.

Randomness is a seeded SHA-256 ordering: it does not depend on partitioning or
input order, and Spark and DuckDB compute the same digests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["content_id", "seeded_hash", "hash_int32", "hash_choice"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_id(text, n: int = 10) -> Column:
    """First ``n`` hex digits of SHA-1 of the text."""
    return F.substring(F.sha1(_c(text).cast("string")), 1, n)


def seeded_hash(seed, *parts) -> Column:
    """SHA-256 hex of ``seed || part1 || ...`` (a stable random key)."""
    cols = [F.lit(str(seed))] + [_c(p).cast("string") for p in parts]
    return F.sha2(F.concat(*cols), 256)


def hash_int32(hex_digest) -> Column:
    """First 8 hex digits of a digest as a non-negative BIGINT (0 .. 2^32-1)."""
    return F.conv(F.substring(_c(hex_digest), 1, 8), 16, 10).cast("bigint")


def hash_choice(hex_digest, lo: int, hi: int) -> Column:
    """A hash-derived integer in ``[lo, hi]``."""
    return F.lit(lo) + F.pmod(hash_int32(hex_digest), F.lit(hi - lo + 1))
