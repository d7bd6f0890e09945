"""Seeded pseudo-random order from stable keys.

``md5('seed:key')`` gives every row the same place whatever the partitioning, the cluster size or a
task's second attempt, and any SQL engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKET_DIGITS = 3
BUCKETS = 16**BUCKET_DIGITS


def seeded_hash(*parts: Column | int | str) -> Column:
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def hash_bucket(hashed: Column) -> Column:
    """First hex digits: 4,096 buckets of about the same size."""
    return F.substring(hashed, 1, BUCKET_DIGITS)


def hash_position(hashed: Column, size: Column) -> Column:
    """A place in ``0 .. size-1`` from the first 60 bits."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") % size
