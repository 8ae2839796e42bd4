"""Seeded order without random streams: md5 of ``id|salt`` is the same on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(row_id: Column | str, salt: int | str) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string") if isinstance(row_id, str) else row_id.cast("string"), F.lit(f"|{salt}")).cast("binary"))


def hash_int(row_id: Column | str, salt: int | str) -> Column:
    """The first 32 bits of the hash, as a bigint."""
    return F.conv(F.substring(hash_order(row_id, salt), 1, 8), 16, 10).cast("bigint")


def hash_unit(row_id: Column | str, salt: int | str) -> Column:
    """Uniform in [0, 1)."""
    return hash_int(row_id, salt) / F.lit(4294967296.0)
