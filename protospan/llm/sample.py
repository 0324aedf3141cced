"""Bounded samples of rows for fitting, alike on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows whose key, then whose content, has the least hashes; all rows if there are fewer.

    Only hashes reach the driver. Of equal rows at the bound as many are taken as it leaves room for.
    """
    order = F.struct(F.xxhash64(F.lit("sample"), F.col(key)).alias("k"), F.xxhash64(*rows.columns).alias("c"))
    least = [r[0] for r in rows.select(order.alias("h")).orderBy("h").limit(most + 1).collect()]
    if len(least) <= most:
        return rows
    held = rows.filter(order <= F.struct(F.lit(least[most - 1].k).alias("k"), F.lit(least[most - 1].c).alias("c")))
    # Rows beyond the bound are equal to the last one.
    return held if least[most - 1] != least[most] else held.orderBy(order).limit(most)
