"""Joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / MOST of all rows, and at least LEAST rows, are split: fewer than MOST keys, so their list has a bound.
MOST, LEAST = 4096, 200_000


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row for each key and, in ``count``, how many of the rows have it.

    total: number of rows, or more. A hot key's rows are dealt into parts by a hash of the whole row, and its row of keyed is
    repeated for each part. ``how`` may be "left", for rows whose key keyed lacks. Only the list of hot keys, which is shorter than MOST, is broadcast.
    """
    if total <= LEAST:
        return rows.join(keyed, keys, how)
    limit = max(LEAST, total // MOST)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = keyed.where(F.col(count) > limit).select(*keys, parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), keys, "left")
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"), F.lit(0))
    copies = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.withColumn("_part", part).drop("_parts").join(copies, [*keys, "_part"], how).drop("_part")
