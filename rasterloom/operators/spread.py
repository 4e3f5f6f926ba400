"""Equi-join that stays balanced when one key of the many-side carries most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_SLOT = 10_000


def hot_keys(
    many: DataFrame, keys: Sequence[str], rows_per_slot: int = ROWS_PER_SLOT
) -> DataFrame:
    """Keys with more than ``rows_per_slot`` rows and the number of slots each needs.

    There are at most rows / rows_per_slot of them.
    """
    return (
        many.groupBy(*keys)
        .count()
        .where(F.col("count") > rows_per_slot)
        .select(*keys, F.ceil(F.col("count") / rows_per_slot).cast("int").alias("_slots"))
    )


def spread_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], identity: Column, hot: DataFrame
) -> DataFrame:
    """Inner join of ``many`` with ``one`` on ``keys``.

    Rows of hot keys are cut into slots by a hash of ``identity``; only the ``one`` rows of those
    keys are repeated, once per slot. Spark picks the join with the hot keys by their size.
    """
    keys = list(keys)
    slots = F.coalesce(F.col("_slots"), F.lit(1))
    left = (
        many.withColumn("_identity", F.xxhash64(identity))
        .join(hot, keys, "left")
        .withColumn("_slot", F.pmod(F.col("_identity"), slots.cast("long")).cast("int"))
        .drop("_slots", "_identity")
    )
    right = (
        one.join(hot, keys, "left")
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1)))
        .drop("_slots")
    )
    return left.join(right, [*keys, "_slot"], "inner").drop("_slot")
