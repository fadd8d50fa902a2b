"""Joining rows to their workspace when one workspace may own a third of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARES = 1024


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table as JSON text, from one aggregate over it."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    size = df.agg(F.sum(F.octet_length(F.to_json(row)).cast("bigint")).alias("n")).first()["n"]
    return size or 0


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    on: Sequence[str],
    *,
    spread_by: Sequence[str],
    weight: Column | None = None,
    how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
    measured: int | None = None,
) -> DataFrame:
    """Joins facts to a dimension with one row per key, whatever the sizes.

    The dimension is measured first, unless the caller knows its size (``measured``). Up to ``broadcast_bytes`` it is broadcast and the
    facts do not move. Beyond that both sides are shuffled on the key, and a key that
    holds more than 1/``HOT_SHARES`` of the total weight is split into one share per
    such portion: its facts go to shares by the hash of ``spread_by``, its dimension
    row is repeated once per share. Fewer than ``HOT_SHARES`` keys can be that heavy,
    which bounds both the broadcast list of hot keys and the repeated rows.
    """
    keys = list(on)
    if (measured_bytes(dimension) if measured is None else measured) <= broadcast_bytes:
        return facts.join(F.broadcast(dimension), keys, how)

    load = facts.groupBy(*keys).agg(F.sum(F.lit(1) if weight is None else weight).cast("double").alias("_load"))
    total = load.agg((F.sum("_load") / F.lit(HOT_SHARES)).alias("_portion"))
    hot = (
        load.where(F.col("_load") > total.scalar())
        .select(*keys, F.ceil(F.col("_load") / total.scalar()).cast("int").alias("_shares"))
    )
    hot = F.broadcast(hot)
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    spread = (
        facts.join(hot, keys, "left")
        .withColumn("_share", F.pmod(F.xxhash64(*spread_by), shares).cast("int"))
        .drop("_shares")
    )
    repeated = (
        dimension.join(hot, keys, "left")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
        .drop("_shares")
    )
    return spread.join(repeated, [*keys, "_share"], how).drop("_share")
