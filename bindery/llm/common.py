"""What the operators share: picking input columns, attaching class rows, shared files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.operators.joins import BROADCAST_BYTES, measured_bytes

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEAVY_SHARES = 1024


# Texts are long: rows go to Python by size. Spark's own bound is the second value.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "4m", "67108864b"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the size of Arrow batches, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_CONF, None) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def pick(df: DataFrame, **columns: str | tuple[str, str]) -> DataFrame:
    """Only the named input columns, under the operator's own names and types.

    Extra columns of the input, whatever they are called, are left behind here, so they
    cannot clash with names an operator makes.
    """
    bounded_batches(df.sparkSession)
    out = []
    for name, given in columns.items():
        column, kind = given if isinstance(given, tuple) else (given, None)
        found = df[f"`{column}`"]
        out.append((found.cast(kind) if kind else found).alias(name))
    return df.select(*out)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def attach(facts: DataFrame, classes: DataFrame, keys: list[str], values: list[str], rows_in: str, total: int, spread: str) -> DataFrame:
    """Left-joins facts to classes that own very unequal shares of the facts.

    ``classes`` has one row per key and tells in ``rows_in`` how many facts it owns.
    Fewer than ``HEAVY_SHARES`` classes can own more than 1/``HEAVY_SHARES`` of the
    ``total``; those are broadcast and their facts stay where they are in the first
    join. In the second they carry a null key, which matches nothing, and a hash of
    ``spread`` in place of the hash of the key, which deals them out evenly.
    """
    heavy = classes.where(F.col(rows_in) * F.lit(HEAVY_SHARES) > F.lit(total))
    light = classes.where(F.col(rows_in) * F.lit(HEAVY_SHARES) <= F.lit(total))
    heavy = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values], F.lit(True).alias("_h")))
    first = facts.join(heavy, [facts[k] == heavy[f"_h_{k}"] for k in keys], "left")
    dealt = F.when(F.col("_h"), F.xxhash64(F.lit("deal"), F.col(spread))).otherwise(F.xxhash64(*keys))
    first = first.withColumn("_deal", dealt)
    for k in keys:
        first = first.withColumn(f"_k_{k}", F.when(F.col("_h").isNull(), F.col(k)))
    light = light.select(F.xxhash64(*keys).alias("_l_deal"), *[F.col(k).alias(f"_l_{k}") for k in keys], *[F.col(v).alias(f"_l_{v}") for v in values])
    on = [first["_deal"] == light["_l_deal"], *[first[f"_k_{k}"] == light[f"_l_{k}"] for k in keys]]
    both = first.join(light, on, "left")
    return both.select(*[F.col(c) for c in facts.columns], *[F.coalesce(F.col(f"_h_{v}"), F.col(f"_l_{v}")).alias(v) for v in values])


def join_small(facts: DataFrame, rows: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins rows that are mostly few, one per key, to wide facts.

    They are broadcast up to ``BROADCAST_BYTES`` of measured size, so the facts stay where
    they are; beyond that both sides are shuffled on the keys, which no two rows share.
    """
    return facts.join(F.broadcast(rows) if measured_bytes(rows) <= BROADCAST_BYTES else rows, keys, how)


def row_key(text: Column) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(text.cast("string"))


def leave_out(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """The rows whose id and text are not those of a row of ``gone (doc_id, row_key)``, all columns as given."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(whole, docs[f"`{id_col}`"].alias("id"), row_key(docs[f"`{text_col}`"]).alias("key"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    gone = F.broadcast(gone) if measured_bytes(gone) <= BROADCAST_BYTES else gone
    return rows.join(gone, [rows["key"] == gone["gone_key"], rows["id"].eqNullSafe(gone["gone_id"])], "left_anti").select("row.*")
