"""Delivering packs: outcome columns and the write itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.text import format_count
from bindery.operators.joins import join_dimension

DELIVERED, CANCELLED, FAILED = "delivered", "cancelled", "failed"
EMPTY_REASON = "nothing to copy"


def delivery_outcomes(released: DataFrame, held: DataFrame) -> DataFrame:
    """``workspace, outcome, detail`` of every pack.

    An empty document is refused. A pack its reviewer turned down is cancelled, which
    is not a failure.
    """
    empty = F.col("document_bytes") == 0
    detail = F.concat(
        F.col("file_count").cast("string"),
        F.lit(" file(s), about "),
        format_count(F.col("total_tokens")),
        F.lit(" tokens"),
    )
    sent = released.select(
        "workspace",
        F.when(empty, FAILED).otherwise(DELIVERED).alias("outcome"),
        F.when(empty, EMPTY_REASON).otherwise(detail).alias("detail"),
    )
    return sent.unionByName(
        held.select("workspace", F.lit(CANCELLED).alias("outcome"), F.lit(None).cast("string").alias("detail"))
    )


def deliver(documents: DataFrame, outcomes: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Writes the documents of delivered packs, sorted so that blocks read in order.

    Any writer format works. Rows are spread by range over workspace and block order,
    so one large pack fills many files instead of one task.
    """
    delivered = outcomes.filter(F.col("outcome") == DELIVERED).select("workspace")
    order = ["workspace", "position"]
    (
        join_dimension(documents, delivered, ["workspace"], spread_by=["position"], how="left_semi")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.format(format)
        .save(path)
    )
