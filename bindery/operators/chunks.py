"""Documents as chunks of one size, whatever the size of a workspace.

Blocks are put in order by ranges over workspace and position. Each range adds up the lengths
of its blocks on its own; the sums of the ranges before it, of which there are as many as
partitions, give every block its place in its document. Blocks are then cut where chunks
begin, and a chunk is put together from its pieces, which are never more than its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.operators.joins import join_dimension
from bindery.session import fresh_path, store

CHUNK_CHARS = 1 << 16


def _number(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``at``: the characters before a block in its workspace and range. Rows come in order."""
    last, total = None, 0
    for frame in frames:
        names, sizes = frame.column("workspace").to_pylist(), frame.column("chars").to_numpy()
        starts = np.cumsum(sizes) - sizes
        begin = 0
        out = np.empty(len(sizes), np.int64)
        edges = [n for n in range(1, len(names)) if names[n] != names[n - 1]]
        for end in (*edges, len(names)):
            if begin == end:
                continue
            before = total if names[begin] == last else 0
            out[begin:end] = starts[begin:end] - starts[begin] + before
            total, last = int(out[end - 1] + sizes[end - 1]), names[begin]
            begin = end
        yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(out)], names=[*frame.schema.names, "at"])


def block_offsets(blocks: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """``workspace, position, text, offset``: characters before each block of ``documents`` in its document.

    Writes the blocks once to the shared folder, since ranges come from a sample and both
    uses must see the same ones. Blocks of equal position come in the order of their texts.
    """
    rows = blocks.select("workspace", "position", "text", F.length("text").cast("bigint").alias("chars"))
    ranged = rows.repartitionByRange("workspace", "position").sortWithinPartitions("workspace", "position", "text")
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    numbered = ranged.mapInArrow(_number, "workspace string, position string, text string, chars bigint, _range int, at bigint")
    stored = store(numbered, "blocks", folder, path=path)
    before = Window.partitionBy("workspace").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored.groupBy("workspace", "_range").agg(F.sum("chars").alias("_chars"))
    shifts = sums.select("workspace", "_range", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_shift"))
    placed = join_dimension(stored, shifts, ["workspace", "_range"], spread_by=["position"], how="inner")
    return placed.select("workspace", "position", "text", (F.col("at") + F.col("_shift")).alias("offset"))


def document_chunks(blocks: DataFrame, chars: int = CHUNK_CHARS, *, folder: str | None = None, path: str | None = None) -> DataFrame:
    """``workspace, position, offset, text``: documents cut every ``chars`` characters.

    Chunk ``position`` counts from 0 and starts ``offset`` characters into the document; in
    that order the texts of a workspace are its document. Takes the blocks of ``documents``.
    """
    blocks = block_offsets(blocks, folder, path).where(F.col("text") != "")
    room = F.lit(chars) - F.col("offset") % chars
    head = F.substring("text", F.lit(1), room.cast("int"))
    rest = F.regexp_extract_all(F.substring("text", (room + 1).cast("int"), F.lit(2**31 - 1)), F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))
    pieces = F.when(F.length("text") <= room, F.array("text")).otherwise(F.concat(F.array(head), rest))
    cut = blocks.select("workspace", "position", "offset", F.posexplode(pieces).alias("nth", "piece"))
    # Only the first piece of a block can start inside a chunk.
    chunk = F.expr(f"offset div {chars}") + F.col("nth")
    inside = F.when(F.col("nth") == 0, F.col("offset") % chars).otherwise(0)
    cut = cut.select("workspace", chunk.alias("chunk"), F.struct(inside.alias("inside"), "piece").alias("p"))
    whole = cut.groupBy("workspace", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["piece"]), "").alias("text"))
    return whole.select("workspace", F.col("chunk").alias("position"), (F.col("chunk") * chars).alias("offset"), "text")
