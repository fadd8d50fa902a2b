"""Exact duplicates through an extendible-hash index on shared files.

1. Hashes are counted, without their texts. A directory over the leading bits of the hash
   starts with one bucket and doubles while a bucket holds more than ``BUCKET_ENTRIES``
   hashes; since a single hash is never too many, 64 bits always do. Its slots and the buckets
   they lead to are a table, not a list of the driver.
2. Every document is routed through the directory to the owner of its range of keys. Copies of
   hashes that own more than 1/``HEAVY_SHARES`` of the rows are combined where they are
   first, so that a text that makes up a third of the corpus costs one row per input task.
3. The owner of a range compares the texts of equal hash byte by byte, decides which
   document stays, chains the different texts of a hash and writes the entries
   ``bucket, hash, chain, digest, ...`` to the shared folder.
4. Documents look their entry up in the bucket the directory names for their hash.

The directory is broadcast up to 32 MB, which is about 10 billion different texts; beyond that
it is joined by a shuffle. Ranges of keys are the slots of the directory, or of ``RANGE_BITS``
leading bits where it is smaller, so that few buckets still have many owners.

Defined results: a null text counts as empty; a null id is smaller than every id and two
null ids are equal; rows that repeat an id and a text count separately and share their
fate; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import HEAVY_SHARES, attach, leave_out, lower_ascii, pick, row_key
from bindery.operators.joins import join_dimension
from bindery.session import store

BUCKET_ENTRIES = 32_768
RANGE_BITS = 12


def _hash(text: Column, bits: int) -> Column:
    """The leading ``bits`` of the text's 64-bit hash; fewer bits only in tests, to force collisions."""
    return _leading(F.xxhash64(text), F.lit(bits))


def _leading(key: Column, bits: Column) -> Column:
    """A 64-bit key with all but its leading ``bits`` set to zero."""
    rest = F.lit(64) - bits
    kept = F.call_function("shiftleft", F.call_function("shiftrightunsigned", key, rest), rest)
    return F.when(bits == 0, F.lit(0).cast("bigint")).otherwise(kept)


def global_depth(hashes: DataFrame, capacity: int) -> int:
    """Doublings after which no slot of the directory holds more than ``capacity`` of the ``hash`` rows."""
    depth = max(0, math.ceil(math.log2(max(1, hashes.count()) / capacity)))
    while depth < 64:
        slots = hashes.groupBy(_leading(F.col("hash"), F.lit(depth))).count()
        if (slots.agg(F.max("count").alias("most")).first()["most"] or 0) <= capacity:
            break
        depth += 1
    return depth


def directory(hashes: DataFrame, depth: int, capacity: int) -> DataFrame:
    """``slot, bucket, local_depth`` of every slot in use, each named by the first key in it.

    A slot's bucket is the widest range around it that holds at most ``capacity`` hashes:
    what is left of one bucket when only overfull ones are split.
    """
    slots = hashes.groupBy(_leading(F.col("hash"), F.lit(depth)).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    around = slots.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    around = around.withColumn("bucket", _leading(F.col("slot"), F.col("local_depth")))
    fit = around.groupBy("bucket", "local_depth").agg(F.sum("n").alias("held")).where(F.col("held") <= capacity)
    widest = around.join(fit, ["bucket", "local_depth"]).groupBy("slot").agg(F.min("local_depth").alias("local_depth"))
    return widest.select("slot", _leading(F.col("slot"), F.col("local_depth")).alias("bucket"), "local_depth")


def _through(rows: DataFrame, slots: DataFrame, depth: int, spread: str) -> DataFrame:
    """Rows with the ``bucket`` and ``local_depth`` the directory has for their ``hash``."""
    found = join_dimension(rows.withColumn("slot", _leading(F.col("hash"), F.lit(depth))), slots, ["slot"], spread_by=[spread])
    return found.drop("slot")


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = 64, bucket_entries: int = BUCKET_ENTRIES
) -> tuple[DataFrame, DataFrame, int]:
    """The entries ``bucket, local_depth, hash, chain, digest, text_bytes, keep_id, group_size``, the directory and its depth."""
    rows = pick(docs, id=id_col, text=text_col).select("id", lower_ascii(F.col("text")).alias("text"))
    rows = rows.withColumn("hash", _hash(F.col("text"), bits))
    hashes = store(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n_rows")), "hashes")
    total = hashes.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    depth = global_depth(hashes, bucket_entries)
    slots = store(directory(hashes, depth, bucket_entries), "directory")

    heavy = F.broadcast(hashes.where(F.col("n_rows") * HEAVY_SHARES > total).select("hash"))
    light = rows.join(heavy, "hash", "left_anti").select("hash", "text", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    same = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    many = rows.join(heavy, "hash", "left_semi").groupBy("hash", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    routed = _through(light.unionByName(many), slots, depth, "keep_id")
    routed = routed.withColumn("range", _leading(F.col("hash"), F.lit(max(depth, min(RANGE_BITS, bits))))).repartition("range")
    # Grouping by the text itself compares bytes; all of it happens where the range is owned.
    entries = routed.groupBy("range", "bucket", "local_depth", "hash", "text").agg(*same)
    entries = entries.select("range", "bucket", "local_depth", "hash", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("text_bytes"), "keep_id", "group_size")
    chained = entries.withColumn("chain", F.row_number().over(Window.partitionBy("range", "hash").orderBy("digest")))
    return store(chained.select("bucket", "local_depth", "hash", "chain", "digest", "text_bytes", "keep_id", "group_size"), "index"), slots, depth


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain, row_key``.

    Texts are equal if they are so after lower-casing A-Z; of equal texts the largest id stays.
    """
    bits = index.get("bits", 64)
    entries, slots, depth = build_index(docs, id_col, text_col, **index)
    total = entries.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    facts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", row_key(F.col("text")).alias("row_key"), lower_ascii(F.col("text")).alias("text"))
    facts = facts.select("doc_id", "row_key", _hash(F.col("text"), bits).alias("hash"), F.sha2("text", 256).alias("digest"))
    facts = _through(facts, slots, depth, "doc_id").drop("local_depth")
    found = attach(facts, entries, ["bucket", "hash", "digest"], ["keep_id", "group_size", "chain"], "group_size", total, "doc_id")
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"), "bucket", "chain", "row_key",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which no equal one with a larger id exists, all columns as given."""
    groups = exact_groups(docs, id_col, text_col)
    return leave_out(docs, id_col, text_col, store(groups.where(~F.col("kept")).select("doc_id", "row_key"), "copies"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(folded) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents)
WINDOW same AS (PARTITION BY folded)
"""
