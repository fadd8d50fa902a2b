"""Token ids in files: ids by frequency rank, byte-aligned lengths, control bytes apart.

The most frequent id of the corpus gets code 0, the next 1, and so on, so most codes
take one byte. Four codes share a control byte of two bits each (their lengths less one);
all control bytes of a segment come first, then the data bytes. Lengths are decoded by
a table lookup of control bytes, codes by one gather per byte.

A file set is a folder of three Parquet tables: ``segments`` (documents in ascending id,
the encoded bytes as one binary value), ``codes`` (id of each rank) and ``shards``
(ids in each range of documents). Parquet is the container because Spark writes and
reads it on any store. Documents are dealt into ranges by id once, as texts; every later
step is narrow. The driver holds the id counts (as many as the vocabulary) and one
number per range.

Segment layout, little-endian: ``FRVB``, documents, ids, data bytes of the counts,
control bytes and data of the documents' id counts, control bytes and data of the codes.

Defined results: a null text counts as empty, so the document is its end id; null document ids
come first; rows that repeat an id are all kept, next to each other, in the order of their
texts; an empty table gives an empty file set and result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.bpe import batches, tokenizer
from bindery.llm.common import pick
from bindery.llm.encoding import vocabulary
from bindery.session import discard, fresh_path, store

END_ID = 2
SEGMENT_IDS = 1 << 19
# Words whose ids a worker keeps, twice: encoding is most of the work here, and little else is held.
CACHE_WORDS = 600_000
# Characters encoded at once: words that come up again within them are looked up together.
GROUP_CHARS = 2_000_000
MAGIC = b"FRVB"
HEAD = struct.Struct("<4sIII")

# Lengths of the four codes that a control byte describes, and masks by length.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit codes."""
    codes = codes.astype("<u4")
    size = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    quads = np.ones(-(-len(codes) // 4) * 4, np.uint8)
    quads[: len(codes)] = size
    control = ((quads.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    width = int(size.max()) if len(size) else 1
    data = codes.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[starts].astype(np.uint32)
    for byte in range(1, int(size.max()) if n else 0):
        out |= raw[starts + byte].astype(np.uint32) << np.uint32(8 * byte)
    return out & MASKS[size]


def write_segment(counts: np.ndarray, codes: np.ndarray) -> bytes:
    count_control, count_data = pack_codes(counts)
    control, data = pack_codes(codes)
    return b"".join([HEAD.pack(MAGIC, len(counts), len(codes), len(count_data)), count_control, count_data, control, data])


def read_segment(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Id counts of the documents and all codes."""
    magic, docs, n, size = HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = HEAD.size
    control, at = segment[at : at - (-docs // 4)], at - (-docs // 4)
    counts = unpack_codes(control, segment[at : at + size], docs)
    at += size
    control, at = segment[at : at - (-n // 4)], at - (-n // 4)
    return counts, unpack_codes(control, segment[at:], n)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array, given by their ends in elements, as binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * np.int32(data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of binary values in one array, and the size of each value."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return held.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _encode(rows: DataFrame, vocab: str, end_id: int, wide: bool) -> DataFrame:
    """``doc_id, shard, at, ids``: ``at`` counts the ids before the document in its shard."""
    kind = np.dtype("<u4" if wide else "<u2")
    end = int(end_id).to_bytes(4, "little")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, at = tokenizer(vocab, CACHE_WORDS), TaskContext.get().partitionId(), 0
        for frame in frames:
            for first, group in batches(frame.column(1), GROUP_CHARS):
                coded = encoder.encode(group)
                ends = np.cumsum([len(ids) // 4 + 1 for ids in coded])
                ids = np.frombuffer(end.join([*coded, b""]), "<u4").astype(kind)
                before = at + np.concatenate([[0], ends[:-1]])
                at += int(ends[-1])
                shards = pa.array(np.full(len(group), shard, np.int32))
                columns = [frame.column(0).slice(first, len(group)), shards, pa.array(before, pa.int64()), _binary(ids, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "at", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, shard int, at bigint, ids binary")


def _count(coded: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs: one sum per task and id, then one per id."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for frame in frames:
            found = np.bincount(_flat(frame.column(0), kind)[0], minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    return coded.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _segments(coded: DataFrame, ranks: np.ndarray, kind: str) -> DataFrame:
    rank = coded.sparkSession.sparkContext.broadcast(ranks)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys, id counts and ids of the documents at hand, where they begin and how many ids they are.
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        shard = begin = size = 0

        def close() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _, _ in held])
            counts = np.concatenate([c for _, c, _ in held])
            payload = write_segment(counts, rank.value[np.concatenate([i for _, _, i in held])])
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([begin], pa.int64()), lists, pa.array([payload], pa.binary())], names=["shard", "at", "doc_ids", "payload"])

        for frame in frames:
            ids, counts = _flat(frame.column(3), kind)
            ends = np.cumsum(counts)
            shards, ats, many = frame.column(1).to_pylist(), frame.column(2).to_pylist(), counts.tolist()
            first = 0
            for n in range(len(many) + 1):
                # A task may read parts of several shards; a segment is one run of one shard.
                last = n == len(many)
                if not last and size and size < SEGMENT_IDS and shards[n] == shard and ats[n] == begin + size:
                    size += many[n]
                    continue
                if n > first:
                    start = int(ends[first - 1]) if first else 0
                    held.append((frame.column(0).slice(first, n - first), counts[first:n].astype(np.uint32), ids[start : int(ends[n - 1])]))
                    first = n
                if not last:
                    if size:
                        yield close()
                    held, shard, begin, size = [], shards[n], ats[n], many[n]
        if size:
            yield close()

    key = coded.schema["doc_id"].dataType.simpleString()
    return coded.mapInArrow(run, f"shard int, at bigint, doc_ids array<{key}>, payload binary")


def write_ids(docs: DataFrame, vocab: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = END_ID) -> None:
    """Encodes every text, appends ``end_id`` and writes the file set below ``path``."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    size = max(max(tokenizer(vocab).tokens), end_id) + 1
    wide = size > 1 << 16
    kind = "<u4" if wide else "<u2"
    temporary = fresh_path(spark, "ids")
    coded = store(_encode(ordered, vocab, end_id, wide), "ids", path=temporary, compression="zstd")
    counts = _count(coded, kind).collect()  # at most one row per id of the vocabulary
    by_rank = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    ranks = np.zeros(size, np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    _segments(coded, ranks, kind).write.option("compression", "zstd").parquet(f"{path}/segments")
    spark.createDataFrame(list(enumerate(by_rank)), "rank int, id int").coalesce(1).write.parquet(f"{path}/codes")
    width = np.dtype(kind).itemsize
    sizes = coded.groupBy("shard").agg(F.sum(F.octet_length("ids") / F.lit(width)).cast("bigint").alias("n_ids"))
    sizes.coalesce(1).write.parquet(f"{path}/shards")
    discard(spark, temporary)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids (unsigned 32-bit)`` of every document of a file set."""
    codes = spark.read.parquet(f"{path}/codes").collect()  # bounded by the vocabulary
    by_rank = np.zeros(len(codes), np.uint32)
    for row in codes:
        by_rank[row["rank"]] = row["id"]
    ids_of = spark.sparkContext.broadcast(by_rank)
    shards = sorted(spark.read.parquet(f"{path}/shards").collect())  # one row per range of documents
    before, offsets = 0, {}
    for shard, n_ids in shards:
        offsets[shard] = before
        before += n_ids

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for shard, at, payload, keys in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(3).to_pylist(), frame.column(2)):
                counts, found = read_segment(payload)
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                ids = _binary(ids_of.value[found].astype("<u4"), ends)
                columns = [keys.values, pa.array(starts + (offsets[shard] + at)), pa.array(counts.astype(np.int64)), ids]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    segments = spark.read.parquet(f"{path}/segments")
    key = segments.schema["doc_ids"].dataType.elementType.simpleString()
    return segments.select("shard", "at", "doc_ids", "payload").mapInArrow(run, f"doc_id {key}, start bigint, n_tokens bigint, ids binary")


def op9_id_files(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "id-files")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
