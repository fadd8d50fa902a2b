"""Removes passages that an earlier document holds: repeated windows of words.

Every window of ``WINDOW`` words has a Rabin-Karp hash. What decides on a window is the
smallest id of a document that holds it, counted in Spark; repeated windows merge into
maximal intervals of words to remove.

Windows are not sent one by one. The window's anchor is the least hash among the short
word runs inside it, so equal windows have equal anchors, and neighbouring windows mostly
share theirs. Consecutive windows with one anchor form a segment with a hash of its own
words, about one per 22 words:

1. Segments are counted. All windows of a segment that an earlier document holds as well
   are repeated, in all documents but the first.
2. Only windows in two different segments with the same anchor can still be equal. For
   these segments, and only in the first document that holds them, every window's hash is
   counted.

So copies cost a row per segment, and windows that share no anchor are never compared,
though every window is decided. A passage of very many documents is one key: its rows are
dealt out, and what decides on it is broadcast. Hashes that decide have 128 bits. Intervals are small
next to texts; they go to the texts by broadcast while their measured size is small, and
by a shuffle on the document beyond that.

Defined results: a null text has no words; a document shorter than a window loses nothing;
null ids are neither changed nor count as earlier documents; rows that repeat an id with
the same text share their fate, and never count as earlier than each other; an empty
table gives an empty result; other columns are ignored by ``repeated_spans`` and kept by
``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import attach, join_small, pick
from bindery.llm.words import BASES, SMALL_GROUP, each_text, hash_groups, hash_text, spans, stir, word_edges
from bindery.session import store

WINDOW = 50
ANCHOR_WORDS = 8
ANCHORS_AT_ONCE = 1 << 12
RUN_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def find_segments(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS):
    """Segments of a group of texts: text, first word in the group, windows, anchor."""
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none, none, np.empty(0, np.uint64)
    at = np.arange(len(hashes) - window + 1)
    text = np.searchsorted(offsets, at, "right") - 1
    valid = np.flatnonzero(at + window <= offsets[text + 1])
    if not len(valid):
        return none, none, none, np.empty(0, np.uint64)
    runs = np.arange(len(hashes) - anchor_words + 1)
    grams = stir(spans(hashes, runs, runs + anchor_words, RUN_BASES[0]))
    views = sliding_window_view(grams, window - anchor_words + 1)
    # argmin copies its windows, so a few at a time.
    least = np.concatenate([views[n : n + ANCHORS_AT_ONCE].argmin(axis=1) for n in range(0, len(views), ANCHORS_AT_ONCE)])[valid] + valid
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(valid) != 1) | (np.diff(least) != 0)]))
    sizes = np.diff(np.append(opens, len(valid)))
    return text[valid[opens]], valid[opens], sizes, grams[least[opens]]


def _key_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def _segments(rows: DataFrame) -> DataFrame:
    names = ["doc_id", "row_key", "start", "windows", "anchor", "k1", "k2"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            both = [hash_groups(each_text(frame.column(2)), base, group_bytes=SMALL_GROUP) for base in BASES]
            for (first, hashes, offsets), (_, other, _) in zip(*both):
                text, start, windows, anchor = find_segments(hashes, offsets)
                if not len(text):
                    continue
                end = start + windows + WINDOW - 1
                keys = [stir(spans(h, start, end, b) + windows.astype(np.uint64)).view(np.int64) for h, b in zip((hashes, other), RUN_BASES)]
                rows_ = pa.array(text + first)
                columns = [frame.column(0).take(rows_), frame.column(1).take(rows_), start - offsets[text], windows, anchor.view(np.int64), *keys]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return rows.mapInArrow(run, f"doc_id {_key_type(rows)}, row_key bigint, start bigint, windows bigint, anchor bigint, k1 bigint, k2 bigint")


def _windows(rows: DataFrame) -> DataFrame:
    """The hash of every window of the segments listed in ``runs`` with each text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for n in range(frame.num_rows):
                text = (frame.column(2)[n].as_py() or "").encode()
                start = np.concatenate([np.arange(r["start"], r["start"] + r["windows"]) for r in frame.column(3)[n].as_py()])
                keys = [stir(spans(hash_text(text, w), start, start + WINDOW, b)).view(np.int64) for w, b in zip(BASES, RUN_BASES)]
                same = pa.array(np.full(len(start), n))
                yield pa.RecordBatch.from_arrays([frame.column(0).take(same), frame.column(1).take(same), pa.array(start), *map(pa.array, keys)], names=["doc_id", "row_key", "start", "k1", "k2"])

    return rows.mapInArrow(run, f"doc_id {_key_type(rows)}, row_key bigint, start bigint, k1 bigint, k2 bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    return rows.select("doc_id", F.xxhash64("text").alias("row_key"), "text")


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals covered by the given ones; intervals that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]])) if len(starts) else np.empty(0, np.int64)
    closes = np.append(opens[1:] - 1, len(starts) - 1) if len(starts) else opens
    return starts[opens], reach[closes]


def _merged(found: DataFrame) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            begins, ends, cuts = [], [], [0]
            for runs in frame.column(2):
                flat = runs.values
                a, b = merge(flat.field("start").to_numpy(), flat.field("end").to_numpy())
                begins.append(a)
                ends.append(b)
                cuts.append(cuts[-1] + len(a))
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (begins, ends)], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)], names=["doc_id", "row_key", "spans"])

    grouped = found.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return grouped.mapInArrow(run, f"doc_id {_key_type(found)}, row_key bigint, spans array<struct<start:bigint,end:bigint>>")


def _counted() -> list:
    return [F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_rows")]


def with_first(facts: DataFrame, kinds: DataFrame, values: list[str]) -> DataFrame:
    """The segments or windows whose key is in ``kinds``, with its ``values``.

    A passage that many documents hold is one key. Those that own more than 1/1024 of the
    rows are met by broadcast and their rows dealt out by document and place.
    """
    spread = facts.withColumn("_spread", F.xxhash64("doc_id", "start"))
    found = attach(spread, kinds, ["k1", "k2"], values, "n_rows", facts.count(), "_spread")
    return found.where("first_doc IS NOT NULL").drop("_spread")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, spans``: maximal intervals of words (from 0, end exclusive) to remove.

    Documents without any are left out. ``row_key`` is the hash of the text, which tells
    rows of one id apart.
    """
    rows = _keyed(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    segments = store(_segments(rows), "segments", compression="zstd")
    kinds = segments.groupBy("k1", "k2").agg(*_counted(), F.min("anchor").alias("anchor"))
    met = kinds.groupBy("anchor").agg(F.min("first_doc").alias("lo"), F.max("first_doc").alias("hi")).where("lo < hi").select("anchor", F.lit(True).alias("met"))
    marked = kinds.join(met, "anchor", "left").where("met OR first_doc < last_doc")
    marked = store(marked.select("k1", "k2", "n_rows", "first_doc", F.coalesce("met", F.lit(False)).alias("met")), "segment-kinds")
    hits = with_first(segments, marked, ["first_doc", "met"]).where("doc_id > first_doc OR met")
    hits = store(hits.select("doc_id", "row_key", "start", "windows", F.col("doc_id") > F.col("first_doc")), "segment-hits").toDF("doc_id", "row_key", "start", "windows", "whole")
    open_ = hits.where(~F.col("whole")).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    open_ = store(open_, "open-segments")
    windows = store(_windows(join_small(rows, open_, ["doc_id", "row_key"], "inner").select("doc_id", "row_key", "text", "runs")), "windows", compression="zstd")
    counted = store(windows.groupBy("k1", "k2").agg(*_counted()).where("first_doc < last_doc").select("k1", "k2", "n_rows", "first_doc"), "window-kinds")
    single = with_first(windows, counted, ["first_doc"]).where("doc_id > first_doc").select("doc_id", "row_key", "start", F.lit(1).cast("bigint").alias("windows"))
    found = hits.where("whole").select("doc_id", "row_key", "start", "windows").union(single)
    return _merged(found.select("doc_id", "row_key", "start", (F.col("start") + F.col("windows") + F.lit(WINDOW - 1)).alias("end")))


def kept_words(text: bytes, runs: list[dict]) -> tuple[bytes, int, int]:
    """The words outside the intervals joined by one space, the number of words, how many went."""
    words = text.split() if len(text) < 1 << 16 else None
    if words is None:  # long texts without an object per word
        raw = np.frombuffer(text, np.uint8)
        starts, ends = word_edges(raw)
        keep = np.ones(len(starts), bool)
        for run in runs:
            keep[run["start"] : run["end"]] = False
        kept = [text[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())]
        return b" ".join(kept), len(starts), int((~keep).sum())
    n = len(words)
    for run in reversed(runs):
        del words[run["start"] : run["end"]]
    return b" ".join(words), n, n - len(words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kept_text, n_words, n_removed`` for every document."""
    rows = _keyed(docs, id_col, text_col)
    spans_ = store(repeated_spans(docs, id_col, text_col), "spans")
    joined = join_small(rows, spans_, ["doc_id", "row_key"], "left").select("doc_id", "text", "spans")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, runs, out, size, first = frame.column(1).cast(pa.binary()), frame.column(2), [], 0, 0
            for n in range(frame.num_rows):
                out.append(kept_words(texts[n].as_py() or b"", runs[n].as_py() or []))
                size += len(out[-1][0])
                if size > 1 << 22 or n == frame.num_rows - 1:
                    kept, words, removed = zip(*out)
                    columns = [frame.column(0).slice(first, len(out)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept_text", "n_words", "n_removed"])
                    out, size, first = [], 0, n + 1

    return joined.mapInArrow(run, f"doc_id {_key_type(rows)}, kept_text string, n_words bigint, n_removed bigint")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with repeated passages cut out of their texts, all columns as given.

    Texts that lose nothing stay as they are, white space included.
    """
    spans_ = store(repeated_spans(docs, id_col, text_col), "spans")
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("row_key"))
    joined = join_small(keyed, spans_, ["doc_id", "row_key"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([kept_words(t.encode(), list(r))[0].decode() for t, r in zip(texts, runs)], dtype=object)

    shorter = joined.where("spans IS NOT NULL").withColumn("cut", cut(F.col("row")[text_col].cast("string"), F.col("spans")))
    new = {text_col: F.col("cut").cast(docs.schema[text_col].dataType)}
    if chars_col in names:
        new[chars_col] = F.length("cut").cast(docs.schema[chars_col].dataType)
    shorter = shorter.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
    return joined.where("spans IS NULL").select("row.*").union(shorter)


OP6_SQL = """
WITH cut AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, begin_at, array_to_string(list_slice(words, begin_at, begin_at + 49), ' ') AS passage
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS begin_at FROM cut WHERE len(words) >= 50)
), firsts AS (
    SELECT passage, min(doc_id) AS first_doc FROM windows GROUP BY passage
), gone AS (
    SELECT DISTINCT doc_id, begin_at + step AS place
    FROM windows JOIN firsts USING (passage), range(50) AS steps(step) WHERE first_doc < doc_id
), placed AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM cut
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
    FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT cut.doc_id, CAST(len(words) AS BIGINT) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
"""


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
