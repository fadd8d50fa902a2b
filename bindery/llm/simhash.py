"""Near-duplicates by SimHash, linked through a hierarchical index in Gray order.

Every document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are
sorted by their rank in the reflected Gray code, where neighbours differ in few bits, and
cut into blocks. The fingerprints below a node of the index share a bit pattern under a
mask; a node keeps only what its parent does not share already. A search adds up the
differences on the way down and leaves a whole group as soon as they exceed the bound, so
no link is lost and no limit on group sizes is needed.

The upper nodes are a table: pairs of nodes that may hold a link are found level by level
with joins on the parent. Blocks of the pairs that remain meet in one task each, which
searches one block's fingerprints in the other's lower nodes and gives back a spanning
forest of the links, never all pairs of a group. Components of the forests are found on
fingerprints, and documents look theirs up by fingerprint.

Defined results: a null text counts as empty; texts without words have fingerprint zero and
are linked like any others; null ids take part but never name a component while another
id can; rows that repeat an id are each given a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import attach, leave_out, pick, row_key
from bindery.llm.components import components
from bindery.llm.words import each_text
from bindery.session import store

SHINGLE_WORDS = 4
MOST_BITS = 4
SEED = 42
LEAST_BLOCK, MOST_BLOCK, AIMED_BLOCKS = 4096, 1 << 18, 32
FANOUT = 8
NODE_FANOUT = 16
FRONTIER = 1 << 17
ROWS_AT_ONCE = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: folds A-Z only, cuts at blanks and 09-0D
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    else:
        starts, ends = [0], [len(joined)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), ROWS_AT_ONCE):
        some = zip(starts[at : at + ROWS_AT_ONCE], ends[at : at + ROWS_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in some], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, row_key, code`` (the fingerprint as a signed 64-bit integer) for every row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            codes = np.array([fingerprint(t or b"", shingle) for t in each_text(frame.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(codes.view(np.int64))], names=["doc_id", "row_key", "code"])

    rows = pick(docs, doc_id=id_col, text=(text_col, "string")).select("doc_id", row_key(F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key bigint, code bigint")


def gray_rank(code: Column) -> Column:
    """The position of a code in the reflected Gray code, shifted so that signed order is its order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class Tree:
    """Lower nodes over the sorted codes of one block: shared patterns, level by level."""

    def __init__(self, codes: np.ndarray):
        both, any_ = codes, codes
        masks, patterns = [np.full(len(codes), ~np.uint64(0))], [codes]
        while len(both) > FANOUT:
            cuts = np.arange(0, len(both), FANOUT)
            both, any_ = np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(any_, cuts)
            masks.append(~(both ^ any_))
            patterns.append(both)
        # From the top: what a node shares beyond its parent.
        self.levels = []
        for depth in range(len(masks) - 1, -1, -1):
            own = masks[depth]
            if depth + 1 < len(masks):
                own = own & ~masks[depth + 1][np.arange(len(own)) // FANOUT]
            self.levels.append((own, patterns[depth]))

    def search(self, codes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into ``codes``, index into the block) at most ``bits`` apart."""
        top = len(self.levels[0][0])
        for begin in range(0, len(codes), FRONTIER // FANOUT // 2):
            n = min(FRONTIER // FANOUT // 2, len(codes) - begin)
            yield from self._descend(codes, np.repeat(np.arange(begin, begin + n), top), np.tile(np.arange(top), n), np.zeros(n * top, np.uint8), 0, bits)

    def _descend(self, codes, query, node, apart, depth, bits):
        own, pattern = self.levels[depth]
        apart = apart + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
        near = np.flatnonzero(apart <= bits)
        query, node, apart = query[near], node[near], apart[near]
        if depth == len(self.levels) - 1:
            if len(query):
                yield query, node
            return
        below = len(self.levels[depth + 1][0])
        for at in range(0, len(query), FRONTIER // FANOUT):
            part = slice(at, at + FRONTIER // FANOUT)
            child = (node[part, None] * FANOUT + np.arange(FANOUT)).ravel()
            there = child < below
            yield from self._descend(codes, np.repeat(query[part], FANOUT)[there], child[there], np.repeat(apart[part], FANOUT)[there], depth + 1, bits)


def _settle(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the sets of the linked items; a label is the least item known of its set."""
    while True:
        a, b = labels[u], labels[v]
        if (a == b).all():
            return
        least = np.minimum(a, b)
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def link_blocks(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks, or within one if ``right`` is None."""
    codes = left if right is None else np.concatenate([left, right])
    tree = Tree(left if right is None else right)
    shift = 0 if right is None else len(left)
    labels = np.arange(len(codes))
    for query, found in tree.search(left, bits):
        _settle(labels, query, found + shift)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[moved], codes[labels[moved]]


def _blocks(codes: DataFrame, n_codes: int) -> DataFrame:
    """Blocks of codes in Gray order: ``part, block, codes, all_ones, any_ones``."""
    size = max(LEAST_BLOCK, min(MOST_BLOCK, -(-n_codes // AIMED_BLOCKS)))
    parts = -(-n_codes // size)
    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = np.empty(0, np.int64), 0

        def block(some: np.ndarray) -> pa.RecordBatch:
            values = [first, some.tobytes(), int(np.bitwise_and.reduce(some)), int(np.bitwise_or.reduce(some))]
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=["at", "codes", "all_ones", "any_ones"])

        for frame in frames:
            held = np.concatenate([held, frame.column(0).to_numpy(zero_copy_only=False)])
            while len(held) >= 2 * size:
                yield block(held[:size])
                held, first = held[size:], first + 1
        if len(held):
            yield block(held)

    dealt = ranked.repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("code")
    return dealt.mapInArrow(run, "at bigint, codes binary, all_ones bigint, any_ones bigint").select(
        F.shiftleft(F.spark_partition_id().cast("bigint"), 20).bitwiseOR(F.col("at")).alias("node"), "codes", "all_ones", "any_ones"
    )


def _near_pairs(blocks: DataFrame, bits: int) -> DataFrame:
    """Pairs of blocks (``a <= b``) whose shared patterns differ in at most ``bits`` bits.

    Goes down from one root, pairing only the children of pairs that were left.
    """
    levels = [blocks.select("node", "all_ones", "any_ones")]
    span = 1 << 20  # nodes of one range partition share a parent, then 16 of these
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while span <= top:
        grouped = levels[-1].groupBy(F.expr(f"node - node % {span}").alias("node"))
        levels.append(grouped.agg(F.bit_and("all_ones").alias("all_ones"), F.bit_or("any_ones").alias("any_ones")))
        span *= NODE_FANOUT
    pairs = None
    for level in reversed(range(len(levels))):
        parent = F.expr(f"node - node % {span}") if pairs is not None else F.lit(0)
        nodes = levels[level].select("node", parent.cast("bigint").alias("parent"), "all_ones", F.bitwise_not(F.col("all_ones").bitwiseXOR(F.col("any_ones"))).alias("mask"))
        a = nodes.select(F.col("node").alias("a"), F.col("parent").alias("pa"), F.col("all_ones").alias("ones_a"), F.col("mask").alias("mask_a"))
        b = nodes.select(F.col("node").alias("b"), F.col("parent").alias("pb"), F.col("all_ones").alias("ones_b"), F.col("mask").alias("mask_b"))
        if pairs is None:
            met = a.join(b, F.col("pa") == F.col("pb"))
        else:
            met = pairs.select(F.col("a").alias("pa"), F.col("b").alias("pb")).join(a, "pa").join(b, "pb")
        apart = F.bit_count(F.col("ones_a").bitwiseXOR(F.col("ones_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")))
        pairs = met.where((F.col("a") <= F.col("b")) & (apart <= bits)).select("a", "b")
        span //= NODE_FANOUT
    return pairs


def code_links(codes: DataFrame, n_codes: int, bits: int = MOST_BITS) -> DataFrame:
    """Links ``u, v`` between distinct codes at most ``bits`` apart: a spanning forest per pair of blocks."""
    blocks = store(_blocks(codes, n_codes), "gray-blocks")
    pairs = store(_near_pairs(blocks, bits), "gray-pairs")
    texts = blocks.select("node", "codes")
    sides = pairs.join(texts, F.col("a") == F.col("node")).select("a", "b", F.lit(0).alias("side"), "codes")
    other = pairs.where("a <> b").join(texts, F.col("b") == F.col("node")).select("a", "b", F.lit(1).alias("side"), "codes")

    def run(pair: pd.DataFrame) -> pd.DataFrame:
        given = [np.frombuffer(c, np.uint64) for c in pair.sort_values("side")["codes"]]
        u, v = link_blocks(given[0], given[1] if len(given) > 1 else None, bits)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return sides.union(other).groupBy("a", "b").applyInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, row_key, code, component_id`` for every row; the component's id is the smallest in it."""
    marked = store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = store(marked.groupBy("code").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs")), "codes")
    sizes = codes.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs")).first()
    roots = components(code_links(codes, max(1, sizes["codes"]), bits)).withColumnRenamed("node", "code")
    linked = codes.join(roots, "code")
    named = linked.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = linked.join(named, "root").select("code", "component_id")
    classes = codes.join(linked, "code", "left").select("code", "n_docs", F.coalesce("component_id", "first_doc").alias("component_id"))
    return attach(marked, classes, ["code"], ["component_id"], "n_docs", sizes["docs"], "doc_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id, all columns as given."""
    groups = near_duplicates(docs, id_col, text_col, shingle=shingle, bits=bits)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row_key")
    return leave_out(docs, id_col, text_col, store(gone, "near-copies"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
