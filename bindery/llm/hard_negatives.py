"""Hard negatives by exact integer scores, several candidates to a multiplication.

Components become whole numbers, floor(256 x). A row's score is its inner product with an
anchor. To score a block of rows, their components are raised by a bias so that none is
negative, and several rows are packed as separated fields of one wide integer (Kronecker
substitution): sum of c_r 2^(w r). Multiplying that by an anchor's component, raised likewise,
multiplies all fields; w is chosen from the largest components at hand so that the sum
over all components never leaves its field. The fields are cut out of the sum and the
biases taken off again, which gives every row's score exactly. Where two fields or more fit into
the 53 bits that a double holds exactly, the wide integers are doubles and one matrix
product serves a whole block; otherwise they are Python integers of any width.

1. Rows are dealt evenly into blocks, one packed matrix each, and anchors into packs.
   Every pack goes to every block; the two are joined by the block's number.
2. For an anchor's positives only the rows of its label are scored, in all blocks.
3. The positives' scores go to the blocks with their anchors. There all rows are scored, sorted once
   per anchor, and each positive takes the first rows of its window of scores.

Tasks keep the best rows of the anchors at hand over their blocks (at most ``HELD_PACKS``
packs) and Spark ranks what the tasks found. Nothing is collected but two counts.

Defined results: rows with a null id, label or vector, a null or non-finite component, or one
that is not finite when multiplied by 256, take no part; rows meet only rows of as many
components, and vectors without components score 0; rows of an anchor's id are not other rows
to it; rows that repeat an id count each, also as anchors, and rank next to each other; an
anchor without positives, or a positive without negatives, gives no rows; scores beyond
a long are ranked exactly and shown as the nearest long; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import pick
from bindery.session import store

SCALE = 256.0
BLOCK_ROWS = 4096
PACK_ANCHORS = 1024
HELD_PACKS = 16
SLICE_ANCHORS = 256
WIDE_ROWS = 64
MOST_TASKS = 20_000
# A double holds whole numbers of this many bits; scores below 2^48 leave room for a row's place beside them.
DOUBLE_BITS, SCORE_BITS = 53, 48
LONG = (-(2**63), 2**63 - 1)
NINES = str.maketrans("0123456789", "9876543210")

MATRIX = "dim int, ids binary, labels binary, width int, vectors binary"


def _bits(components: int, a: np.ndarray, c: np.ndarray) -> int:
    """The width of a field that holds the sum of products of biased components."""
    top_a, top_c = (int(x.max()) - int(x.min()) if x.size else 0 for x in (a, c))
    return max(1, (components * top_a * top_c).bit_length())


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def fits_doubles(anchors: np.ndarray, rows: np.ndarray) -> bool:
    dim = rows.shape[1]
    small = (dim * _largest(anchors) * _largest(rows)).bit_length() <= SCORE_BITS
    return small and 2 * _bits(dim, anchors, rows) <= DOUBLE_BITS


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, one row per anchor, with the wide integers held in doubles."""
    n, dim = rows.shape
    bits = _bits(dim, anchors, rows)
    fields = DOUBLE_BITS // bits
    low_a, low_c = (float(x.min()) if x.size else 0.0 for x in (anchors, rows))
    raised = np.zeros((-(-n // fields) * fields, dim))
    raised[:n] = rows - low_c
    weights = 2.0 ** (bits * np.arange(fields))
    # Every row of ``wide`` holds as many rows of the block as there are fields.
    wide = np.einsum("rfd,f->rd", raised.reshape(len(raised) // fields, fields, dim), weights)
    product = ((anchors - low_a) @ wide.T).astype(np.int64)
    found = product[:, :, None] >> (bits * np.arange(fields)) & ((1 << bits) - 1)
    found = found.reshape(len(anchors), len(raised))[:, :n]
    return found + (low_c * anchors.sum(axis=1)).astype(np.int64)[:, None] + (low_a * rows.sum(axis=1) - dim * low_a * low_c).astype(np.int64)


def wide_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of components of any size, with Python integers of ``WIDE_ROWS`` fields."""
    n, dim = rows.shape
    out = np.zeros((len(anchors), n), object)
    if not n or not dim:
        return out
    low_a, low_c = int(anchors.min()), int(rows.min())
    size = -(-_bits(dim, anchors, rows) // 8)
    raised = [[int(x) - low_a for x in a] for a in anchors]
    sums = [sum(map(int, a)) for a in anchors]
    for at in range(0, n, WIDE_ROWS):
        some = [[int(x) for x in row] for row in rows[at : at + WIDE_ROWS]]
        wide = [int.from_bytes(b"".join((row[d] - low_c).to_bytes(size, "little") for row in some), "little") for d in range(dim)]
        of_rows = [low_a * sum(row) - dim * low_a * low_c for row in some]
        for k, a in enumerate(raised):
            total = sum(x * w for x, w in zip(a, wide)).to_bytes(size * len(some) + 1, "little")
            for r, own in enumerate(of_rows):
                out[k, at + r] = int.from_bytes(total[r * size : (r + 1) * size], "little") + low_c * sums[k] + own
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return packed_scores(anchors, rows) if fits_doubles(anchors, rows) else wide_scores(anchors, rows)


def ranked(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's scores in falling order, equal ones in their order, and their places."""
    n = found.shape[1]
    if found.dtype == object:
        order = np.array([sorted(range(n), key=lambda r: -line[r]) for line in found], np.int64).reshape(found.shape)
        return np.take_along_axis(found, order, axis=1), order
    room = np.int64(max(1, n - 1).bit_length())
    keys = np.sort(found << room | (n - 1 - np.arange(n)), axis=1)[:, ::-1]
    return keys >> room, n - 1 - (keys & ((1 << room) - 1))


def _narrow(matrix: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if _largest(matrix) <= np.iinfo(kind).max:
            return matrix.astype(kind)
    return matrix


def _widen(width: int, raw: bytes, dim: int, n: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.float64}[width]
    return np.frombuffer(raw, kind).reshape(n, dim).astype(np.float64)


def _pack(rows: DataFrame, parts: int, name: str) -> DataFrame:
    """One row per partition and vector length: its number, ids, labels and matrix, by label and id.

    Rows are dealt out in turn, so partitions are of one size whatever the rows hold.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        table = pa.Table.from_batches(frames)
        lists = table["vector"].combine_chunks()
        ids, labels, sizes = table["vec_id"].to_numpy(), table["label"].to_numpy(), lists.value_lengths().to_numpy()
        values, starts = np.floor(SCALE * lists.flatten().to_numpy()), np.cumsum(sizes) - sizes
        out = []
        for dim in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == dim)
            own = own[np.lexsort((ids[own], labels[own]))]
            matrix = _narrow(values[starts[own][:, None] + np.arange(dim)])
            out.append((TaskContext.get().partitionId(), dim, ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), matrix.itemsize, matrix.tobytes()))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[name, "dim", "ids", "labels", "width", "vectors"])

    return rows.repartition(parts).mapInArrow(run, f"{name} int, {MATRIX}")


def order_text(x: int) -> str | None:
    """A text that sorts as the number does, for numbers beyond a long: sign, digits, 9's complement below zero."""
    if LONG[0] <= x <= LONG[1]:
        return None
    digits = str(abs(x))
    return f"1{len(digits):05d}{digits}" if x > 0 else f"0{99_999 - len(digits):05d}{digits.translate(NINES)}"


def from_order_text(text: str) -> int:
    return int(text[6:]) if text[0] == "1" else -int(text[6:].translate(NINES))


class Best:
    """The first ``most`` (score, id) of every anchor's slots, over the blocks a task has met."""

    def __init__(self, most: int):
        self.most = most
        self.held: dict[tuple, dict[tuple[int, int], list]] = {}

    def add(self, pack: tuple, at: int, slot: int, found: list[tuple[int, int]]) -> None:
        if found:
            own = self.held.setdefault(pack, {})
            known = own.get((at, slot))
            own[at, slot] = sorted([*known, *found], key=lambda f: (-f[0], f[1]))[: self.most] if known else found

    def rows(self, pack: tuple) -> pa.RecordBatch:
        lines = [(*pack, at, slot, min(max(x, LONG[0]), LONG[1]), i, order_text(x)) for (at, slot), found in self.held.pop(pack).items() for x, i in found]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], names=["pack", "dim", "at", "slot", "score", "vec_id", "beyond"])


FOUND = "pack int, dim int, at int, slot int, score bigint, vec_id bigint, beyond string"


def _meet(blocks: DataFrame, packs: DataFrame, parts: int, most: int, search) -> DataFrame:
    """Runs ``search`` for every pack in every block: ``pack, dim, at, slot, score, vec_id``."""
    everywhere = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = everywhere.select("block", "dim", *[F.col(c).alias(f"a_{c}") for c in packs.columns if c != "dim"])
    # Few bytes mean much work here, so the number of tasks follows the blocks, not the bytes.
    tasks = min(parts, MOST_TASKS)
    met = blocks.repartition(tasks, "block", "dim").join(asked.repartition(tasks, "block", "dim"), ["block", "dim"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, last = Best(most), None
        rows = (row for frame in frames for n in range(frame.num_rows) for row in frame.slice(n, 1).to_pylist())
        for row in rows:
            dim, ids, labels = row["dim"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
            if last is None or last[0] != (row["block"], dim):
                last = (row["block"], dim), _widen(row["width"], row["vectors"], dim, len(ids))
            a_ids, a_labels = np.frombuffer(row["a_ids"], "<i8"), np.frombuffer(row["a_labels"], "<i8")
            anchors = _widen(row["a_width"], row["a_vectors"], dim, len(a_ids))
            for at, slot, found in search(row, a_ids, a_labels, anchors, ids, labels, last[1]):
                best.add((row["a_pack"], dim), at, slot, found)
            while len(best.held) > HELD_PACKS:
                yield best.rows(next(iter(best.held)))
        for pack in list(best.held):
            yield best.rows(pack)

    return met.mapInArrow(run, FOUND)


def _first(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of every slot over all tasks, ranked from 1."""
    order = Window.partitionBy("pack", "dim", "at", "slot").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _positives(most: int):
    """Searches the rows of an anchor's own label, label by label."""

    def search(row, a_ids, a_labels, anchors, ids, labels, matrix):
        for label in np.intersect1d(a_labels, labels).tolist():
            here, there = np.flatnonzero(a_labels == label), slice(int(np.searchsorted(labels, label)), int(np.searchsorted(labels, label, "right")))
            own_ids = ids[there]
            for begin in range(0, len(here), SLICE_ANCHORS):
                some = here[begin : begin + SLICE_ANCHORS]
                found, order = ranked(scores(anchors[some], matrix[there]))
                for k, at in enumerate(some.tolist()):
                    near = ((int(found[k, r]), int(own_ids[order[k, r]])) for r in range(len(own_ids)))
                    yield at, 0, list(itertools.islice((f for f in near if f[1] != a_ids[at]), most))

    return search


def _negatives(most: int, lowest: int, highest: int):
    """Searches the rows of other labels whose score lies in a positive's window, in percent of its score."""

    def search(row, a_ids, a_labels, anchors, ids, labels, matrix):
        by_id = np.argsort(ids, kind="stable")
        ids, labels, matrix = ids[by_id], labels[by_id], matrix[by_id]
        windows: dict[int, list[tuple[int, int]]] = {}
        for p in row["a_positives"]:
            windows.setdefault(p["at"], []).append((p["rank"], p["score"] if p["beyond"] is None else from_order_text(p["beyond"])))
        asked = np.array(sorted(windows), np.int64)
        for begin in range(0, len(asked), SLICE_ANCHORS):
            some = asked[begin : begin + SLICE_ANCHORS]
            found, order = ranked(scores(anchors[some], matrix))
            other = (labels[order] != a_labels[some][:, None]) & (ids[order] != a_ids[some][:, None])
            for k, at in enumerate(some.tolist()):
                line, places = found[k][other[k]], order[k][other[k]]
                falling = -line
                for slot, score in windows[at]:
                    # lowest * score <= 100 x <= highest * score
                    top, bottom = highest * score // 100, -(-lowest * score // 100)
                    start = int(np.searchsorted(falling, -top, "left"))
                    stop = int(np.searchsorted(falling, -bottom, "right"))
                    taken = range(start, min(stop, start + most))
                    yield at, slot, [(int(line[r]), int(ids[places[r]])) for r in taken]

    return search


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, lowest: int = 30, highest: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", *, block_rows: int = BLOCK_ROWS, pack_anchors: int = PACK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``every`` divides. A positive's negatives are the first
    rows of another label that score ``lowest`` to ``highest`` percent of what it scores.
    """
    rows = pick(rows, vec_id=(id_col, "bigint"), label=(label_col, "bigint"), vector=(vector_col, "array<double>"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(SCALE)) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine)
    anchors = rows.where(F.col("vec_id") % every == 0)
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("a")).first()
    parts, packs_of = max(1, -(-count["n"] // block_rows)), max(1, -(-count["a"] // pack_anchors))
    blocks = store(_pack(rows, parts, "block"), "blocks")
    packs = store(_pack(anchors, packs_of, "pack"), "packs")

    near = store(_first(_meet(blocks, packs, parts, positives, _positives(positives)), positives), "positives")
    per_pack = near.groupBy("pack", "dim").agg(F.collect_list(F.struct("at", "rank", "score", "beyond")).alias("positives"))
    asking = store(packs.join(per_pack, ["pack", "dim"]), "asking")
    found = _first(_meet(blocks, asking, parts, negatives, _negatives(negatives, lowest, highest)), negatives)

    anchor_ids = asking.select("pack", "dim", "ids").mapInArrow(_listed, "pack int, dim int, at int, anchor_id bigint")
    named = near.join(anchor_ids, ["pack", "dim", "at"])
    named = named.select("pack", "dim", "at", F.col("rank").alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    both = found.join(named, ["pack", "dim", "at", "slot"])
    return both.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _listed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of every pack, one row each."""
    for frame in frames:
        for pack, dim, raw in zip(*[c.to_pylist() for c in frame.columns]):
            ids = np.frombuffer(raw, "<i8")
            columns = [np.full(len(ids), pack, np.int32), np.full(len(ids), dim, np.int32), np.arange(len(ids), dtype=np.int32), ids]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pack", "dim", "at", "anchor_id"])


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(256 * x::DOUBLE))), true)),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id, o.label, CAST(list_inner_product(a.parts, o.parts) AS BIGINT) AS score
    FROM usable a JOIN usable o ON a.vec_id <> o.vec_id AND len(a.parts) = len(o.parts) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
