"""Nearest neighbours by cosine through a few stable projections and kd-trees.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions. For two vectors at
distance d the projected squared distance is d squared times a chi-square variable, which
gives a stopping test: once the nearest unseen projected point is so far away that the
k-th best distance found would be exceeded with probability ``CERTAINTY``, a query is done.

1. Equal vectors become one row with its smallest ids; more are never needed, however many
   copies there are.
2. Only vectors of one length have a cosine, so every length has a space of its own. A kd-tree
   over its projections cuts it into cells; every row is put into its cell. The trees are
   fitted to a sample of at most ``SAMPLE_ROWS`` rows and have at most ``MOST_CELLS`` cells
   together, shared out by rows; a length of up to ``CELL_ROWS`` rows is one cell. Cells that
   are overfull are split by hash, so that a block never exceeds about ``BLOCK_ROWS`` rows.
3. A query searches its own cell, then the cells whose box its test does not rule out.
   In a block it takes the leaves of a kd-tree in order of projected distance and verifies
   their vectors until the test holds.

Queries meet blocks in groups of at most about ``GROUP_QUERIES``. The driver holds the
sample, and boxes and sizes of the cells of lengths with more than ``CELL_ROWS`` rows: at most
``MOST_CELLS`` and one for each such length.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, and neither do rows with a null id; the candidates of a query are the vectors of its own
length, so a vector that is alone in its length has no rows; a repeated id is never its own neighbour, and is a query for each of its distinct vectors;
equal scores go to the smaller id; fewer candidates than asked for give fewer rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import attach, pick
from bindery.session import store

PROJECTIONS = 8
CERTAINTY = 0.98
SEED = 20
SAMPLE_ROWS = 16_384
CELL_ROWS = 2048
MOST_CELLS = 4096
BLOCK_ROWS = 4096
GROUP_QUERIES = 4096
LEAF_ROWS = 64
LEAVES_AT_ONCE = 4
SPREAD_ROWS = 256


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi_square_limit(probability: float, degrees: int) -> float:
    low, high = 0.0, 100.0 * degrees
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < probability else (low, middle)
    return high


LIMIT = chi_square_limit(CERTAINTY, PROJECTIONS)


def directions(dimension: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimension, PROJECTIONS))


def project(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ directions(vectors.shape[1])


def fit_cells(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Cuts of a complete kd-tree in heap order: axis of widest spread, median."""
    cuts, groups = [], [points]
    for _ in range(depth):
        halves = []
        for group in groups:
            axis = int(np.ptp(group, axis=0).argmax()) if len(group) else 0
            cut = float(np.median(group[:, axis])) if len(group) else 0.0
            cuts.append((axis, cut))
            halves += [group[group[:, axis] <= cut], group[group[:, axis] > cut]]
        groups = halves
    return cuts


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    axes = np.array([a for a, _ in cuts], np.int64)
    values = np.array([c for _, c in cuts])
    node = np.zeros(len(points), np.int64)
    while len(cuts) and len(points) and node[0] < len(cuts):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
    return node - len(cuts)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes, one row per point."""
    out = np.empty((len(points), len(low)))
    for at in range(0, len(points), 256):
        some = points[at : at + 256, None, :]
        gap = np.maximum(np.maximum(low - some, some - high), 0)
        out[at : at + 256] = (gap * gap).sum(axis=2)
    return out


class Block:
    """A kd-tree over one block's projections with the original vectors at its leaves."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        points = project(vectors)
        leaves = [np.arange(len(vectors))]
        while len(leaves[0]) > LEAF_ROWS:
            halves = []
            for rows in leaves:
                spread = points[rows]
                axis = int(np.ptp(spread, axis=0).argmax()) if len(rows) else 0
                order = rows[np.argsort(spread[:, axis], kind="stable")]
                halves += [order[: (len(rows) + 1) // 2], order[(len(rows) + 1) // 2 :]]
            leaves = halves
        leaves = [rows for rows in leaves if len(rows)]
        self.leaves = leaves
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])
        self.vectors, self.ids = vectors, ids
        self.norms = np.linalg.norm(vectors, axis=1)

    def search(self, query: np.ndarray, near: np.ndarray, worst: float, k: int) -> list[tuple[float, int]]:
        """The best ``k`` (score, id), given squared projected distances of the leaves and a score to beat."""
        best: list[tuple[float, int]] = []
        order, norm = np.argsort(near, kind="stable"), float(np.linalg.norm(query))
        for at in range(0, len(order), LEAVES_AT_ONCE):
            if near[order[at]] > LIMIT * max(0.0, 2 - 2 * worst):
                break
            rows = np.concatenate([self.leaves[n] for n in order[at : at + LEAVES_AT_ONCE]])
            scores = self.vectors[rows] @ query / (self.norms[rows] * norm)
            for row in rows[scores >= worst - 1e-9]:
                score = cosine(self.vectors[row], query)
                best += [(score, int(i)) for i in self.ids[row]]
            best = sorted(best, key=lambda s: (-s[0], s[1]))[:k]
            if len(best) == k:
                worst = max(worst, best[-1][0])
        return best


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double precision, the same for a pair wherever it is computed."""
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows with an id whose vector can have a cosine with the others."""
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def depths(counts: dict[int, int]) -> dict[int, int]:
    """Depth of the tree of each length: cells of about ``CELL_ROWS`` rows, at most ``MOST_CELLS`` in all."""
    total = max(1, sum(counts.values()))
    return {
        length: max(0, min(math.ceil(math.log2(n / CELL_ROWS)), math.floor(math.log2(MOST_CELLS * n / total))))
        for length, n in counts.items()
    }


def _distinct(rows: DataFrame, every: int, k: int) -> DataFrame:
    """One row per distinct vector: its ``k`` smallest ids and how many queries it stands for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame["vector"].map(lambda v: v.tobytes())
            frame = frame.assign(key=keys, asks=(frame["vec_id"] % every == 0).astype("int64")).sort_values("vec_id")
            grouped = frame.groupby("key", sort=False)
            out = grouped.agg(vector=("vector", "first"), ids=("vec_id", lambda s: list(dict.fromkeys(s))[:k]), n_queries=("asks", "sum"))
            yield out.reset_index(drop=True)

    seen = rows.mapInPandas(run, "vector array<double>, ids array<bigint>, n_queries bigint")
    ids = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)
    return seen.groupBy("vector").agg(ids.alias("ids"), F.sum("n_queries").alias("n_queries")).select(
        F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"), "vector", "ids", "n_queries"
    )


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _meet(blocks: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Searches every visited block: ``k1, k2, found`` per query and block."""
    needed = visits.select(F.col("cell").alias("at_cell"), F.col("part").alias("at_part"), F.col("group").alias("for_group")).distinct()
    held = blocks.select(F.col("cell").alias("at_cell"), F.col("part").alias("at_part"), F.col("vector").alias("held"), F.col("ids").alias("held_ids"))
    sides = held.join(needed, ["at_cell", "at_part"])

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"k1": [], "k2": [], "scores": [], "ids": []})
        block = Block(_stacked(rows["held"]), rows["held_ids"].tolist())
        vectors = _stacked(queries["vector"])
        near = box_distance(project(vectors), block.low, block.high)
        found = [block.search(v, n, w, k) for v, n, w in zip(vectors, near, queries["worst"])]
        return pd.DataFrame({"k1": queries["k1"], "k2": queries["k2"], "scores": [[s for s, _ in f] for f in found], "ids": [[i for _, i in f] for f in found]})

    met = sides.groupBy("at_cell", "at_part", "for_group").cogroup(visits.groupBy("cell", "part", "group"))
    return met.applyInPandas(run, "k1 bigint, k2 bigint, scores array<double>, ids array<bigint>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """``k1, k2, near``: the best ``k`` (score, id) of each query over all its blocks."""
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("order"), F.col("ids").alias("id"), F.col("scores").alias("score"))))
    return found.groupBy("k1", "k2").agg(F.slice(F.sort_array(F.array_distinct(pairs)), 1, k).alias("near"))


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each id divisible by ``every``."""
    rows = _usable(pick(vectors, vec_id=(id_col, "bigint"), vector=(vector_col, "array<double>")))
    kinds = store(_distinct(rows, every, k + 1), "vectors")
    counts = kinds.agg(F.coalesce(F.sum(F.when(F.col("n_queries") > 0, 1)), F.lit(0)).alias("q"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("asked")).first()
    length = F.size("vector")
    large = kinds.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_ROWS).collect()
    tall = {n: depth for n, depth in depths({r["length"]: r["n"] for r in large}).items() if depth}
    sample: dict[int, list] = {n: [] for n in tall}
    for r in kinds.where(length.isin(*tall)).orderBy("k2", "k1").limit(SAMPLE_ROWS).select("vector").collect() if tall else []:
        sample[len(r["vector"])].append(r["vector"])
    cuts = {n: fit_cells(project(np.array(some).reshape(-1, n)), tall[n]) for n, some in sample.items()}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, some in frame.groupby(frame["vector"].map(len)):
                points = project(_stacked(some["vector"]))
                yield some.assign(cell=n * MOST_CELLS + cell_of(points, cuts.get(n, [])), point=list(points))

    placed = store(kinds.mapInPandas(place, "k1 bigint, k2 bigint, vector array<double>, ids array<bigint>, n_queries bigint, cell bigint, point array<double>"), "placed")
    axes = range(PROJECTIONS)
    bounds = [f(F.col("point")[a]).alias(f"{n}{a}") for n, f in (("low", F.min), ("high", F.max)) for a in axes]
    listed = placed.where(length.isin(*[r["length"] for r in large])) if large else placed.limit(0)
    boxes = sorted(listed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *bounds).collect(), key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in boxes], np.int64)
    parts = np.array([-(-r["n"] // BLOCK_ROWS) for r in boxes], np.int64)
    low, high = (np.array([[r[f"{n}{a}"] for a in axes] for r in boxes]).reshape(-1, PROJECTIONS) for n in ("low", "high"))
    split = vectors.sparkSession.createDataFrame([(int(c), int(p)) for c, p in zip(cells, parts)], "cell bigint, in_parts bigint")

    def with_parts(rows: DataFrame) -> DataFrame:
        """``parts``: blocks of the row's cell. Cells that are not listed are one block."""
        return rows.join(F.broadcast(split), "cell", "left").withColumn("parts", F.coalesce("in_parts", F.lit(1).cast("bigint"))).drop("in_parts")

    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    blocks = with_parts(placed).withColumn("part", F.pmod("k2", "parts"))
    groups = max(1, -(-counts["q"] // GROUP_QUERIES))
    queries = placed.where("n_queries > 0").withColumn("group", F.pmod(F.col("k1"), F.lit(groups)))
    here = with_parts(queries.withColumn("worst", F.lit(-2.0))).withColumn("part", every_part)
    asked = ["cell", "part", "group", "k1", "k2", "vector", "worst"]
    first = store(_meet(blocks, store(here.select(*asked), "asked"), k + 1), "near-first")
    reached = _best(first, k + 1).select("k1", "k2", F.when(F.size("near") > k, F.col("near")[k]["score"]).otherwise(-2.0).alias("worst"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per query and further cell, a slice of the queries at a time."""
        for frame in frames:
            for _, same in frame.groupby(frame["cell"] // MOST_CELLS):
                own = np.flatnonzero(cells // MOST_CELLS == same["cell"].iloc[0] // MOST_CELLS)
                for at in range(0, len(same) if len(own) > 1 else 0, SPREAD_ROWS):
                    some = same.iloc[at : at + SPREAD_ROWS]
                    away = box_distance(_stacked(some["point"]), low[own], high[own])
                    near = away <= LIMIT * np.maximum(0, 2 - 2 * some["worst"].to_numpy())[:, None]
                    row, box = np.nonzero(near & (cells[own] != some["cell"].to_numpy()[:, None]))
                    for cut in range(0, len(row), GROUP_QUERIES):
                        out = some.iloc[row[cut : cut + GROUP_QUERIES]]
                        yield out.assign(cell=cells[own][box[cut : cut + GROUP_QUERIES]])[["cell", "group", "k1", "k2", "vector", "worst"]]

    kind = "cell bigint, group bigint, k1 bigint, k2 bigint, vector array<double>, worst double"
    further = queries.where(length.isin(*tall)) if tall else queries.limit(0)
    visits = further.join(reached, ["k1", "k2"]).select("k1", "k2", "vector", "worst", "group", "cell", "point").mapInPandas(spread, kind)
    visits = with_parts(visits).withColumn("part", every_part).select(*asked)
    found = _best(first.union(_meet(blocks, store(visits, "visits"), k + 1)), k + 1)
    classes = found.join(kinds.where("n_queries > 0").select("k1", "k2", "n_queries"), ["k1", "k2"])
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")).distinct()
    answered = attach(asking, store(classes, "near"), ["k1", "k2"], ["near"], "n_queries", counts["asked"], "vec_id")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    listed = answered.select(F.col("vec_id").alias("query_id"), "near").select("query_id", F.posexplode(others))
    return listed.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["id"].alias("vec_id"), F.col("col")["score"].alias("score"))


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)
