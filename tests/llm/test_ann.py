import math

import numpy as np
import pytest
from bindery.llm import ann
from bindery.llm.ann import Block, box_distance, cell_of, chi_square, chi_square_limit, cosine, fit_cells, nearest


def brute_force(rows, every, k):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable.append((i, np.array(v, np.float64)))
    out = {}
    for q, v in usable:
        if q % every == 0:
            best = sorted({(-cosine(w, v), i) for i, w in usable if i != q and len(w) == len(v)})[:k]
            if best:
                out[q] = [(i, -s) for s, i in best]
    return out


def found(df, every, k):
    out = {}
    for r in sorted(nearest(df, every, k).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def clusters(n, dimension, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dimension))
    return [(i, (centres[i % 8] + 0.3 * rng.standard_normal(dimension)).astype(np.float32).tolist()) for i in range(n)]


def test_chi_square():
    assert abs(chi_square(chi_square_limit(0.95, 8), 8) - 0.95) < 1e-9
    assert abs(chi_square_limit(0.95, 8) - 15.507) < 1e-3


def test_recall_over_many_cells_and_blocks(spark, monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 40), ("GROUP_QUERIES", 7), ("LEAF_ROWS", 8), ("LEAVES_AT_ONCE", 2)):
        monkeypatch.setattr(ann, name, value)
    rows = clusters(900, 24, 1)
    want, got = brute_force(rows, 10, 5), found(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4), 10, 5)
    assert set(want) == set(got)
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want]
    assert np.mean(hits) / 5 >= 0.9
    scores = {q: dict(brute_force(rows, 10, 900)[q]) for q in list(want)[:5]}
    assert all(s == scores[q][i] for q in scores for i, s in got[q])


def test_every_length_is_searched(spark, monkeypatch):
    """Two lengths with many cells, a rare one and one of a single vector, dealt over all partitions."""
    for name, value in (("CELL_ROWS", 60), ("BLOCK_ROWS", 40), ("GROUP_QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    parts = [clusters(400, 24, 1), clusters(300, 16, 2), clusters(30, 3, 3), [(0, [1.0, 2.0])]]
    rows = [(4 * i + at, v) for at, part in enumerate(parts) for i, v in part]
    want, got = brute_force(rows, 5, 5), found(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4), 5, 5)
    assert set(want) == set(got) and {len(dict(rows)[q]) for q in got} == {24, 16, 3}
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want]
    assert np.mean(hits) / 5 >= 0.9
    assert all(len(dict(rows)[i]) == len(dict(rows)[q]) for q in got for i, _ in got[q])


def test_cells_are_shared_out_by_rows():
    assert ann.depths({64: 10**9}) == {64: 12}
    several = ann.depths({64: 10**9, 32: 10**9, 8: 10**6, 3: 3000})
    assert several == {64: 10, 32: 10, 8: 1, 3: 0} and sum(2**d for d in several.values()) <= ann.MOST_CELLS
    assert ann.depths({64: 5000}) == {64: 2} and ann.depths({}) == {}


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.0]) for i in range(40)] + [(40, [2.0, 4.0, 0.0]), (50, [0.0, 0.0, 1.0]), (50, [0.0, 0.0, 1.0]), (60, [1.0, 0.0, 0.0])]
    rows += [(61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 0.0]), (70, [float("nan"), 1.0, 0.0]), (71, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (80, [1.0]), (90, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS cell", "2 AS part", "3 AS ids", "4 AS k1")
    want, got = brute_force(rows, 10, 5), found(df, 10, 5)
    assert want == got
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[30]] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i * 10, [1.0, float(i)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert found(df, 10, 5) == brute_force(rows, 10, 5)


def test_cells_and_boxes():
    points = np.random.default_rng(2).standard_normal((500, ann.PROJECTIONS))
    cuts = fit_cells(points, 3)
    cells = cell_of(points, cuts)
    assert np.bincount(cells).tolist() == [63, 62, 63, 62, 63, 62, 63, 62] or np.bincount(cells).min() > 55
    assert cell_of(points, []).tolist() == [0] * 500
    away = box_distance(points, points[:2], points[:2])
    assert np.allclose(away[:, 1], ((points - points[1]) ** 2).sum(axis=1))


def test_block_search_is_exact_without_a_stop(monkeypatch):
    monkeypatch.setattr(ann, "LIMIT", 1e9)
    rows = clusters(300, 16, 5)
    vectors = np.array([v for _, v in rows])
    block = Block(vectors, [np.array([i]) for i, _ in rows])
    near = box_distance(ann.project(vectors[:1]), block.low, block.high)[0]
    best = block.search(vectors[0], near, -2.0, 6)
    assert [i for _, i in best][1:] == [i for i, _ in brute_force(rows, 1000, 5)[0]]
