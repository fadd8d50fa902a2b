"""Hard negatives against plain whole-number loops; packed products against plain ones."""

import math
import random

import numpy as np
import pytest
from bindery.llm import hard_negatives as module
from bindery.llm.hard_negatives import fits_doubles, from_order_text, hard_negatives, order_text, packed_scores, ranked, scores, wide_scores

SCHEMA = "vec_id bigint, embedding array<double>, label int, block int, pack string, ids int, score double, rank string"


def brute_force(rows, every=100, positives=5, negatives=10, lowest=30, highest=90):
    usable = []
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
            continue
        usable.append((i, [math.floor(256 * x) for x in vector], label))
    out = []
    for anchor, a, own in usable:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, label) for i, v, label in usable if i != anchor and len(v) == len(a))
        for p, positive, _ in [s for s in scored if s[2] == own][:positives]:
            fit = [s for s in scored if s[2] != own and lowest * -p <= 100 * -s[0] <= highest * -p][:negatives]
            cut = lambda x: min(max(x, -(2**63)), 2**63 - 1)
            out += [(anchor, positive, n, i, cut(-p), cut(-s)) for n, (s, i, _) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, 0.5, "r") for r in rows], SCHEMA).repartition(5)


def unit(rng, n):
    v = [rng.gauss(0, 1) for _ in range(n)]
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v]


def test_against_loops(spark):
    rng = random.Random(13)
    centres = [unit(rng, 16) for _ in range(3)]
    rows = []
    for n in range(900):
        near = rng.choice(centres)
        rows.append((n, [x + rng.gauss(0, 0.2) for x in near], rng.randint(0, 3)))
    rows += [(100, rows[100][1], 1), (205, rows[5][1], 2), (206, rows[5][1], 2), (207, rows[5][1], 0)]
    rows += [(1000, None, 1), (1100, [0.5] * 16, None), (1200, [float("nan")] * 16, 1), (1300, [0.1, None], 1), (1400, [float("inf")], 1), (1500, [1e307] * 2, 1)]
    rows += [(None, rows[0][1], 1), (1600, [0.0] * 16, 1), (1700, [], 1), (1701, [], 1), (1702, [], 2), (1800, [0.5, 0.5], 9)]
    rows += [(1900, [0.5, 0.2, 0.1], 1)] + [(1901 + n, [rng.random() for _ in range(3)], n % 2) for n in range(40)]
    found = hard_negatives(frame(spark, rows), block_rows=100, pack_anchors=4)
    assert sorted(map(tuple, found.collect())) == brute_force(rows)


def test_common_vector_and_rare_labels(spark):
    rng = random.Random(14)
    rows = [(n, [0.25, 0.5, -0.25, 0.1], n % 2) for n in range(400)] + [(400 + n, [rng.random() for _ in range(4)], n) for n in range(300)]
    found = hard_negatives(frame(spark, rows), every=50, block_rows=64, pack_anchors=3)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, every=50)


def test_huge_components(spark):
    rng = random.Random(15)
    rows = [(n, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(0, 25) for _ in range(3)], n % 3) for n in range(120)]
    rows += [(200 + n, [float(2**60), float(n), 2.0], n % 2) for n in range(30)]
    found = hard_negatives(frame(spark, rows), every=10, block_rows=50, pack_anchors=4)
    assert sorted(map(tuple, found.collect())) == brute_force(rows, every=10)


def test_no_rows(spark):
    found = hard_negatives(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.count() == 0


@pytest.mark.parametrize("top", [1, 3, 256, 5000, 100_000])
@pytest.mark.parametrize("dim", [0, 1, 7, 64])
def test_packed_products(top, dim):
    rng = np.random.default_rng(top + dim)
    a, c = (np.floor(rng.uniform(-top, top, (n, dim))) for n in (9, 31))
    wanted = [[int(sum(int(x) * int(y) for x, y in zip(p, q))) for q in c] for p in a]
    assert scores(a, c).tolist() == wanted
    assert wide_scores(a, c).tolist() == wanted
    if fits_doubles(a, c):
        assert packed_scores(a, c).tolist() == wanted


def test_far_off_components():
    # Small spread far from zero: the bias is large, the fields are narrow.
    a, c = np.full((2, 8), 1000.0) + np.arange(8), np.full((5, 8), -2000.0) - np.arange(5)[:, None]
    assert fits_doubles(a, c)
    assert packed_scores(a, c).tolist() == (a @ c.T).astype(int).tolist()


def test_ranked_is_stable():
    line = np.array([[3, 5, 5, -2, 3], [0, 0, 0, 0, 0]])
    for kind in (np.int64, object):
        found, order = ranked(line.astype(kind))
        assert found.tolist() == [[5, 5, 3, 3, -2], [0] * 5]
        assert order.tolist() == [[1, 2, 0, 4, 3], [0, 1, 2, 3, 4]]


def test_numbers_beyond_a_long_sort_as_texts():
    numbers = sorted([2**63, 2**64, 10**40, 10**39 + 1, -(2**63) - 1, -(10**40), -(10**39) - 5, -(2**70)])
    texts = [order_text(x) for x in numbers]
    assert texts == sorted(texts) and [from_order_text(t) for t in texts] == numbers
    assert order_text(2**63 - 1) is None and module.LONG[0] == -(2**63)
