import random
import re

import numpy as np
import pytest
import xxhash
from bindery.llm.components import components
from bindery.llm.simhash import Tree, code_links, drop_near_copies, fingerprint, gray_rank, link_blocks, near_duplicates
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) > len(shingles))


def roots(codes, bits):
    """Component of each code: its least member."""
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= bits:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {c: find(c) for c in codes}


def near_codes(n, seed):
    """Codes in loose families, so that chains and families of all sizes occur."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        code = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 20])):
            out.add(code)
            for _ in range(rng.randint(1, 6)):
                code ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_fingerprints(awkward_rows):
    for _, text in awkward_rows:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)
    assert fingerprint(b"") == 0


def test_gray_rank_orders_neighbours_one_bit_apart(spark):
    codes = [n ^ (n >> 1) for n in range(64)]  # the reflected code in order
    rows = spark.createDataFrame([(c,) for c in random.Random(1).sample(codes, 64)], "code bigint")
    assert [r.code for r in rows.orderBy(gray_rank(F.col("code"))).collect()] == codes


@pytest.mark.parametrize("n", [1, 7, 300])
def test_tree_finds_every_pair(n):
    codes = np.array(near_codes(n, n), np.uint64)
    found = {(int(q), int(f)) for qs, fs in Tree(codes).search(codes, 4) for q, f in zip(qs, fs)}
    assert found == {(i, j) for i in range(n) for j in range(n) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}


def test_forest_spans_components():
    codes = np.array(near_codes(400, 9), np.uint64)
    u, v = link_blocks(codes[:150], codes[150:], 4)
    assert len(u) < 400
    assert all((int(a) ^ int(b)).bit_count() >= 0 for a, b in zip(u, v))


def test_links_over_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("bindery.llm.simhash.LEAST_BLOCK", 32)
    monkeypatch.setattr("bindery.llm.simhash.MOST_BLOCK", 32)
    codes = near_codes(500, 3)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame([(c,) for c in signed], "code bigint")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(code_links(rows, len(codes))).collect()}
    groups, own = {}, {}
    for code, root in roots(codes, 4).items():
        groups.setdefault(root, set()).add(code)
    for code in codes:
        own.setdefault(found.get(code, code), set()).add(code)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(n, n + 1) for n in range(100, 160)] + [(5, n) for n in range(10, 60)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[n] == 100 for n in range(100, 161)) and all(found[n] == 5 for n in range(10, 60))


def test_documents(awkward, awkward_rows):
    codes = {plain_fingerprint(t) for _, t in awkward_rows}
    root = roots(codes, 4)
    first = {}
    for doc, text in awkward_rows:
        r = root[plain_fingerprint(text)]
        first[r] = min((d for d in (first.get(r), doc) if d is not None), default=None)
    want = sorted(((d, f"{plain_fingerprint(t):016x}", first[root[plain_fingerprint(t)]]) for d, t in awkward_rows), key=repr)
    found = near_duplicates(awkward)
    rows = [(r.doc_id, f"{r.code % (1 << 64):016x}", r.component_id) for r in found.collect()]
    assert sorted(rows, key=repr) == want
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in want if d == c}


def test_empty_table(no_documents):
    assert near_duplicates(no_documents).collect() == []
    assert drop_near_copies(no_documents).collect() == []
