import hashlib

import pytest
from bindery.llm import exact_dedup
from bindery.llm.common import attach
from bindery.llm.exact_dedup import build_index, directory, drop_copies, exact_groups, global_depth
from pyspark.sql import functions as F


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    out = []
    for doc, text in rows:
        ids = [d for d, t in rows if folded(t) == folded(text)]
        keep = max((d for d in ids if d is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256(folded(text).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 2])
def test_groups_equal_brute_force_even_if_hashes_collide(awkward, awkward_rows, bits):
    found = exact_groups(awkward, bits=bits, bucket_entries=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect()), key=repr) == expected(awkward_rows)


def test_colliding_texts_are_chained_in_one_bucket(awkward):
    rows = build_index(awkward, bits=1, bucket_entries=1)[0].collect()
    assert len({r.hash for r in rows}) <= 2
    for value in {r.hash for r in rows}:
        chain = sorted(r.chain for r in rows if r.hash == value)
        assert chain == list(range(1, len(chain) + 1))
        assert len({r.bucket for r in rows if r.hash == value}) == 1


def keys(spark, counts, depth):
    """``counts[slot]`` hashes in each slot of ``depth`` leading bits."""
    signed = [(slot << (64 - depth)) + n for slot, many in counts.items() for n in range(many)]
    return spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k,) for k in signed], "hash bigint")


def slots_of(spark, counts, depth, capacity):
    hashes = keys(spark, counts, depth)
    found = directory(hashes, global_depth(hashes, capacity), capacity).collect()
    return global_depth(hashes, capacity), sorted(((r.slot % (1 << 64)) >> (64 - depth), (r.bucket % (1 << 64)) >> (64 - depth), r.local_depth) for r in found)


def test_directory_splits_only_overfull_buckets(spark):
    assert slots_of(spark, {0: 5, 1: 1, 6: 1}, 3, 5) == (3, [(0, 0, 3), (1, 1, 3), (6, 4, 1)])
    assert slots_of(spark, {0: 2, 3: 1, 5: 1}, 3, 9) == (0, [(0, 0, 0)])
    assert slots_of(spark, {}, 3, 9) == (0, [])


def test_directory_doubles_as_far_as_needed(spark):
    """Two hashes that differ in their last bit take all 64."""
    hashes = keys(spark, {5: 2}, 8)
    depth = global_depth(hashes, 1)
    assert depth == 64
    assert sorted((r.slot == r.bucket, r.local_depth) for r in directory(hashes, depth, 1).collect()) == [(True, 64)] * 2


def test_results_come_through_the_index(awkward, monkeypatch):
    """Documents whose entry is not in the bucket the directory names find nothing."""
    whole = exact_dedup.build_index

    def misplaced(*args, **options):
        entries, slots, depth = whole(*args, **options)
        return entries.withColumn("bucket", F.col("bucket") + 1), slots, depth

    monkeypatch.setattr(exact_dedup, "build_index", misplaced)
    assert exact_groups(awkward, bucket_entries=2).where(F.col("group_size").isNotNull()).count() == 0


def test_heavy_copies_are_combined_before_they_are_routed(spark):
    rows = [(n, "Hot" if n % 3 else f"text {n}") for n in range(3000)]
    found = exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), bucket_entries=50).collect()
    assert len(found) == 3000
    for r in found:
        assert (r.keep_id, r.group_size) == ((2999, 2000) if r.doc_id % 3 else (r.doc_id, 1))


def test_empty_table(no_documents):
    assert exact_groups(no_documents).collect() == []
    assert drop_copies(no_documents).collect() == []


def test_dropping_keeps_columns_and_one_of_each(awkward, awkward_rows):
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns
    stays = sorted((d for d, k, _, keep, _ in expected(awkward_rows) if d == k), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == stays


def test_attach_gives_heavy_and_light_classes(spark):
    facts = spark.createDataFrame([(n, 0 if n < 3000 else n) for n in range(4000)] + [(None, None)], "doc_id bigint, code bigint")
    classes = spark.createDataFrame([(0, "hot", 3000)] + [(n, f"c{n}", 1) for n in range(3000, 3990)], "code bigint, name string, n bigint")
    found = attach(facts, classes, ["code"], ["name"], "n", 4001, "doc_id").collect()
    assert len(found) == 4001
    for row in found:
        code = row.code
        assert row.name == (None if code is None or code >= 3990 else "hot" if code == 0 else f"c{code}")
