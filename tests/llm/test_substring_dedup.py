import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from bindery.llm import words as words_module
from bindery.llm.bpe import tokenizer
from bindery.llm.encoding import vocabulary
from bindery.llm.substring_dedup import cut_repeats, find_segments, kept_words, merge, remove_repeats, repeated_spans, with_first
from bindery.llm.words import GROUP_BYTES, each_text, hash_groups, hash_text
from pyspark.sql import functions as F

WINDOW = 50


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_force(rows):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - WINDOW + 1):
            if doc is not None:
                key = tuple(w[i : i + WINDOW])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if doc is not None and first[tuple(w[i : i + WINDOW])] < doc:
                gone.update(range(i, i + WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((doc, kept, len(w), len(gone)))
    return sorted(out, key=repr)


def collage(n, seed):
    """Documents made of shared passages, with words changed here and there."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(30, 120))] for _ in range(12)]
    rows = []
    for doc in rng.sample(range(n * 3), n):
        w = [x for _ in range(rng.randint(1, 4)) for x in rng.choice(pool)]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        rows.append((doc, rng.choice([" ", "\n", "  "]).join(w)))
    return rows + [(n * 3 + 1, "a " * 300), (n * 3 + 2, "a " * 200), (n * 3 + 2, "a " * 200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = collage(60, seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=repr) == brute_force(rows)


def test_awkward_documents(awkward, awkward_rows):
    assert sorted(map(tuple, remove_repeats(awkward).collect()), key=repr) == brute_force(awkward_rows)


def test_cutting_leaves_untouched_texts_and_columns(awkward, awkward_rows):
    cut = cut_repeats(awkward)
    assert cut.columns == awkward.columns
    want = {(d, k if n else None) for d, k, _, n in brute_force(awkward_rows)}
    texts = dict(awkward_rows)
    for row in cut.collect():
        assert (row.doc_id, row.text) in want or row.doc_id is None or row.text == texts[row.doc_id]


def test_empty_table(no_documents):
    assert repeated_spans(no_documents).collect() == []
    assert remove_repeats(no_documents).collect() == []
    assert cut_repeats(no_documents).collect() == []


def test_a_passage_of_a_third_of_all_rows_is_dealt_out(spark):
    facts = spark.range(6000).selectExpr("id AS doc_id", "0L AS start", "if(id % 3 = 0, 7L, id) AS k1", "1L AS k2")
    kinds = facts.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_rows")).where("k1 % 2 = 1")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        found = with_first(facts, kinds, ["first_doc"])
        assert found.columns == ["doc_id", "start", "k1", "k2", "first_doc"]
        plain = facts.join(kinds.select("k1", "k2", "first_doc"), ["k1", "k2"]).select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
        per_task = [r["count"] for r in found.where("k1 = 7").groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 4 and max(per_task) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_segments_cover_each_window_once():
    texts = [("a b " * 60).encode(), b"", b"x " * 10, " ".join(f"w{i * i % 97}" for i in range(400)).encode()]
    (_, hashes, offsets), = hash_groups(texts)
    text, start, windows, _ = find_segments(hashes, offsets)
    covered = sorted(s + i for s, n in zip(start, windows) for i in range(n))
    want = [i for t in range(4) for i in range(offsets[t], offsets[t + 1] - WINDOW + 1)]
    assert covered == want


def test_long_texts_are_hashed_alike_in_pieces():
    text = (b"word " * 11 + b"other\n") * (GROUP_BYTES // 20)
    whole = hash_text(text)
    assert len(text) > 2 * GROUP_BYTES and len(set(whole.tolist())) == 2
    assert np.array_equal(whole[:12], hash_text(text[:61]))
    assert len(whole) == len(text.split())


def test_merge_and_kept_words():
    a, b = merge(np.array([5, 0, 8, 30]), np.array([10, 3, 20, 31]))
    assert (a.tolist(), b.tolist()) == ([0, 5, 30], [3, 20, 31])
    assert kept_words(b"a b\tc  d", [{"start": 1, "end": 3}]) == (b"a d", 4, 2)
    long = b"a b " * 20_000
    assert kept_words(long, [{"start": 0, "end": 39_998}]) == (b"a b", 40_000, 39_998)


def test_segments_of_a_long_text_in_little_memory():
    hashes = np.random.default_rng(4).integers(0, 1 << 60, 400_000).astype(np.uint64)
    find_segments(hashes[:1000], np.array([0, 1000]))
    tracemalloc.start()
    text, start, windows, anchor = find_segments(hashes, np.array([0, len(hashes)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * hashes.nbytes  # 43 times with all windows at once
    assert windows.sum() == len(hashes) - 49 and (np.cumsum(windows)[:-1] == start[1:]).all()
    few = find_segments(hashes[:3000], np.array([0, 3000]))
    assert (few[3][:-1] == anchor[: len(few[3]) - 1]).all()


def test_small_groups_give_the_same_hashes():
    texts = [b"", b"one two", None, b"three " * 30_000, b"four five six " * 500] * 4
    whole, small = [], []
    for out, size in ((whole, GROUP_BYTES), (small, 1 << 10)):
        for _, hashes, offsets in hash_groups(texts, group_bytes=size):
            out += [hashes[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert len(small) == len(texts) and whole == small


def test_a_task_on_texts_gives_back_what_a_tokenizer_took(monkeypatch):
    calls = []
    monkeypatch.setattr(words_module, "give_back", lambda: calls.append(1))
    tokenizer(vocabulary())
    assert list(each_text(pa.array(["a", None]))) == [b"a", None] and calls == [1]
    list(each_text(pa.array(["a"])))
    assert calls == [1] and not tokenizer.cache_info().currsize
