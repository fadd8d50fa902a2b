import random
import zlib
from collections import Counter

import numpy as np
import pytest
from bindery.llm import toxicity
from bindery.llm.toxicity import Model, _count_pairs, _count_words, drop_toxic, excess, fit, fit_scale, fit_scale_rows, pair_key, score_toxicity
from bindery.llm.words import PUNCTUATION, hash_text

PLAIN = [f"word{n}" for n in range(400)]
INSULTS = [f"insult{n}" for n in range(8)]


def corpus(n, seed):
    """Plain words, some of them only in one document; insults or a bad pair of plain words in toxic ones."""
    rng = random.Random(seed)
    docs, labels = [], []
    for doc in range(n):
        size = rng.randint(20, 200)
        w = [rng.choice(PLAIN) if rng.random() < 0.8 else f"rare{doc}x{rng.randrange(50)}" for _ in range(size)]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, size // 40)):
                if rng.random() < 0.7:
                    w[rng.randrange(size)] = rng.choice(INSULTS) + rng.choice(["", ".", "!"])
                else:
                    w[rng.randrange(size)] = "Word1 word2"
        docs.append((doc, " ".join(w)))
        labels.append((doc, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(1500, 1)
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, dict(labels), frames, fit(*frames)


def test_held_out_accuracy(fitted):
    docs, labels, (frame, _), model = fitted
    rows = score_toxicity(frame, model).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert len(held) > 200
    assert np.mean([labels[r.doc_id] == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_only_telling_expressions_are_kept(fitted):
    model = fitted[3]
    assert 1 <= len(model.words) < 40
    assert len(model.pairs) >= 1  # the bad pair of plain words


def test_awkward_documents(fitted, awkward, awkward_rows):
    rows = score_toxicity(awkward, fitted[3]).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, _ in awkward_rows), key=repr)
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop() < 0.5


def test_dropping(fitted, spark):
    docs, labels, (frame, label_frame), model = fitted
    clash = frame.selectExpr("*", "1 AS score", "'r' AS ratio", "doc_id AS row")
    kept = drop_toxic(clash, label_frame)
    assert kept.columns == clash.columns
    gone = {d for d, _ in docs} - {r.doc_id for r in kept.collect()}
    assert gone == {r.doc_id for r in score_toxicity(frame, model).where("predicted = 1").collect()}


def test_without_labels_or_documents(spark, awkward, no_documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    odd = spark.createDataFrame([(None, 1), (4, None), (5, 0), (12, 0)], "doc_id bigint, toxic int")
    for labels in (none, odd):
        model = fit(awkward, labels)
        assert {r.predicted for r in score_toxicity(awkward, model).collect()} == {0}
        assert drop_toxic(awkward, labels).count() == awkward.count()
        assert score_toxicity(no_documents, model).collect() == []
    assert fit(no_documents, odd).slope == 0


def test_excess_ignores_what_both_classes_share():
    counts = [np.array([90.0, 9.0, 0.0, 30.0]), np.array([30.0, 3.0, 40.0, 10.0])]
    over = excess(counts, [129.0, 83.0], [0.0, 0.0])
    assert (over[0] == 0).all() and list(over[1] > 0) == [False, False, True, False]
    assert excess(counts, [129.0, 83.0], [0.0, 0.4])[1].tolist() == [0, 0, 0, 0]


def test_scale():
    x = np.array([-1.0, -0.8, -0.9, 0.9, 1.2])
    slope, intercept = fit_scale(x, np.array([0, 0, 0, 1, 1.0]))
    assert Model(slope=slope, intercept=intercept).score(x).round().tolist() == [0, 0, 0, 1, 1]
    assert fit_scale(x, np.zeros(5)) == (0.0, -500.0)
    assert fit_scale(np.empty(0), np.empty(0)) == (0.0, -500.0)


def test_an_insult_after_one_word_only(spark):
    """An insult that always follows the same word and a pair that always does count by their documents."""
    rng = random.Random(5)
    docs, labels = [], []
    for doc in range(600):
        w = [rng.choice(PLAIN) for _ in range(60)]
        toxic = doc % 4 == 0
        if toxic:
            at = rng.randrange(1, 50)
            w[at : at + 2] = ["word7", "fool"] if doc % 8 else ["word3", "word9"]
            w[at - 1] = "always"
        else:
            at = rng.randrange(1, 50)
            w[at - 1] = "always"
        docs.append((doc, " ".join(w)))
        labels.append((doc, int(toxic)))
    model = fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    fool, pair = hash_text(b"fool"), hash_text(b"word3 word9")
    assert fool[0] in model.words and model.word_ratio[model.words == fool[0]][0] > 1
    key = pair_key(pair[:1], pair[1:])[0]
    assert key in model.pairs and model.pair_ratio[model.pairs == key][0] > 1


def test_every_labelled_row_is_learned_from(spark):
    """40,000 labelled rows, each insult in a few documents of its own: none of them is left out."""
    rng = random.Random(3)
    docs, labels = [], []
    for doc in range(40_000):
        w = [rng.choice(PLAIN[:60]) for _ in range(6)]
        toxic = doc % 10 == 0
        if toxic:
            w[rng.randrange(6)] = f"slur{doc // 100}"
        docs.append((doc, " ".join(w + [str(doc)])))
        labels.append((doc, int(toxic)))
    model = fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    holders = {}
    for doc, _ in labels[::10]:
        if zlib.crc32(str(doc).encode()) % 5 > 1:
            holders[doc // 100] = holders.get(doc // 100, 0) + 1
    often = {n for n, count in holders.items() if count >= 5}
    assert len(often) > 100
    missing = {n for n in often if hash_text(f"slur{n}".encode())[0] not in model.words}
    assert not missing


def test_counts_against_brute_force(spark):
    docs, labels = corpus(400, 8)
    training = spark.createDataFrame([(toxic, text) for (_, text), (_, toxic) in zip(docs, labels)], "toxic int, text string").repartition(3)
    known, totals = _count_words(training)
    held, pairs = Counter(), Counter()
    for (_, text), (_, toxic) in zip(docs, labels):
        w = hash_text(text.lower().encode(), blanks=PUNCTUATION).tolist()
        held.update((x, toxic) for x in set(w))
        pairs.update((b, x, toxic) for b, x in set(zip(w, w[1:])))
    assert totals == [sum(n for (_, c), n in held.items() if c == k) for k in (0, 1)]
    here = {w for w, _ in held if held[w, 0] + held[w, 1] > 1}
    after = Counter()
    for (b, x, c), n in pairs.items():
        if x in here:
            after[b, c] += n
    found = {r.word % 2**64: (r.c0, r.c1, r.t0, r.t1) for r in known.collect()}
    assert found == {w: (held[w, 0], held[w, 1], after[w, 0], after[w, 1]) for w in here}
    many = {(b, x) for b, x, c in pairs if pairs[b, x, c] > 1}
    found = {(r.before % 2**64, r.word % 2**64): (r.n0, r.n1) for r in _count_pairs(training).collect()}
    assert found == {(b, x): (pairs[b, x, 0], pairs[b, x, 1]) for b, x in many}


def test_copies_count_once(fitted):
    _, _, (frame, labels), model = fitted
    twice = fit(frame.union(frame), labels)
    for one, other in ((model.words, twice.words), (model.pairs, twice.pairs), (model.word_ratio, twice.word_ratio), (model.pair_ratio, twice.pair_ratio)):
        assert one.tolist() == pytest.approx(other.tolist())


def test_a_table_too_large_to_send_is_joined(fitted, awkward, monkeypatch):
    _, _, (frame, labels), model = fitted
    monkeypatch.setattr(toxicity, "MOST_SENT", 0)
    joined = fit(frame, labels)
    assert joined.weights is not None and not len(joined.words)
    assert (joined.slope, joined.intercept) == pytest.approx((model.slope, model.intercept))
    for rows in (frame, frame.union(frame.limit(50)), awkward):
        want, got = (sorted((r.score, r.predicted) for r in score_toxicity(rows, m).collect()) for m in (model, joined))
        assert np.allclose(want, got, rtol=1e-6, atol=1e-12)


def test_scale_of_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 1).astype(float)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "ratio double, toxic int")
    assert fit_scale_rows(rows) == pytest.approx(fit_scale(x, y))
    assert fit_scale_rows(rows.where("toxic = 0")) == (0.0, -500.0)
    assert fit_scale_rows(rows.where("toxic > 1")) == (0.0, -500.0)
