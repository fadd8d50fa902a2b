import random

import numpy as np
from bindery.llm import lm_score
from bindery.llm.lm_score import OUTSIDE, TOKENS, Trainer, contexts, flatten, log_probabilities, new_network, score_documents, token_ids, train, unflatten
from bindery.llm.words import hash_text
from bindery.operators.joins import join_dimension


def test_contexts_stop_at_the_ends_of_texts():
    around = contexts(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]))
    assert around.tolist() == [[OUTSIDE, OUTSIDE, 2, 3], [OUTSIDE, 1, 3, OUTSIDE], [1, 2, OUTSIDE, OUTSIDE], [OUTSIDE] * 4]


def test_probabilities_of_all_tokens_add_up():
    net, around = new_network(), np.array([[1, 2, 3, OUTSIDE]])
    every = log_probabilities(net, np.arange(TOKENS), np.repeat(around, TOKENS, axis=0))
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_gradients(monkeypatch):
    monkeypatch.setattr(lm_score, "RATE", 1.0)
    rng = np.random.default_rng(0)
    ids, around = rng.integers(0, TOKENS, 40).astype(np.int32), rng.integers(0, TOKENS + 1, (40, 4)).astype(np.int32)

    class Plain(Trainer):
        def _apply(self, name, slope, where=slice(None)):
            self.found = getattr(self, "found", {name: None})
            full = self.found.setdefault(name, None)
            full = np.zeros(self.net[name].shape) if full is None else full
            full[where] += slope
            self.found[name] = full

    trainer = Plain(new_network())
    trainer.step(ids, around)
    net = {n: v.astype(np.float64) for n, v in new_network().items()}
    for name in net:
        flat = trainer.found[name].ravel()
        for place in np.argsort(-np.abs(flat))[:3]:
            values = []
            for shift in (1e-4, -1e-4):
                moved = {n: v.copy() for n, v in net.items()}
                moved[name].ravel()[place] += shift
                values.append(-log_probabilities(moved, ids, around).mean())
            assert abs((values[0] - values[1]) / 2e-4 - flat[place]) < 1e-3


def test_parameters_survive_flattening():
    net = new_network()
    again = unflatten(flatten(net))
    assert all(np.array_equal(net[n], again[n]) for n in net)


def sentences(n, seed):
    rng = random.Random(seed)
    words = {s: [f"{s}{i}" for i in range(30)] for s in "abc"}
    return [(i, " ".join(rng.choice(words["abc"[(k + i) % 3]]) for k in range(rng.randint(30, 90)))) for i in range(n)]


def test_ordered_texts_score_above_shuffled_ones(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 64)
    docs = spark.createDataFrame(sentences(400, 1), "doc_id bigint, text string").repartition(2)
    words, net = train(docs)
    plain = sentences(40, 2)
    rng = random.Random(3)
    mixed = [(100 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in plain]
    rows = {r.doc_id: r.log_prob / r.n_tokens for r in score_documents(spark.createDataFrame(plain + mixed, "doc_id bigint, text string"), words, net).collect()}
    assert np.mean([rows[i] for i in range(40)]) > np.mean([rows[100 + i] for i in range(40)]) + 0.3


def test_awkward_and_empty_tables(awkward, awkward_rows, no_documents):
    words, net = train(awkward)
    rows = score_documents(awkward, words, net).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, _ in awkward_rows), key=repr)
    for row in rows:
        assert row.log_prob <= 0 and (row.n_tokens > 0 or row.log_prob == 0)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    words, net = train(no_documents)
    assert score_documents(no_documents, words, net).collect() == []
    assert all(r.log_prob <= 0 for r in score_documents(awkward, words, net).collect())


def test_rare_words_share_buckets():
    vocabulary, ranks = np.array([5, 9], np.uint64), np.array([1, 0], np.int32)
    assert token_ids(np.array([9, 5, 6], np.uint64), vocabulary, ranks).tolist() == [0, 1, lm_score.FREQUENT + 6]


def test_rare_words_are_scored_as_themselves(spark, monkeypatch):
    """Two words of one bucket differ by their counts, on both ways to the table of words."""
    names = [f"w{i}" for i in range(lm_score.FREQUENT)]
    buckets: dict[int, list[str]] = {}
    for i in range(300):
        buckets.setdefault(int(hash_text(f"r{i}".encode())[0]) % lm_score.BUCKETS, []).append(f"r{i}")
    often, once, never = next(b for b in buckets.values() if len(b) >= 3)[:3]
    texts = [" ".join(names)] * 9 + [" ".join([often] * 5 + [once])] + [f"r{i}" for i in range(300) if f"r{i}" not in (often, once, never)]
    words, net = train(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    asked = [(n, f"w1 w2 {w} w3 {w}") for n, w in enumerate([often, once, never, "w4"])] + [(0, f"w1 w2 {often} w3 {often}"), (9, None)]
    frame = spark.createDataFrame(asked, "doc_id bigint, text string")
    rows = score_documents(frame, words, net).collect()
    found = {r.doc_id: r.log_prob for r in rows}
    assert abs(found[0] - found[1] - 2 * np.log(5)) < 1e-6
    assert abs(found[1] - found[2]) < 1e-6 and found[9] == 0
    for small_join in (1 << 25, 0):
        monkeypatch.setattr(lm_score, "MOST_SENT", 2)
        monkeypatch.setattr(lm_score, "join_dimension", lambda *a, **k: join_dimension(*a, **k, broadcast_bytes=small_join))
        again = score_documents(frame, words, net).collect()
        assert sorted((r.doc_id, r.n_tokens, round(r.log_prob, 6)) for r in again) == sorted((r.doc_id, r.n_tokens, round(r.log_prob, 6)) for r in rows)
