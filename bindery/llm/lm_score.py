"""Scores documents by masked pseudo-likelihood under a small bidirectional network.

Every word is predicted from the two words before and after it: embeddings of the four,
one hidden layer, and a three-step choice: group of the token, token in its group, word in
its token. A document's score is the sum of the log-probabilities of its words.

Spark counts every word of all documents. The ``FREQUENT`` most frequent words are tokens of
their own; each other word belongs to one of ``BUCKETS`` tokens by its hash, and its
probability given that token is its share of the bucket's occurrences. So every word has a
statistic of its own, and their table grows with the corpus: up to ``MOST_SENT`` words it is
sent to the tasks, beyond that the words of each text are joined to it by a shuffle, with the
same scores. A word that was never counted gets the share of one occurrence, so words counted
once need no row in that table. The network is of fixed size: as context, and in the choice of the token, a word of a bucket counts as its
bucket.

Training is distributed: in each of ``ROUNDS`` rounds every task trains a copy of the network,
in numpy, on its share of the round's documents, and Spark averages the copies by the number of
words they saw. Each document is trained on once, over its whole text. A task that runs again
over the same rows trains the same copy.

Defined results: null and empty texts have no words and score 0; a null id is passed on;
rows that repeat an id are scored each; an empty table gives an empty result; other columns
are ignored. Words are runs of bytes other than blank and 09-0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import pick
from bindery.llm.words import each_text, hash_groups
from bindery.operators.joins import join_dimension
from bindery.session import store

GROUPS, GROUP_WORDS = 32, 32
BUCKETS = 128
TOKENS = GROUPS * GROUP_WORDS
FREQUENT = TOKENS - BUCKETS
OUTSIDE = TOKENS  # the place before the first and after the last word
SIDES = (-2, -1, 1, 2)
WIDTH, HIDDEN = 8, 16
BATCH = 2048
SCORED_AT_ONCE = 1 << 15
SAFE_EXPONENT = 80.0
RATE = 0.3
ROUNDS = 2
SEED = 11
MOST_SENT = 1 << 21  # 16 bytes each, 32 MB

Network = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """Frequent words (sorted hashes, ranks), ``word, share`` of others counted twice or more, and by bucket the share of one occurrence.

    Shares are logarithms.
    """

    frequent: tuple[np.ndarray, np.ndarray]
    others: DataFrame
    single: np.ndarray


def new_network() -> Network:
    rng = np.random.default_rng(SEED)
    shapes = {
        "embedding": (TOKENS + 1, WIDTH), "hidden": (len(SIDES) * WIDTH, HIDDEN), "hidden_bias": (HIDDEN,),
        "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "word": (GROUPS, HIDDEN, GROUP_WORDS), "word_bias": (GROUPS, GROUP_WORDS),
    }
    return {name: (rng.standard_normal(shape) * (0 if name.endswith("bias") else 0.1)).astype(np.float32) for name, shape in shapes.items()}


def flatten(network: Network) -> np.ndarray:
    return np.concatenate([network[n].ravel() for n in sorted(network)])


def unflatten(values: np.ndarray) -> Network:
    out, at = {}, 0
    shapes = {n: v.shape for n, v in new_network().items()}
    for name in sorted(shapes):
        size = int(np.prod(shapes[name]))
        out[name] = values[at : at + size].reshape(shapes[name]).astype(np.float32)
        at += size
    return out


def token_ids(words: np.ndarray, vocabulary: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Ids of word hashes: the rank of a frequent word, else a bucket."""
    ids = FREQUENT + (words % np.uint64(BUCKETS)).astype(np.int32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        ids = np.where(vocabulary[at] == words, ranks[at], ids)
    return ids


def contexts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The tokens around each token of a group of texts, one row per token."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(ids)) + 2 * (text + 1)
    # 16 bits hold every token, and are sorted by counting.
    padded = np.full(len(ids) + 2 * len(offsets), OUTSIDE, np.int16)
    padded[place] = ids
    return np.stack([padded[place + side] for side in SIDES], axis=1)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of a row less its shift, their sums, and the shift."""
    # The hidden units are bounded, so a row's largest value need not be taken off first.
    shift = 0.0 if not x.size or x.max() < SAFE_EXPONENT else x.max(axis=1)
    raised = np.exp(x if isinstance(shift, float) else x - shift[:, None])
    return raised, raised @ np.ones(x.shape[1], x.dtype), shift


def _softmax(x: np.ndarray) -> np.ndarray:
    raised, total, _ = _exponentials(x)
    raised /= total[:, None]
    return raised


def _log_norm(x: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials."""
    _, total, shift = _exponentials(x)
    return np.log(total) + shift


def _forward(net: Network, around: np.ndarray):
    """Inputs, hidden units and the group scores before they are made probabilities."""
    inputs = np.take(net["embedding"], around, axis=0).reshape(len(around), -1)
    hidden = np.tanh(inputs @ net["hidden"] + net["hidden_bias"])
    return inputs, hidden, hidden @ net["group"] + net["group_bias"]


def _by_group(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The rows of each group of words."""
    group = (ids // GROUP_WORDS).astype(np.int8)
    order = np.argsort(group, kind="stable")
    cuts = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return [(g, order[a:b]) for g, (a, b) in enumerate(zip([0, *cuts], cuts)) if b > a]


def log_probabilities(net: Network, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Log-probability of every token given the tokens around it."""
    out = np.empty(len(ids), np.float64)
    # What a token adds to the hidden units from each side, once per token instead of once per place.
    sides = net["hidden"].reshape(len(SIDES), WIDTH, HIDDEN)
    tables = [net["embedding"] @ side for side in sides]
    tables[0] = tables[0] + net["hidden_bias"]
    for at in range(0, len(ids), SCORED_AT_ONCE):
        some, near = ids[at : at + SCORED_AT_ONCE], around[at : at + SCORED_AT_ONCE]
        hidden = np.take(tables[0], near[:, 0], axis=0)
        for side in range(1, len(SIDES)):
            hidden += np.take(tables[side], near[:, side], axis=0)
        hidden = np.tanh(hidden)
        groups = hidden @ net["group"] + net["group_bias"]
        found = (groups[np.arange(len(some)), some // GROUP_WORDS] - _log_norm(groups)).astype(np.float64)
        for g, rows in _by_group(some):
            words = np.take(hidden, rows, axis=0) @ net["word"][g] + net["word_bias"][g]
            found[rows] += words[np.arange(len(rows)), some[rows] % GROUP_WORDS] - _log_norm(words)
        out[at : at + SCORED_AT_ONCE] = found
    return out


class Trainer:
    """Minibatch training with per-parameter rates (Adagrad)."""

    def __init__(self, network: Network):
        self.net = {n: v.copy() for n, v in network.items()}
        self.seen = {n: np.full(v.shape, 1e-2, np.float32) for n, v in network.items()}

    def _apply(self, name: str, slope: np.ndarray, where=slice(None)) -> None:
        self.seen[name][where] += slope * slope
        self.net[name][where] -= RATE * slope / np.sqrt(self.seen[name][where])

    def step(self, ids: np.ndarray, around: np.ndarray) -> None:
        net, n = self.net, len(ids)
        inputs, hidden, groups = _forward(net, around)
        wrong = _softmax(groups)
        wrong[np.arange(n), ids // GROUP_WORDS] -= 1
        back = wrong @ net["group"].T
        word, word_bias = np.zeros_like(net["word"]), np.zeros_like(net["word_bias"])
        for g, rows in _by_group(ids):
            part = np.take(hidden, rows, axis=0)
            off = _softmax(part @ net["word"][g] + net["word_bias"][g])
            off[np.arange(len(rows)), ids[rows] % GROUP_WORDS] -= 1
            back[rows] += off @ net["word"][g].T
            word[g], word_bias[g] = part.T @ off, off.sum(axis=0)
        back *= 1 - hidden * hidden
        into = (back @ net["hidden"].T).reshape(-1, WIDTH)
        flat = around.ravel()
        order = np.argsort(flat, kind="stable")
        many = np.bincount(flat, minlength=TOKENS + 1)
        tokens = np.flatnonzero(many)
        pulled = np.add.reduceat(np.take(into, order, axis=0), (np.cumsum(many) - many)[tokens], axis=0) / n
        self._apply("group", hidden.T @ wrong / n)
        self._apply("group_bias", wrong.sum(axis=0) / n)
        self._apply("word", word / n)
        self._apply("word_bias", word_bias / n)
        self._apply("hidden", inputs.T @ back / n)
        self._apply("hidden_bias", back.sum(axis=0) / n)
        self._apply("embedding", pulled, tokens)


def _word_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return hash_groups(t.lower() if t else b"" for t in each_text(column))


def count_words(rows: DataFrame) -> DataFrame:
    """``word, n`` over all texts: one partial count per batch of texts, then one sum per word."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words = [np.empty(0, np.uint64), *[w for _, w, _ in _word_groups(frame.column(1))]]
            found, n = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    return rows.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _train_round(rows: DataFrame, words, network: np.ndarray) -> DataFrame:
    """``place, total``: the copies' parameters summed by the words they saw; place -1 has the words."""
    start = rows.sparkSession.sparkContext.broadcast(network)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(unflatten(start.value)), 0
        vocabulary, ranks = words.value
        rng = np.random.default_rng(SEED)
        for frame in frames:
            for _, hashes, offsets in _word_groups(frame.column(1)):
                ids = token_ids(hashes, vocabulary, ranks)
                around = contexts(ids, offsets)
                order = rng.permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    some = order[at : at + BATCH]
                    trainer.step(ids[some], np.take(around, some, axis=0))
                seen += len(ids)
        if seen:
            values = np.append(flatten(trainer.net).astype(np.float64) * seen, seen)
            places = np.append(np.arange(len(values) - 1), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values)], names=["place", "total"])

    return rows.mapInArrow(run, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))


def count_vocabulary(rows: DataFrame) -> Vocabulary:
    counts = store(count_words(rows), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    named = rows.sparkSession.createDataFrame([(r["word"],) for r in top], "word bigint")
    others = counts.join(F.broadcast(named), "word", "left_anti").withColumn("bucket", F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    sums = others.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    totals = np.zeros(BUCKETS)
    for row in sums.collect():  # at most BUCKETS
        totals[row["bucket"]] = row["in_bucket"]
    shares = others.where("n > 1").join(F.broadcast(sums), "bucket").select("word", F.log(F.col("n") / (F.col("in_bucket") + 1)).alias("share"))
    return Vocabulary((hashes[order], order.astype(np.int32)), store(shares, "word-shares"), -np.log(totals + 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """Vocabulary and network."""
    rows = pick(docs, doc_id=(id_col, "string"), text=(text_col, "string"))
    words = count_vocabulary(rows)
    sent = docs.sparkSession.sparkContext.broadcast(words.frequent)
    network = flatten(new_network()).astype(np.float64)
    for turn in range(ROUNDS):
        share = rows.where(F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(ROUNDS)) == turn)
        summed = {r["place"]: r["total"] for r in _train_round(share, sent, network).collect()}  # one row per parameter
        if seen := summed.pop(-1, 0):
            network = np.array([summed[p] for p in range(len(network))]) / seen
    return words, unflatten(network)


def log_shares(words: np.ndarray, ids: np.ndarray, known: np.ndarray, shares: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Log-probability of every word given its token."""
    out = np.zeros(len(words))
    rare = np.flatnonzero(ids >= FREQUENT)
    found = single[ids[rare] - FREQUENT]
    if len(known) and len(rare):
        at = np.minimum(np.searchsorted(known, words[rare]), len(known) - 1)
        found = np.where(known[at] == words[rare], shares[at], found)
    out[rare] = found
    return out


def _joined_shares(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """``key_a, key_b, rare``: per text the sum of its words' log-shares, by a join of its words to the table."""
    sent = rows.sparkSession.sparkContext.broadcast(words.frequent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for first, hashes, offsets in _word_groups(frame.column(2)):
                rare = np.flatnonzero(token_ids(hashes, *sent.value) >= FREQUENT)
                text, found = np.searchsorted(offsets, rare, side="right") - 1, hashes[rare]
                order = np.lexsort((found, text))
                text, found = text[order], found[order]
                starts = np.flatnonzero(np.concatenate([np.ones(min(len(text), 1), bool), (text[1:] != text[:-1]) | (found[1:] != found[:-1])]))
                owner = pa.array(first + text[starts])
                columns = [frame.column(0).take(owner), frame.column(1).take(owner), pa.array(found[starts].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(np.append(starts, len(text))))], names=["key_a", "key_b", "word", "times"])

    keyed = rows.select("key_a", "key_b", "text")
    held = keyed.mapInArrow(run, "key_a bigint, key_b bigint, word bigint, times bigint").join(words.others, "word", "left")
    other = F.element_at(F.lit(words.single.tolist()), (F.col("word").bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int"))
    parts = held.select("key_a", "key_b", (F.col("times") * F.coalesce("share", other)).alias("part"), F.lit(0).alias("copy"))
    # Every copy of a text brings all its words, so the sum is divided by their number.
    copies = keyed.select("key_a", "key_b", F.lit(0.0).alias("part"), F.lit(1).alias("copy"))
    return parts.unionByName(copies).groupBy("key_a", "key_b").agg((F.sum("part") / F.sum("copy")).alias("rare"))


def score_documents(docs: DataFrame, words: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob`` for every row."""
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(SEED), "text").alias("key_b"))
    sent = words.others.count() <= MOST_SENT
    hashes, shares = np.empty(0, np.uint64), np.empty(0)
    if sent:
        table = words.others.toArrow()
        hashes = table["word"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, shares = hashes[order], table["share"].to_numpy()[order]
    known = docs.sparkSession.sparkContext.broadcast((words.frequent, network, hashes, shares, words.single if sent else np.zeros(BUCKETS)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, net, *rare = known.value
        for frame in frames:
            counts, sums = [], []
            for _, hashes, offsets in _word_groups(frame.column(1)):
                ids = token_ids(hashes, *frequent)
                found = log_probabilities(net, ids, contexts(ids, offsets)) + log_shares(hashes, ids, *rare)
                total = np.concatenate([[0.0], np.cumsum(found)])
                counts.append(np.diff(offsets))
                sums.append(total[offsets[1:]] - total[offsets[:-1]])
            columns = [np.concatenate([np.empty(0, np.int64), *counts]), np.concatenate([np.empty(0), *sums])]
            kept = [frame.column(0), frame.column(2), frame.column(3)]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, columns)], names=["doc_id", "key_a", "key_b", "n_tokens", "log_prob"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, key_a bigint, key_b bigint, n_tokens bigint, log_prob double")
    if not sent:
        joined = store(_joined_shares(rows, words), "rare-words")
        scored = join_dimension(store(scored, "scored"), joined, ["key_a", "key_b"], spread_by=["doc_id"])
        scored = scored.withColumn("log_prob", F.col("log_prob") + F.coalesce("rare", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_prob")


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words, network = train(docs)
    scored = score_documents(docs, words, network)
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).otherwise(0.0))
