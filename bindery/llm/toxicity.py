"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary documents.

Both are interpolated bigram models over lower-cased words. Words and pairs are counted by the
documents that hold them, so that copies of a document count once and a phrase counts however
few contexts it has. Their last back-off is shared: it is made of the counts that discounting
takes from either class.

The discount of an expression is what the other class explains of it: its rate there,
``SIGMAS`` standard deviations up, a margin of the same size and the constant of plain
Kneser-Ney. So expressions that are rare, or about as common in both classes, cost both models
the same, and only what one class alone accounts for tells them apart. A word of a single
document is discounted in full: it is what the back-off for unseen ones is made of.

score = sigmoid(a * (log P_toxic - log P_ordinary) / words + b); a and b are fitted by
logistic regression on labelled rows that were not counted.

The models are fitted on all labelled rows outside the held-out fold: Spark counts all their words
and pairs, decides which of them tell and computes their ratios. What reaches the driver is sums, and up to
``MOST_SENT`` telling expressions, which are sent to the tasks; beyond that the expressions of
each text are joined to the table by a shuffle. Scoring covers every row and whole texts.

Defined results: null and empty texts have no words and get the score of no evidence;
rows with a null id are scored and count as held out; rows that repeat an id are scored
each; a document with several label rows is toxic if one says so; null labels are left
out; without any toxic or any ordinary label all scores are 0 or 1; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import join_small, leave_out, pick, row_key
from bindery.llm.words import PUNCTUATION, SMALL_GROUP, each_text, hash_groups, stir
from bindery.operators.joins import join_dimension
from bindery.session import store

MOST_SENT = 1 << 21
GROUP_WORDS = 1 << 17
SEED = 1
SIGMAS = 2.0
MARGIN = 1.0
DISCOUNT = 0.75
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1


def _word_groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return hash_groups((t.lower() if t else b"" for t in each_text(column)), blanks=PUNCTUATION, group_bytes=SMALL_GROUP)


def _previous(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word before each; 0 at the start of a text."""
    before = np.concatenate([np.zeros(1, words.dtype), words[:-1]])[: len(words)]
    starts = offsets[:-1][np.diff(offsets) > 0]
    before[starts] = 0
    return before


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return stir(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _tokens(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of whole texts in groups of about ``GROUP_WORDS``: batch, row in it, hash, hash of the word before."""
    for frame in frames:
        held, size = [], 0
        for first, words, offsets in _word_groups(frame.column(column)):
            rows = np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets))
            held.append((rows, words, _previous(words, offsets)))
            size += len(words)
            if size >= GROUP_WORDS:
                yield frame, *map(np.concatenate, zip(*held))
                held, size = [], 0
        if size:
            yield frame, *map(np.concatenate, zip(*held))


def _once(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places at which each value of a row is met first."""
    return np.unique(stir(values + rows.astype(np.uint64)), return_index=True)[1]


def excess(counts: list[np.ndarray], totals: list, floors: list) -> list[np.ndarray]:
    """What one class alone accounts for: counts beyond all that the other class explains.

    The other class's count is taken ``SIGMAS`` standard deviations up, at its rate; ``floors``
    are rates that are explained in any case.
    """
    out = []
    for one, other in ((0, 1), (1, 0)):
        high = counts[other] + SIGMAS * np.sqrt(counts[other] + 1) + 1
        explained = totals[one] * np.maximum(high / totals[other], floors[one])
        out.append(np.maximum(counts[one] - (1 + MARGIN) * explained - SIGMAS * np.sqrt(explained) - DISCOUNT, 0))
    return out


@dataclass
class Model:
    """Log-likelihood ratios by sorted hashes; what is in no table has the ratio ``base``."""

    base: float = 0.0
    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    word_ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    pair_ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    contexts: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    context_ratio: np.ndarray = field(default_factory=lambda: np.empty(0))
    slope: float = 0.0
    intercept: float = 0.0
    # feature, weight: what each word, word before and pair adds to ``base``, where they are too many to send.
    weights: DataFrame | None = None

    def ratios(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(log P_toxic - log P_ordinary) / words of each text of a group."""
        found = _look_up(self.words, self.word_ratio, words, self.base)
        if len(self.pairs):
            before = _previous(words, offsets)
            found = found + _look_up(self.contexts, self.context_ratio, before, 0.0)
            found = _look_up(self.pairs, self.pair_ratio, pair_key(before, words), found)
        total = np.concatenate([[0.0], np.cumsum(found)])
        n = np.diff(offsets)
        return np.where(n > 0, (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1), self.base)

    def score(self, ratios: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * ratios + self.intercept, -500, 500)))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.broadcast_to(np.asarray(default, float), wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _newton(share: float, sums) -> np.ndarray | None:
    """Weights of a logistic regression (Newton's method, lightly damped); ``sums`` gives slope and curvature."""
    if share in (0.0, 1.0):
        return None
    w, damping = np.zeros(2), 1e-3
    for _ in range(100):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + damping * np.eye(2), slope + damping * w)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


def _scale(w: np.ndarray | None, share: float, middle: float, width: float) -> tuple[float, float]:
    if w is None:
        return 0.0, 500.0 if share else -500.0
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


def fit_scale(ratios: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression."""
    share = float(labels.mean()) if len(labels) else 0.0
    middle, width = (ratios.mean(), max(ratios.std(), 1e-12)) if len(labels) else (0.0, 1.0)
    x = np.column_stack([(ratios - middle) / width, np.ones(len(ratios))])

    def sums(w: np.ndarray):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        return x.T @ (p - labels), (x * (p * (1 - p))[:, None]).T @ x

    return _scale(_newton(share, sums), share, middle, width)


def _sigmoid(z) -> F.Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def fit_scale_rows(rows: DataFrame) -> tuple[float, float]:
    """``fit_scale`` of the columns ``ratio, toxic``, whose rows stay where they are: Spark takes the sums of every step."""
    share, middle, width = (v or 0.0 for v in rows.agg(F.avg("toxic"), F.avg("ratio"), F.stddev_pop("ratio")).first())
    width = max(width, 1e-12)
    x = (F.col("ratio") - middle) / width

    def sums(w: np.ndarray):
        p = _sigmoid(x * float(w[0]) + float(w[1]))
        terms = rows.select(x.alias("x"), (p - F.col("toxic")).alias("off"), (p * (1 - p)).alias("v"))
        a, b, xx, x1, one = terms.agg(*[F.sum(F.expr(e)) for e in ("off * x", "off", "v * x * x", "v * x", "v")]).first()
        return np.array([a, b]), np.array([[xx, x1], [x1, one]])

    return _scale(_newton(share, sums), share, middle, width)


def _fold(column) -> F.Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


def _numbers(frame: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [frame.column(n).to_numpy().astype(float) for n in names]


def _count_words(training: DataFrame) -> tuple[DataFrame, list[float]]:
    """Words of two documents or more, and the sums of ``c0`` and ``c1`` over all words.

    ``word``; ``c0, c1``: the documents of either class that hold it; ``t0, t1``: those of all pairs of
    it and a next word that is here too.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, rows, words, before in _tokens(frames, 1):
            toxic = frame.column(0).to_numpy()[rows]
            at = _once(words, rows)
            found, group = np.unique(words[at], return_inverse=True)
            held = [np.bincount(group, toxic[at] == c, len(found)).astype(np.int64) for c in (0, 1)]
            after = np.flatnonzero(before)
            after = after[_once(pair_key(before, words)[after], rows[after])]
            group = np.searchsorted(found, before[after])
            pairs = [np.bincount(group, toxic[after] == c, len(found)).astype(np.int64) for c in (0, 1)]
            # A word met once brings the words before it, for the case that it stays at one document.
            group = np.searchsorted(found, words[after])
            group, after = (x[(held[0] + held[1])[group] == 1] for x in (group, after))
            ends = np.cumsum(np.append(0, np.bincount(group, minlength=len(found)))).astype(np.int32)
            befores = pa.ListArray.from_arrays(pa.array(ends), pa.array(before[after[np.argsort(group, kind="stable")]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (found.view(np.int64), *held, *pairs)), befores], names=["word", "c0", "c1", "t0", "t1", "befores"])

    sums = [F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")]
    counts = training.mapInArrow(run, "word bigint, c0 bigint, c1 bigint, t0 bigint, t1 bigint, befores array<bigint>")
    counts = store(counts.groupBy("word").agg(*sums, F.first("befores").alias("befores")), "toxicity-words", compression="zstd")
    single = F.col("c0") + F.col("c1") == 1
    none = F.lit(0).cast("bigint")
    lost = counts.where(single).select(F.explode("befores").alias("word"), none.alias("c0"), none.alias("c1"), (-F.col("c0")).alias("t0"), (-F.col("c1")).alias("t1"))
    known = counts.where(~single).drop("befores").unionByName(lost).groupBy("word").agg(*sums).where("c0 + c1 > 1")
    return store(known, "toxicity-known", compression="zstd"), [float(t or 0) for t in counts.agg(F.sum("c0"), F.sum("c1")).first()]


def _count_pairs(training: DataFrame) -> DataFrame:
    """``before, word, n0, n1``: the documents of either class that hold a pair, where they are two or more of one class."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, rows, words, before in _tokens(frames, 1):
            toxic = frame.column(0).to_numpy()[rows]
            keys = pair_key(before, words)
            at = np.flatnonzero(before)
            at = at[_once(keys[at], rows[at])]
            _, one, group = np.unique(keys[at], return_index=True, return_inverse=True)
            held = [np.bincount(group, toxic[at] == c, len(one)).astype(np.int64) for c in (0, 1)]
            # Both counts travel in one number, ordinary documents in its lower half.
            columns = [before[at[one]].view(np.int64), words[at[one]].view(np.int64), held[1] << 32 | held[0]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["before", "word", "n"])

    pairs = training.mapInArrow(run, "before bigint, word bigint, n bigint").groupBy("before", "word").agg(F.sum("n").alias("n"))
    pairs = pairs.select("before", "word", F.col("n").bitwiseAND(F.lit((1 << 32) - 1)).alias("n0"), F.shiftright("n", 32).alias("n1"))
    return store(pairs.where("n0 > 1 OR n1 > 1"), "toxicity-pairs", compression="zstd")


def _telling_words(known: DataFrame, totals: list[float]) -> DataFrame:
    """``word, c0, c1, o0, o1``: words with an excess in one class."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            over = excess(_numbers(frame, "c0", "c1"), totals, [0.0, 0.0])
            out = pa.RecordBatch.from_arrays([*frame.columns, *map(pa.array, over)], names=["word", "c0", "c1", "o0", "o1"])
            yield out.filter(pa.array((over[0] > 0) | (over[1] > 0)))

    return store(known.select("word", "c0", "c1").mapInArrow(run, "word bigint, c0 bigint, c1 bigint, o0 double, o1 double"), "telling-words")


def _telling_pairs(pairs: DataFrame, known: DataFrame, totals: list[float], rest: list[float], mass: float) -> DataFrame:
    """``before, key, e0, e1, a0, a1``: pairs with an excess, its share of the pairs after ``before``, and the chance of the word alone."""
    names = ["before", "word", "n0", "n1", "t0", "t1"]

    def over(frame: pa.RecordBatch, floors: list) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
        room = [np.maximum(t, 1.0) for t in _numbers(frame, "t0", "t1")]
        seen = _numbers(frame, "n0", "n1")
        found = excess(seen, room, floors)
        return found, room, pa.array(np.any([(o > 0) & (n > 1) for o, n in zip(found, seen)], axis=0))

    def beyond(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:  # floors only lower the excess
            yield frame.filter(over(frame, [0.0, 0.0])[2])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            counts = _numbers(frame, "c0", "c1")
            single = excess(counts, totals, [0.0, 0.0])
            common = (counts[0] + counts[1] - single[0] - single[1]) / mass
            alone = [o / t + r * common for o, t, r in zip(single, totals, rest)]
            found, room, telling = over(frame, alone)
            before, word = (frame.column(n).to_numpy() for n in ("before", "word"))
            columns = [before, pair_key(before.view(np.uint64), word.view(np.uint64)).view(np.int64), *[o / r for o, r in zip(found, room)], *alone]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["before", "key", "e0", "e1", "a0", "a1"]).filter(telling)

    after = join_dimension(pairs, known.select(F.col("word").alias("before"), "t0", "t1"), ["before"], spread_by=["word"], how="inner")
    some = store(after.select(*names).mapInArrow(beyond, ", ".join(f"{n} bigint" for n in names)), "toxicity-beyond", compression="zstd")
    both = join_dimension(some, known.select("word", "c0", "c1"), ["word"], spread_by=["before"], how="inner")
    found = both.select(*names, "c0", "c1").mapInArrow(run, "before bigint, key bigint, e0 double, e1 double, a0 double, a1 double")
    return store(found, "telling-pairs")


def fit_ratios(training: DataFrame) -> Model:
    """The two models from ``toxic, text``, one row per document."""
    known, totals = _count_words(training)
    pairs = _count_pairs(training)
    totals = [max(t, 1.0) for t in totals]
    words = _telling_words(known, totals)
    over = [o or 0.0 for o in words.agg(F.sum("o0"), F.sum("o1")).first()]
    rest = [1 - o / t for o, t in zip(over, totals)]
    mass = max(sum(totals) - sum(over), 1e-9)
    base = float(np.log(rest[1] / rest[0]))
    common = (F.col("c0") + F.col("c1") - F.col("o0") - F.col("o1")) / mass
    chance = [F.col(f"o{c}") / totals[c] + rest[c] * common for c in (0, 1)]
    words = words.select(F.col("word").alias("key"), F.log(chance[1] / chance[0]).alias("ratio"))

    pairs = _telling_pairs(pairs, known, totals, rest, mass)
    left = pairs.groupBy("before").agg(*[F.greatest(1 - F.sum(f"e{c}"), F.lit(1e-6)).alias(f"l{c}") for c in (0, 1)])
    left = store(left, "toxicity-contexts")
    contexts = left.select(F.col("before").alias("key"), F.log(F.col("l1") / F.col("l0")).alias("ratio"))
    pairs = join_dimension(pairs, left, ["before"], spread_by=["key"], how="inner")
    chance = [F.col(f"e{c}") + F.col(f"l{c}") * F.col(f"a{c}") for c in (0, 1)]
    # The ratio a pair's word would have without the pair, telling or not, and that of the word before.
    single = F.log(F.col("a1") / F.col("a0")) + F.log(F.col("l1") / F.col("l0"))
    pairs = store(pairs.select("key", F.log(chance[1] / chance[0]).alias("ratio"), single.alias("single")), "pair-ratios")
    if words.count() + left.count() + pairs.count() > MOST_SENT:
        return Model(base, weights=_weights(words, contexts, pairs, base))
    return Model(base, *_table(words), *_table(pairs), *_table(contexts))


def _table(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their ratios, at most ``MOST_SENT``."""
    found = rows.select("key", "ratio").toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["ratio"].to_numpy(float)[order]


def _weights(words: DataFrame, contexts: DataFrame, pairs: DataFrame, base: float) -> DataFrame:
    """``feature, weight``: the same ratios as summands, a pair's over those of its words."""

    def context_keys(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keys = pair_key(frame.column(0).to_numpy().view(np.uint64), np.zeros(frame.num_rows, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), frame.column(1)], names=["key", "ratio"])

    parts = [words.select("key", F.col("ratio") - base), contexts.mapInArrow(context_keys, "key bigint, ratio double"), pairs.select("key", F.col("ratio") - F.col("single"))]
    return store(parts[0].union(parts[1]).union(parts[2]).toDF("feature", "weight"), "toxicity-weights")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits both models and the scale on all labelled documents outside the held-out fold."""
    chosen = pick(labels, doc_id=id_col, toxic=(label_col, "int")).where("toxic IN (0, 1) AND doc_id IS NOT NULL")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", _fold(F.col("doc_id")))
    chosen = chosen.where(F.col("fold") != HELD_OUT)
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    labelled = join_small(rows, chosen, ["doc_id"], "inner").select("toxic", "fold", "text", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"))
    labelled = store(labelled, "toxicity-labelled", compression="zstd")

    training = labelled.where(F.col("fold") != CALIBRATION)
    # Of copies in one class one counts.
    firsts = store(training.groupBy("toxic", "key").agg(F.min("row").alias("row")).select("row"), "toxicity-firsts")
    model = fit_ratios(join_small(training, firsts, ["row"], "left_semi").select("toxic", "text"))
    least, most = labelled.where(F.col("fold") == CALIBRATION).agg(F.min("toxic"), F.max("toxic")).first()
    check = labelled.where(F.col("fold") == CALIBRATION) if (least, most) == (0, 1) else labelled
    scored = _ratios(check.select(F.struct("toxic").alias("doc_id"), "text"), model).select("doc_id.toxic", "ratio")
    model.slope, model.intercept = fit_scale_rows(store(scored, "toxicity-ratios"))
    return model


def _ratios(rows: DataFrame, model: Model) -> DataFrame:
    if model.weights is not None:
        return _joined_ratios(rows, model)
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            found = [known.value.ratios(words, offsets) for _, words, offsets in _word_groups(frame.column(1))]
            ratios = np.concatenate([np.empty(0), *found])
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(ratios), pa.array(known.value.score(ratios))], names=["doc_id", "ratio", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ratio double, score double")


def _joined_ratios(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, ratio, score`` by a join of the expressions of each text to the table of weights."""
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(SEED), "text").alias("key_b"), "text")

    def sizes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n = np.concatenate([np.empty(0, np.int64), *[np.diff(offsets) for _, _, offsets in _word_groups(frame.column(3))]])
            yield pa.RecordBatch.from_arrays([*frame.columns[:3], pa.array(n)], names=["doc_id", "key_a", "key_b", "n"])

    def features(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, owner, words, before in _tokens(frames, 2):
            after = np.flatnonzero(before)
            before = before[after]
            found = np.concatenate([words, pair_key(before, np.zeros(len(before), np.uint64)), pair_key(before, words[after])])
            owner = np.concatenate([owner, owner[after], owner[after]])
            _, at, times = np.unique(stir(found + owner.astype(np.uint64)), return_index=True, return_counts=True)
            text = pa.array(owner[at])
            columns = [frame.column(0).take(text), frame.column(1).take(text), pa.array(found[at].view(np.int64)), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, names=["key_a", "key_b", "feature", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sized = store(keyed.mapInArrow(sizes, f"doc_id {kind}, key_a bigint, key_b bigint, n bigint"), "toxicity-sizes")
    held = keyed.select("key_a", "key_b", "text").mapInArrow(features, "key_a bigint, key_b bigint, feature bigint, times bigint")
    held = join_dimension(held, model.weights, ["feature"], spread_by=["key_a", "key_b"], how="inner")
    parts = held.select("key_a", "key_b", (F.col("times") * F.col("weight")).alias("part"), F.lit(0).alias("copy"))
    # Every copy of a text brings all its expressions, so the sum is divided by their number.
    copies = sized.select("key_a", "key_b", F.lit(0.0).alias("part"), F.lit(1).alias("copy"))
    sums = parts.unionByName(copies).groupBy("key_a", "key_b").agg((F.sum("part") / F.sum("copy")).alias("found"))
    scored = join_dimension(sized, store(sums, "toxicity-sums"), ["key_a", "key_b"], spread_by=["doc_id"])
    ratio = model.base + F.when(F.col("n") > 0, F.col("found") / F.col("n")).otherwise(0.0)
    return scored.select("doc_id", ratio.alias("ratio")).withColumn("score", _sigmoid(F.col("ratio") * model.slope + model.intercept))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, ratio`` for every row."""
    scored = _ratios(pick(docs, doc_id=id_col, text=(text_col, "string")), model)
    return scored.select("doc_id", (_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ratio")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, all columns as given."""
    model = fit(docs, labels, id_col, text_col)
    if model.slope == 0.0:  # one class only: nothing to tell apart
        return docs
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    scored = _ratios(rows.select(F.struct("doc_id", row_key(F.col("text")).alias("row_key")).alias("doc_id"), "text"), model)
    return leave_out(docs, id_col, text_col, store(scored.where("score >= 0.5").select("doc_id.*"), "toxic"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
