"""How far the sources of each language diverge in their words, through a partitioned cube.

Every (lang, source) is a group, and so is every lang as a whole. Terms are runs of ASCII
letters, lower-cased, and of characters beyond ASCII; a language keeps the ``V`` terms
that at least ``least`` of its documents hold. A group gives a kept term the share
p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being its count of all kept terms. Two
shares are (p - q)^2 / (p + q) apart, rounded down; two groups are the sum of that over
all kept terms of the language apart. All arithmetic is in whole numbers.

1. Tasks count terms and documents by group before anything moves; sums by (lang, source,
   term) follow, then by (lang, term), which says what is kept.
2. Groups and terms of a language are hashed into blocks. Every cell (group block, group
   block, term block) of the cube is owned by one task, to which the slices of its two
   group blocks go; a slice is sent once per other group block. The task computes the partial
   divergences of its pairs of groups over its terms.
3. Partial sums are reduced along the term axis. Terms that neither group block of a cell holds
   are not sent; each adds the same amount for a pair, the two groups' shares of a term
   that does not occur, so the reduction adds that for all of them at once.

A cell holds about ``BLOCK_GROUPS`` groups twice and ``BLOCK_TERMS`` terms. Groups and
terms are never gathered; the driver holds nothing. Languages and groups of any weight
are joined by broadcast of measured size, or else with the hot ones split.

Defined results: null text, lang and source count as ''; a group without terms takes part with
N = 0; a language with one source has no pairs; one without kept terms has pairs of value
0 and no terms; rows that repeat, with or without an id, count as documents each; equal
values are ranked by the item's UTF-8 bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import pick
from bindery.operators.joins import join_dimension
from bindery.session import store

SCALE = 1_000_000_000
BLOCK_GROUPS = 64
BLOCK_TERMS = 4096
HELD_TERMS = 200_000
CHUNK_BYTES = 1 << 20

# What is no part of a term becomes a blank; A-Z become a-z; bytes beyond ASCII stay.
LETTERS = bytes(b if b > 127 or 96 < b < 123 else b + 32 if 64 < b < 91 else 32 for b in range(256))


def _terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in runs of bounded size."""
    raw = raw.translate(LETTERS)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, one row per group and term.

    Tasks hold the sums of about ``HELD_TERMS`` terms of groups, or of one document, and then pass them on.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            groups, many = list(held), [len(n) for n, _ in held.values()]
            which = pa.array(np.repeat(np.arange(len(groups), dtype=np.int32), many))
            langs, sources = (pa.array([g[k] for g in groups], pa.string()).take(which) for k in (0, 1))
            terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
            counts = pa.array([c for n, _ in held.values() for c in n.values()], pa.int64())
            seen = pa.array([d[t] for n, d in held.values() for t in n], pa.int64())
            return pa.RecordBatch.from_arrays([langs, sources, terms, counts, seen], names=["lang", "source", "term", "n", "docs"])

        for frame in frames:
            for lang, source, text in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2).cast(pa.binary())):
                counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                own: set[bytes] = set()
                for some in _terms(text.as_py()):
                    counts.update(some)
                    own.update(some)
                seen.update(own)
                size += len(counts)
                if size + len(held) > HELD_TERMS:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), beyond the range of a long where it must be."""
    upper = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)"))
    lower = F.greatest((total + kept * 2).cast("decimal(20,0)"), F.lit(1).cast("decimal(20,0)"))
    return F.call_function("div", upper, lower) + F.lit(1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell; rows without a term tell of its groups."""
    table = table.combine_chunks()
    lang, low = table["lang"][0].as_py(), table["low"][0].as_py()
    is_group = table["term"].is_null()
    groups = table.filter(is_group).sort_by([("source", "ascending")])
    names, base = groups["source"].to_pylist(), groups["p"].to_numpy()
    block = groups["block"].to_numpy()
    slices = table.filter(pc.invert(is_group))
    rows = pc.index_in(slices["source"], value_set=pa.array(names, pa.string())).to_numpy()
    coded = slices["term"].combine_chunks()
    coded = coded.dictionary_encode() if len(coded) else pa.array([], pa.string()).dictionary_encode()
    seen = len(coded.dictionary)
    shares = np.repeat(base[:, None], seen, axis=1)
    shares[rows, coded.indices.to_numpy(zero_copy_only=False)] = slices["p"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == table["high"][0].as_py())
    out: list[tuple[np.ndarray, ...]] = []
    for a in left.tolist():
        others = right if low != table["high"][0].as_py() else right[right > a]
        gap, both = shares[others] - shares[a], shares[others] + shares[a]
        unseen = (base[others] - base[a]) ** 2 // (base[others] + base[a])
        out.append((np.full(len(others), a), others, (gap * gap // both).sum(axis=1), unseen))
    a, b, part, unseen = (np.concatenate(c) for c in zip(*out)) if out else [np.empty(0, np.int64)] * 4
    known = pa.array(names, pa.string())
    constant = lambda value, kind: pa.array([value] * len(a), kind)
    columns = [
        constant(lang, pa.string()), known.take(pa.array(a)), known.take(pa.array(b)), pa.array(part, pa.int64()),
        constant(seen, pa.int64()), pa.array(unseen, pa.int64()), constant(table["kept"][0].as_py(), pa.int64()),
    ]
    return pa.Table.from_arrays(columns, names=["lang", "a", "b", "part", "seen", "unseen", "kept"])


def _divergences(groups: DataFrame, slices: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for every pair of groups of a language, each pair once."""

    def sent(rows: DataFrame) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("group_blocks") - 1)).alias("other")
        rows = rows.select("lang", "source", "term", "p", "kept", "block", "term_block", other)
        return rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "term_block", "block", "source", "term", "p", "kept")

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("term_blocks") - 1)).alias("term_block")
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("unseen").alias("p"), "kept", "block", "group_blocks", every)
    cells = sent(slices).unionByName(sent(heads)).groupBy("lang", "low", "high", "term_block")
    parts = cells.applyInArrow(_cell, "lang string, a string, b string, part bigint, seen bigint, unseen bigint, kept bigint")
    total = F.sum("part") + (F.max("kept") - F.sum("seen")) * F.max("unseen")
    return parts.groupBy("lang", "a", "b").agg(total.alias("value"))


def divergence_audit(docs: DataFrame, least: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, block_groups: int = BLOCK_GROUPS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the divergence of a source from each other source of its language, all
    ranks. Part ``term``: the kept terms of a source that its language as a whole holds
    less of, with their share of the divergence from it, the first ``top``.
    """
    rows = pick(docs, lang=(lang_col, "string"), source=(source_col, "string"), text=(text_col, "string"))
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    counts = store(count_terms(rows), "term-counts")
    kept = store(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept-terms")
    counts = store(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = store(rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").fillna(0)
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / F.lit(size)), F.lit(1)).cast("bigint")
    langs = langs.select("lang", "kept", "lang_total", blocks("groups", block_groups).alias("group_blocks"), blocks("kept", block_terms).alias("term_blocks"))
    groups = join_dimension(groups, langs, ["lang"], spread_by=["source"])
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), "group_blocks"))
    groups = store(groups.withColumn("unseen", _share(F.lit(0), F.col("n"), F.col("kept"))), "groups")

    slices = join_dimension(counts.withColumnRenamed("n", "own"), groups.withColumnRenamed("n", "total"), ["lang", "source"], spread_by=["term"], how="inner")
    slices = store(
        slices.select(
            "lang", "source", "term", "kept", "block", "group_blocks", F.pmod(F.xxhash64("term"), "term_blocks").alias("term_block"),
            _share(F.col("own"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
        ),
        "slices",
    )

    pairs = _divergences(groups, slices)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("side")
    pairs = pairs.select("lang", "value", both).select("lang", "side.source", "side.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = slices.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).union(terms.select(*columns))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS BIGINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS BIGINT) AS q
    FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
