"""Token counts of texts under a byte-level vocabulary, without a single token id.

A text is cut into pieces by the vocabulary's pattern. The bytes of a piece form a linked
list; a heap holds its adjacent pairs that the merge list knows, by rank and then by
place. The lowest pair is popped and merged, its two new neighbours are pushed, and pairs
that a merge has made void are passed over when they come up. The piece has as many
tokens as bytes less merges, so symbols are numbers of this module and no identifier is
ever looked up. A piece of n bytes takes n log n steps and about 60 n bytes.

Counts of pieces are kept in two dictionaries of bounded size, of which the full one
becomes the older, so frequent pieces are merged once per worker. Texts go through in groups, very long ones piece by piece, so that a
worker never holds all pieces of a long text. Nothing is shuffled.

Defined results: a null text counts as empty and has no bytes and no tokens; a null id is
passed on; rows that repeat an id are counted each; an added token inside a text
is one token, as the library has it by default; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.bpe import batches, byte_alphabet
from bindery.llm.common import pick
from bindery.llm.encoding import vocabulary

CACHE_PIECES = 300_000
LONG_CHARS = 1 << 20
PIECES_AT_ONCE = 1 << 16
SHIFT = 32
PLACE = (1 << SHIFT) - 1

# Fixed value: how byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _cutters() -> tuple[re.Pattern, regex.Pattern]:
    """The pattern for ASCII texts and for all others, where white space is Unicode's property."""
    plain = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    wide = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return re.compile(plain, re.ASCII), regex.compile(wide)


class MergeList:
    """Pairs of symbols by rank. Symbols 0 to 255 are bytes, those above are made by merges."""

    def __init__(self, merges: list[tuple[str, str]]):
        number = {letter: byte for byte, letter in enumerate(byte_alphabet())}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.made.append(number.setdefault(left + right, len(number)))
            self.ranks.setdefault(number[left] << SHIFT | number[right], rank)

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges that apply."""
        size = len(piece)
        rank_of, made = self.ranks.get, self.made
        symbols = list(piece)
        heap = []
        for at, (left, right) in enumerate(zip(piece, piece[1:])):
            rank = rank_of(left << SHIFT | right)
            if rank is not None:
                heap.append(rank << SHIFT | at)
        if not heap:
            return size
        heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merged = 0
        while heap:
            lowest = heappop(heap)
            rank, at = lowest >> SHIFT, lowest & PLACE
            right = after[at]
            # Void: nothing follows, the left symbol was swallowed (-1), or another pair stands here now.
            if right == size or rank_of(symbols[at] << SHIFT | symbols[right]) != rank:
                continue
            merged += 1
            token = symbols[at] = made[rank]
            symbols[right] = -1
            far = after[at] = after[right]
            if far < size:
                before[far] = at
                rank = rank_of(token << SHIFT | symbols[far])
                if rank is not None:
                    heappush(heap, rank << SHIFT | at)
            near = before[at]
            if near >= 0:
                rank = rank_of(symbols[near] << SHIFT | token)
                if rank is not None:
                    heappush(heap, rank << SHIFT | near)
        return size - merged


class Counter:
    """Counts the tokens of texts by a vocabulary file of the tokenizers library's format."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = not any((spec["normalizer"], model["end_of_word_suffix"], model["continuing_subword_prefix"], model["dropout"], model.get("ignore_merges")))
        if model["type"] != "BPE" or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or not plain:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.merges = MergeList([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._marks = {t[0] for t in added}
        self._ascii, self._any = _cutters()
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._most = pieces

    def _plain_parts(self, text: str) -> tuple[list[str], int]:
        """The text around added tokens, and how many there are."""
        if self._added is None or not any(m in text for m in self._marks):
            return [text], 0
        parts = self._added.split(text)
        return parts, len(parts) - 1

    def _cutter(self, text: str):
        return self._ascii if text.isascii() else self._any

    def _sizes(self, pieces: set[str]) -> dict[str, int]:
        """A dictionary that holds the counts of these pieces at least."""
        if len(self._known) + len(pieces) > self._most:
            self._older, self._known = self._known, {}
        known, older, count = self._known, self._older, self.merges.count
        missing = pieces.difference(known)
        known.update((p, older[p] if p in older else count(p.encode())) for p in missing)
        return known

    def _long(self, text: str) -> int:
        found, total = (m.group() for m in self._cutter(text).finditer(text)), 0
        while some := list(islice(found, PIECES_AT_ONCE)):
            known = self._sizes(set(some))
            total += sum(map(known.__getitem__, some))
        return total

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        totals, cut = [0] * len(texts), []
        for n, text in enumerate(texts):
            parts, totals[n] = self._plain_parts(text)
            for part in parts:
                if len(part) > LONG_CHARS:
                    totals[n] += self._long(part)
                else:
                    cut.append((n, self._cutter(part).findall(part)))
        known = self._sizes(set(chain.from_iterable(pieces for _, pieces in cut)))
        for n, pieces in cut:
            totals[n] += sum(map(known.__getitem__, pieces))
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per Python worker and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocab: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; over the limit are more tokens than ``limit``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = counter(vocab)
        for frame in frames:
            totals = []
            for _, group in batches(frame.column(2)):
                totals += found.count(group)
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the byte-level vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), limit=512)
