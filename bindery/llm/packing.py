"""Packs the token ids of documents into sequences by the sum-of-squares rule, online.

A level array counts the open sequences of each fill. A document's full sequences are
cut off first; what remains goes to the level (or to a new sequence) after which the sum
of the squared counts is least, so no level piles up and exact fits keep turning up. Ids
leave when their sequence is full. At the end of a partition, or when too many are open,
the open ones are closed: the fullest are filled up with pieces of the emptiest, which
cuts some of them, and the last one is cut into lengths that are powers of two, which
need no padding.

Every input partition is packed by itself, so nothing is shuffled and no task sees more
than its own rows; memory is bounded by ``MAX_OPEN`` open sequences. Sequence numbers
are ``partition << 32`` plus a count: a task that runs again over the same rows gives
the same result.

Defined results: a null text counts as empty, so its document is the end id alone; a
null id is passed on; rows that repeat an id are packed each; an empty table gives an
empty result; other columns are ignored; documents longer than a sequence span several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.bpe import batches, tokenizer
from bindery.llm.common import pick
from bindery.llm.encoding import vocabulary

SEQUENCE = 2048
END_ID = 1
MAX_OPEN = 1024

# A piece: number of the document, first id, ids as bytes, ids of the whole document.
Piece = tuple[object, int, bytes, int]


class Packer:
    """Places pieces online; ``place`` and ``close`` return finished sequences (lists of pieces)."""

    def __init__(self, capacity: int = SEQUENCE, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """The fill to add ``size`` ids to (0: a new sequence) by the least sum of squared counts."""
        top = self.capacity - size
        here, after = self.count[1 : top + 1], self.count[size + 1 : self.capacity + 1]
        change = 2 * (after - here) + 2
        if len(change):
            change[-1] = 1 - 2 * here[-1]  # a full sequence is no level
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        new = 2 * self.count[size] + 1
        if not len(change):
            return 0
        best = len(change) - 1 - int(change[::-1].argmin())  # of equal ones the fullest
        return best + 1 if change[best] <= new else 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        doc, start, ids, total = piece
        done = []
        while len(ids) >= 4 * self.capacity:
            done.append([(doc, start, ids[: 4 * self.capacity], total)])
            ids, start = ids[4 * self.capacity :], start + self.capacity
        if not ids:
            return done
        size = len(ids) // 4
        level = self.level_for(size)
        held = []
        if level:
            held = self.levels[level].pop()
            self.count[level] -= 1
        else:
            self.n_open += 1
        held.append((doc, start, ids, total))
        if level + size == self.capacity:
            self.n_open -= 1
            done.append(held)
        else:
            self.levels[level + size].append(held)
            self.count[level + size] += 1
        return done + self.close() if self.n_open > self.max_open else done

    def close(self) -> list[list[Piece]]:
        """Closes all open sequences without padding."""
        waiting = [(fill, held) for fill in range(1, self.capacity) for held in self.levels[fill]]
        self.levels, self.n_open = [[] for _ in range(self.capacity)], 0
        self.count[:] = 0
        done, first, last = [], 0, len(waiting) - 1
        while first <= last:
            fill, held = waiting[last]
            while fill < self.capacity and first < last:
                low, giving = waiting[first]
                doc, start, ids, total = giving.pop()
                taken = min(self.capacity - fill, len(ids) // 4)
                held.append((doc, start, ids[: 4 * taken], total))
                fill, low = fill + taken, low - taken
                if len(ids) > 4 * taken:
                    giving.append((doc, start + taken, ids[4 * taken :], total))
                if giving:
                    waiting[first] = (low, giving)
                else:
                    first += 1
            done += [held] if fill == self.capacity else self._in_powers(fill, held)
            last -= 1
        return done

    @staticmethod
    def _in_powers(fill: int, held: list[Piece]) -> list[list[Piece]]:
        """One partial sequence as several whose lengths are powers of two."""
        out = []
        held = held[::-1]
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            part = []
            while room:
                doc, start, ids, total = held.pop()
                taken = min(room, len(ids) // 4)
                part.append((doc, start, ids[: 4 * taken], total))
                if len(ids) > 4 * taken:
                    held.append((doc, start + taken, ids[4 * taken :], total))
                room -= taken
            out.append(part)
        return out


def pack_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset``."""
    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = tokenizer(vocab), Packer(capacity), end_id.to_bytes(4, "little")
        number = TaskContext.get().partitionId() << 32
        key_type = None

        def batch(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in names]
            for pieces in sequences:
                offset = 0
                for doc, start, ids, total in pieces:
                    for column, value in zip(columns, (doc, start, len(ids) // 4, ids, total, number, offset)):
                        column.append(value)
                    offset += len(ids) // 4
                number += 1
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for frame in frames:
            key_type = frame.column(0).type
            keys = frame.column(0).to_pylist()
            for first, group in batches(frame.column(1)):
                done = []
                for doc, ids in zip(keys[first:], encoder.encode(group)):
                    done += packer.place((doc, 0, ids + end, len(ids) // 4 + 1))
                if done:
                    yield batch(done)
        if packer.n_open:
            yield batch(packer.close())

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
