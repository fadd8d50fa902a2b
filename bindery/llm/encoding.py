"""Encoding documents to token ids and ids back to text, over whole texts.

All of it is narrow: no row moves, and every Python worker keeps one tokenizer with a bounded
word cache. Whole texts stream through the transducer of ``bindery.llm.bpe`` chunk by
chunk. ``round_trip`` passes the ids on as they leave it, to digests and to the decoder, which
is fed runs of bytes of one size, so that neither the ids nor the decoded text of a document
are ever held whole. ``encode_documents`` and ``decode_documents`` return them as rows.

Defined results: a null text counts as empty and gives no ids; a null id is passed on; rows
that repeat an id are encoded each; an empty table gives an empty result; other columns
are ignored. A null list of ids decodes to an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bindery.llm.bpe import Decoder, chunks_of, tokenizer
from bindery.llm.common import pick

DECODE_IDS = 1 << 16
RUN_BYTES = 1 << 14
OUT_ROWS, OUT_IDS = 4096, 1 << 20


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` for every row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocab)
        for frame in frames:
            first, ids, size = 0, [[]], 0

            def made(ids: list[list[bytes]], first: int) -> pa.RecordBatch:
                flat = [b"".join(parts) for parts in ids]
                ends = np.cumsum([0, *map(len, flat)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(flat), "<i4")))
                return pa.RecordBatch.from_arrays([frame.column(0).slice(first, len(ids)), lists], names=["doc_id", "ids"])

            for n, part in encoder.stream(map(chunks_of, frame.column(1))):
                if n - first >= len(ids) and size >= OUT_IDS:
                    yield made(ids, first)
                    first, ids, size = first + len(ids), [], 0
                ids += [[] for _ in range(n - first + 1 - len(ids))]
                ids[-1].append(part)
                size += len(part) // 4
            ids += [[] for _ in range(frame.num_rows - first - len(ids))]
            if frame.num_rows:
                yield made(ids, first)

    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` for every row of ids; tokens are set apart by one space, as the file has no decoder."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tokenizer(vocab).tokens
        pieces = {i: t.encode() for i, t in names.items()}
        for frame in frames:
            lists, out, size, first = frame.column(1), [], 0, 0
            for n in range(len(lists)):
                found = lists[n].values
                ids = found.to_numpy(zero_copy_only=False) if found is not None else np.empty(0, np.int32)
                decoder, text, held = Decoder(), [], b""
                for at in range(0, len(ids), DECODE_IDS):
                    held += (b" " if at else b"") + b" ".join(map(pieces.__getitem__, ids[at : at + DECODE_IDS].tolist()))
                    whole = len(held) // RUN_BYTES * RUN_BYTES
                    text += [decoder.push(held[i : i + RUN_BYTES]) for i in range(0, whole, RUN_BYTES)]
                    held = held[whole:]
                text.append(decoder.push(held, end=True))
                out.append("".join(text))
                size += len(out[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([frame.column(0).slice(first, n + 1 - first), pa.array(out, pa.string())], names=["doc_id", "text"])
                    out, size, first = [], 0, n + 1
            if out:
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(first), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = pick(encoded, doc_id=id_col, ids=(ids_col, "array<int>"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


class Digests:
    """What is told of one document: takes ids as they come and holds one run of bytes."""

    def __init__(self, numbers: list[str], pieces: dict[int, bytes]):
        self.numbers, self.pieces = numbers, pieces
        self.n, self.ids, self.text, self.decoder, self.run = 0, hashlib.sha256(), hashlib.sha256(), Decoder(), b""

    def push(self, ids: list[int]) -> None:
        if not ids:
            return
        between = " " if self.n else ""
        self.n += len(ids)
        self.ids.update((between + " ".join(map(self.numbers.__getitem__, ids))).encode())
        self.run += between.encode() + b" ".join(map(self.pieces.__getitem__, ids))
        whole = len(self.run) // RUN_BYTES * RUN_BYTES
        for at in range(0, whole, RUN_BYTES):
            self.text.update(self.decoder.push(self.run[at : at + RUN_BYTES]).encode())
        self.run = self.run[whole:]

    def end(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.push(self.run, end=True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, encoded and decoded in one pass."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(vocab)
        pieces = {i: t.encode() for i, t in encoder.tokens.items()}
        numbers = list(map(str, range(max(pieces) + 1)))
        nothing = Digests(numbers, pieces).end()
        for frame in frames:
            first, told, at, open_ = 0, [], -1, None

            def made(told: list, first: int) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*told), (pa.int64(), pa.string(), pa.string()))]
                return pa.RecordBatch.from_arrays([frame.column(0).slice(first, len(told)), *columns], names=names)

            for n, part in encoder.stream(map(chunks_of, frame.column(1))):
                if n != at:
                    if open_ is not None:
                        told.append(open_.end())
                    told += [nothing] * (n - first - len(told))
                    at, open_ = n, Digests(numbers, pieces)
                    if len(told) >= OUT_ROWS:
                        yield made(told, first)
                        first, told = first + len(told), []
                open_.push(np.frombuffer(part, "<u4").tolist())
            if open_ is not None:
                told.append(open_.end())
            told += [nothing] * (frame.num_rows - first - len(told))
            if told:
                yield made(told, first)

    rows = pick(docs, doc_id=id_col, text=(text_col, "string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op7_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
