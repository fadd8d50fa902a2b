"""Words of many texts as arrays of 64-bit hashes, without a Python object per word.

Words are the runs of bytes other than blank and 09-0D. A word's hash is a polynomial of
its bytes modulo 2 ** 64, taken from running sums, with its length mixed in and all bits
stirred. Texts are hashed in groups of bounded size; a longer text is cut at a blank.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from bindery.llm.bpe import tokenizer

GROUP_BYTES = 1 << 18
# For operators whose results do not depend on groups: less memory at the same speed.
SMALL_GROUP = 1 << 16
END = bytes(bytearray(b"end of texts"))
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits also ends a word.
PUNCTUATION = BLANKS | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2 ** 64, for i below ``n`` at least."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        made = []
        for factor in (int(base), pow(int(base), -1, 1 << 64)):
            row = np.full(size, np.uint64(factor))
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        known = _powers[int(base)] = (made[0], made[1])
    return known


def stir(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole value (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` for many spans, from one running sum."""
    up, down = powers(base, max(1, len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def give_back() -> None:
    """Returns freed memory to the system: what a task with a tokenizer leaves between pieces that are still in use."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others do without
    if trim:
        trim(0)


def each_text(column: pa.Array) -> Iterator[bytes | None]:
    """The texts of a column one by one, so that a batch is not held twice."""
    if tokenizer.cache_info().currsize:
        tokenizer.cache_clear()
        give_back()
    return (value.as_py() for value in column.cast(pa.binary()))


def word_edges(raw: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~blanks[raw]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _hash_bytes(raw: np.ndarray, base: np.uint64, blanks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of up to a group's bytes."""
    starts, ends = word_edges(raw, blanks)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    found = spans(raw.astype(np.uint64) + np.uint64(1), starts, ends, base)
    return stir(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def hash_text(text: bytes, base: np.uint64 = BASES[0], blanks: np.ndarray = BLANKS) -> np.ndarray:
    """The hashes of all words of one text of any length."""
    if len(text) <= 2 * GROUP_BYTES:
        return _hash_bytes(np.frombuffer(text, np.uint8), base, blanks)[0]
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(raw):
        end = at + GROUP_BYTES
        while end < len(raw):
            found = np.flatnonzero(blanks[raw[end : end + GROUP_BYTES]])
            if len(found):
                end += int(found[0])
                break
            end += GROUP_BYTES
        out.append(_hash_bytes(raw[at:end], base, blanks)[0])
        at = end
    return np.concatenate(out)


def hash_groups(texts: Iterable[bytes | None], base: np.uint64 = BASES[0], blanks: np.ndarray = BLANKS, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts: number of the first, hashes of all their words, word offsets of each text.

    The offsets have one entry more than the group has texts; null counts as empty.
    """
    first, held, size = 0, [], 0
    for n, text in enumerate(chain(texts, [END])):
        text = text or b""
        if held and (text is END or size + len(text) > group_bytes):
            if len(held) == 1:
                found = hash_text(held[0], base, blanks)
                yield first, found, np.array([0, len(found)])
            else:
                found, starts = _hash_bytes(np.frombuffer(b" ".join(held), np.uint8), base, blanks)
                begins = np.cumsum([0, *[len(t) + 1 for t in held]])
                yield first, found, np.searchsorted(starts, begins)
            first, held, size = n, [], 0
        held.append(text)
        size += len(text)
