"""Byte-pair encoding as a streaming transducer with a bounded look-ahead, and decoding.

A piece of text is read in windows of constant size. Merging runs inside the window; a
token leaves as soon as nothing that follows can change it, and the rest stays.

How far what follows can reach back is computed from the merge list. A merge (c, d) can
turn out otherwise for two continuations only if its right part d does, because an
earlier merge creates d there or consumes d together with its right neighbour; every
merge that starts further left has then been the same. So effects travel left along
chains of merges of rising rank, each moving the front by the length of its left part,
and one pass over the list in rank order finds the longest chain. A token that starts
further than that from the end of the window is final. (The idea of a sufficient
look-ahead is that of Berglund and van der Merwe, "Formalizing BPE Tokenization", 2023.)

A text arrives in chunks. Chunks are cut behind their last blank, where composing
characters, added tokens and pieces end as well; a run without blanks goes on as a
``LongWord``, whose letters enter the transducer as they come. So a stream holds a chunk,
a window and a run of combining marks at most, whatever the length of the text.

Windows of many pieces are merged side by side as rows of one array. Ids of words are
kept in a dictionary of bounded size, so that frequent words are merged once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

NONE = np.int32(2**31 - 1)
WINDOW_BYTES = 48
BATCH_SYMBOLS = 1 << 19
CACHE_WORDS = 150_000
CHUNK_CHARS = 1 << 16
LONG_CHARS = 1 << 12
GROUP_CHARS = 500_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class Merges:
    """A merge list as arrays: symbols of bytes, ranks of pairs, look-ahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_alphabet()
        self.tokens = {i: t for t, i in vocab.items()}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        size = {i: len(t.removesuffix(suffix) if suffix else t) for t, i in vocab.items()}
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int32)
        for i, n in size.items():
            self.n_bytes[i] = n
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._build_table(pairs)
        self.lookahead = self._reach(pairs)

    def _build_table(self, pairs: np.ndarray) -> None:
        """Open addressing at a load below a tenth, so that most pairs take one probe."""
        bits = max(8, int(len(pairs) * 10).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NONE, np.int32)
        for rank, key in enumerate((pairs[:, 0] << 32 | pairs[:, 1]).tolist()):
            at = int(self._slots(np.array([key]))[0])
            while self._keys[at] not in (-1, key):
                at = (at + 1) & self._mask
            if self._keys[at] == -1:
                self._keys[at], self._ranks[at] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _reach(self, pairs: np.ndarray) -> int:
        size, best, reach = self.n_bytes, {}, 0
        for (left, right), token in zip(pairs.tolist(), self.merged.tolist()):
            span = int(size[token]) - 1
            if right in best:
                span = max(span, int(size[left]) + best[right])
            reach = max(reach, span)
            for symbol in (left, token):
                best[symbol] = max(best.get(symbol, 0), span)
        return reach

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it is no merge or a symbol is missing (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slots(keys)
        found = self._keys[at]
        out = np.where(found == keys, self._ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at.flat[open_] = (at.flat[open_] + 1) & self._mask
            found, wanted = self._keys[at.flat[open_]], keys.flat[open_]
            hit = found == wanted
            out.flat[open_[hit]] = self._ranks[at.flat[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Merges every row (symbols, then -1) by lowest rank, leftmost first, until none applies."""
        out = rows.copy()
        if rows.shape[1] < 2:
            return out
        live, symbols, ranks = np.arange(len(rows)), rows, self.ranks(rows[:, :-1], rows[:, 1:])
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            ended = best == NONE
            if ended.any():
                out[live[ended], : symbols.shape[1]] = symbols[ended]
                out[live[ended], symbols.shape[1] :] = -1
                going = ~ended
                live, symbols, ranks, at, best = live[going], symbols[going], ranks[going], at[going], best[going]
                if not len(live):
                    break
            line, token = np.arange(len(live)), self.merged[best]
            if symbols.shape[1] == 2:
                out[live] = -1
                out[live, 0] = token
                break
            # Every row loses one symbol, so all rows narrow by one column.
            columns = np.arange(symbols.shape[1] - 1)
            symbols = np.where(columns <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[line, at] = token
            ranks = np.where(columns[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            right = np.flatnonzero(at < ranks.shape[1])
            ranks[right, at[right]] = self.ranks(token[right], symbols[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(symbols[left, at[left] - 1], token[left])
        return out


class Transducer:
    """Turns byte streams into token ids with a window of constant size."""

    def __init__(self, merges: Merges, window: int = WINDOW_BYTES):
        self.merges = merges
        self.window = max(window, 2 * merges.lookahead)

    def _step(self, windows: list[bytes], last: list[bool]) -> list[bytes]:
        """The ids of each window that are final, as little-endian 32-bit integers."""
        m, sizes = self.merges, np.fromiter(map(len, windows), np.int64, len(windows))
        order = np.argsort(sizes, kind="stable")
        sizes, shut = sizes[order], np.asarray(last, bool)[order]
        out: list[bytes] = [b""] * len(windows)
        begin = 0
        while begin < len(order):
            # Windows of like size share an array.
            widest = min(2 * int(sizes[begin]) + 2, self.window)
            end = min(int(np.searchsorted(sizes, widest, "right")), begin + max(1, BATCH_SYMBOLS // widest))
            some, n, ends = order[begin:end].tolist(), sizes[begin:end], shut[begin:end]
            begin = end
            filled = np.arange(n[-1]) < n[:, None]
            raw = np.zeros(filled.shape, np.uint8)
            raw[filled] = np.frombuffer(b"".join([windows[i] for i in some]), np.uint8)
            rows = np.where(filled, m.inner[raw], np.int32(-1))
            which = np.flatnonzero(ends & (n > 0))
            rows[which, n[which] - 1] = m.final[raw[which, n[which] - 1]]
            rows = m.merge_rows(rows)
            counts = (rows >= 0).sum(axis=1)
            for k in np.flatnonzero(~ends & (n > 0)).tolist():
                length = m.n_bytes[rows[k, : counts[k]]]
                counts[k] = np.searchsorted(np.cumsum(length) - length, n[k] - m.lookahead)
            flat = rows[np.arange(rows.shape[1]) < counts[:, None]].astype("<u4").tobytes()
            cuts = [0, *(np.cumsum(counts) * 4).tolist()]
            for i, start, stop in zip(some, cuts, cuts[1:]):
                out[i] = flat[start:stop]
        return out

    def _length(self, ids: bytes) -> int:
        return int(self.merges.n_bytes[np.frombuffer(ids, "<u4")].sum())

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; pieces longer than a window advance window by window."""
        window = self.window
        out = self._step([p[:window] for p in pieces], [len(p) <= window for p in pieces])
        at = {i: self._length(out[i]) for i, p in enumerate(pieces) if len(p) > window}
        parts = {i: [out[i]] for i in at}
        while at:
            last = [a + window >= len(pieces[i]) for i, a in at.items()]
            made = self._step([pieces[i][a : a + window] for i, a in at.items()], last)
            for i, ids in zip(at, made):
                parts[i].append(ids)
            at = {i: a + self._length(ids) for (i, a), ids, ended in zip(at.items(), made, last) if not ended}
        for i, found in parts.items():
            out[i] = b"".join(found)
        return out

    def advance(self, held: bytes) -> tuple[list[bytes], bytes]:
        """The ids that are final although more follows, and the bytes that are left."""
        out, at = [], 0
        while len(held) - at > self.window:
            out.append(self._step([held[at : at + self.window]], [False])[0])
            at += self._length(out[-1])
        return out, held[at:]

    def stream(self, chunks: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of one piece that arrives in chunks, as soon as they are final."""
        held = b""
        for chunk in chunks:
            ids, held = self.advance(held + chunk)
            yield from ids
        if held:
            yield self._step([held], [True])[0]


class Decoder:
    """Bytes to text, one piece at a time: holds at most the bytes of one unfinished character."""

    def __init__(self):
        self.held = b""

    def push(self, data: bytes, end: bool = False) -> str:
        data = self.held + data
        cut = len(data)
        if not end:
            # A sequence that has begun in the last three bytes may go on in the next piece.
            for back in range(1, min(3, len(data)) + 1):
                byte = data[-back]
                if byte >= 0xC0:
                    needed = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                    cut -= back if needed > back else 0
                    break
                if byte < 0x80:
                    break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")


class Tokenizer:
    """Words, ids and texts by a vocabulary file of the tokenizers library's format.

    Reads files with byte-level symbols, a merge list and an end-of-word suffix, whose
    texts are composed (NFC), freed of white space and lower-cased. Added tokens that
    occur in a text are one id each, as the library has it.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a lower-casing byte-level vocabulary with word ends")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(Merges(model["vocab"], merges, model["end_of_word_suffix"]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = self.transducer.merges.tokens | {i: t for t, i in self.added.items()}
        self._added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._marks = {t[0] for t in self.added}
        self._longest = max(map(len, self.added), default=1)
        if any(regex.search(r"\s", t) for t in self.added):
            raise ValueError(f"{path} has added tokens with blanks")
        self._pieces = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self._recent: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._words = words

    def _fold(self, text: str) -> str:
        """The text composed and lower-cased."""
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: a sigma at a word's end has no form of its own here.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _split(self, text: str) -> list[str]:
        """The white-space separated words of a text, composed and lower-cased."""
        text = self._fold(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in regex.split(r"\p{White_Space}+", text) if w]
        return text.split()

    def words(self, text: str) -> list[str]:
        """Words and added tokens of a text, in order; added tokens start with a blank."""
        if self._added is None or not any(m in text for m in self._marks):
            return self._split(text)
        out = []
        for n, part in enumerate(self._added.split(text)):
            out += [" " + part] if n % 2 else self._split(part)
        return out

    def _cut(self, word: str) -> list[str]:
        """The pieces of a word that is not all letters; most have one mark at the end."""
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self._pieces.findall(word)

    def _resolve(self, missing: set[str], known: dict[str, bytes]) -> None:
        """Adds the ids of words to ``known``. A piece has the ids it has as a word of its own."""
        plain = list(filter(str.isalpha, missing))
        mixed = missing.difference(plain)
        if self._added is not None:
            marks = {w for w in mixed if w[0] == " "}
            known.update((w, self.added[w[1:]].to_bytes(4, "little")) for w in marks)
            mixed -= marks
        mixed = list(mixed)
        cut = list(map(self._cut, mixed))
        new = plain + list(set(chain.from_iterable(cut)).difference(known).difference(plain))
        known.update(zip(new, self.transducer.encode(list(map(str.encode, new)))))
        known.update(zip(mixed, [b"".join([known[p] for p in parts]) for parts in cut]))

    def parts(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words, in order.

        Words are kept in two generations: a full one becomes the older one, from which
        words that turn up again come back.
        """
        cut = [self.words(t) for t in texts]
        needed = set(chain.from_iterable(cut))
        if len(self._recent) + len(needed) > self._words:
            self._older, self._recent = self._recent, {}
        recent, older = self._recent, self._older
        missing = needed.difference(recent)
        unknown = missing.difference(older)
        recent.update((w, older[w]) for w in missing - unknown)
        if unknown:
            self._resolve(unknown, recent)
        out = [list(map(recent.__getitem__, words)) for words in cut]
        if len(recent) > self._words:
            self._recent = {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(p) for p in self.parts(texts)]

    def cut(self, chunks: Iterable[str]) -> Iterator[str | bytes]:
        """A text that arrives in chunks, as texts to encode on their own and ids of long runs, in order."""
        held, long = "", None
        for chunk in chunks:
            held += chunk
            if long is not None:
                blank = _BLANK.search(held)
                yield from long.push(held[: blank.start()] if blank else held, bool(blank))
                if not blank:
                    held = ""
                    continue
                held, long = held[blank.start() :], None
            end = max(held.rfind(" "), held.rfind("\n")) + 1
            if end:
                yield held[:end]
                held = held[end:]
            if len(held) > LONG_CHARS:
                long = LongWord(self)
                yield from long.push(held)
                held = ""
        if long is not None:
            yield from long.push(held, True)
        elif held:
            yield held

    def stream(self, texts: Iterable[Iterable[str]]) -> Iterator[tuple[int, bytes]]:
        """Ids of many texts, each in chunks, with the number of the text, as they become final.

        Up to ``GROUP_CHARS`` of them are held, so that new words are merged side by side.
        """
        held, size = [], 0

        def flush():
            found = iter(self.encode([part for _, part in held if isinstance(part, str)]))
            return [(n, next(found) if isinstance(part, str) else part) for n, part in held]

        for n, chunks in enumerate(texts):
            for part in self.cut(chunks):
                held.append((n, part))
                size += len(part)
                if size >= GROUP_CHARS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()


_BLANK = regex.compile("[ \n]")
_RUNS = {True: regex.compile(r"\p{L}+"), False: regex.compile(r"[^\s\p{L}\p{N}]+")}
_LETTER = regex.compile(r"\p{L}")
_LOOK = 3  # the longest of the file's contractions


def _may_join(char: str) -> bool:
    """Whether a character may compose with what is before it: marks, vowels and finals of Hangul."""
    return unicodedata.category(char)[0] == "M" or "\u1160" <= char <= "\u11ff"


class LongWord:
    """A run of text without blanks that arrives in chunks."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.transducer = tokenizer, tokenizer.transducer
        self.raw = ""  # as it came
        self.text = ""  # composed and lower-cased, not yet cut into pieces
        self.run: bool | None = None  # inside a long piece: of letters, or of what is no letter, number or blank
        self.held = b""  # of that piece, in the transducer

    def _border(self) -> int:
        """Where the raw text may be cut: no composition and no added token goes across."""
        at = len(self.raw) - self.tokenizer._longest
        while at > 0 and _may_join(self.raw[at]):
            at -= 1
        for token in self.tokenizer.added:
            found = self.raw.find(token, max(0, at - len(token) + 1), max(0, at + len(token) - 1))
            at = found if 0 <= found < at else at
        return max(at, 0)

    def push(self, raw: str, end: bool = False) -> Iterator[str | bytes]:
        self.raw += raw
        at = len(self.raw) if end else self._border()
        ready, self.raw = self.raw[:at], self.raw[at:]
        added = self.tokenizer._added
        for n, part in enumerate(added.split(ready) if added is not None else [ready]):
            if n % 2:
                yield from self._finish()
                yield self.tokenizer.added[part].to_bytes(4, "little")
            else:
                self.text += self.tokenizer._fold(part)
                yield from self._pieces()
        if end:
            yield from self._finish()

    def _pieces(self) -> Iterator[str | bytes]:
        if self.run is not None:
            found = _RUNS[self.run].match(self.text)
            length = found.end() if found else 0
            ids, self.held = self.transducer.advance(self.held + self.text[:length].encode())
            yield from ids
            self.text = self.text[length:]
            if not self.text:
                return
            yield from self._close()
        done, rest = [], len(self.text)
        for piece in self.tokenizer._pieces.finditer(self.text):
            if piece.end() > len(self.text) - _LOOK:
                rest = piece.start()
                break
            done.append(piece.group())
        self.text = self.text[rest:]
        if done:
            yield " ".join(done)
        if len(self.text) > LONG_CHARS + 2 * _LOOK:  # longer than a contraction or number: one run
            self.run = bool(_LETTER.match(self.text))
            yield from self._pieces()

    def _close(self) -> Iterator[bytes]:
        yield from self.transducer.stream([self.held])
        self.run, self.held = None, b""

    def _finish(self) -> Iterator[str | bytes]:
        if self.run is not None:
            yield from self._close()
        if self.text:
            yield " ".join(self.tokenizer._pieces.findall(self.text))
        self.text = ""


@lru_cache(maxsize=4)
def tokenizer(path: str, words: int = CACHE_WORDS) -> Tokenizer:
    """One tokenizer per Python worker, file and size; its word cache outlives a task.

    Operators that do without call ``tokenizer.cache_clear()`` when a task begins, since a
    worker that has served an encoder before would keep its words for nothing.
    """
    return Tokenizer(path, words)


def chunks_of(text, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A text (a string or an Arrow string; null is empty) chunk by chunk."""
    text = (text if text is None or isinstance(text, str) else text.as_py()) or ""
    return (text[at : at + size] for at in range(0, len(text), size))


def batches(texts: Iterable, most_chars: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Whole texts (strings or Arrow strings) in groups of about ``most_chars``, with the number of the first; null is empty."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        held.append((text if text is None or isinstance(text, str) else text.as_py()) or "")
        size += len(held[-1])
        if size >= most_chars:
            yield first, held
            first, held, size = n + 1, [], 0
    if held:
        yield first, held
