import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import tokenizers
from bindery.llm import bpe
from bindery.llm.bpe import Decoder, Merges, Tokenizer, Transducer, byte_alphabet, chunks_of
from bindery.llm.encoding import Digests, decode_documents, encode_documents, round_trip, vocabulary

ALPHABET = ["a", "B", "the", "'s", "'LL", "1", "²", "é", "é", "Σ", "İ", "ß", "中", "<|endoftext|>", "<|end", " ", "\n", "\x1c", "\x85", "​", "_", "😀", "\x00", "ǅ", "한", "''", " "]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return Tokenizer(vocabulary(), words=500)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_as_the_library(own, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids_of(x) for x in own.encode(texts)] == want


def test_long_pieces_through_small_windows(library):
    own = Tokenizer(vocabulary())
    rng = random.Random(5)
    pieces = ["".join(rng.choice("aehtinlo") for _ in range(n)) for n in (291, 1000, 7000)] + ["a" * 5000, "thth" * 900, "é" * 700]
    assert [ids_of(x) for x in own.encode(pieces)] == [library.encode(p, add_special_tokens=False).ids for p in pieces]
    data = pieces[2].encode()
    streamed = b"".join(own.transducer.stream([data[i : i + 13] for i in range(0, len(data), 13)]))
    assert ids_of(streamed) == library.encode(pieces[2], add_special_tokens=False).ids


def streamed(own, texts, size):
    out = [[] for _ in texts]
    for n, part in own.stream(chunks_of(t, size) for t in texts):
        out[n] += ids_of(part)
    return out


def test_texts_in_chunks_as_the_library(own, library, monkeypatch):
    """Chunks cut anywhere: inside words, contractions, added tokens and composed characters."""
    rng = random.Random(6)
    alphabet = [*ALPHABET, "e\u0301", "\u0301", "\u1112\u1161\u11ab", "'re", "\u3000", "\u2028", "\t", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["".join(rng.choice([c for c in alphabet if c not in " \n"]) for _ in range(150)) for _ in range(30)]
    texts += ["a" * 900 + "'s" + "!" * 700 + "'re<|endoftext|>" + "é" * 500 + "1" * 40, "x" + "\u0301\u0327" * 200 + "y"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for long, size in ((4096, 1), (20, 7), (1, 1), (1, 64)):
        monkeypatch.setattr(bpe, "LONG_CHARS", long)
        assert streamed(own, texts, size) == want


def test_stream_needs_constant_memory(own):
    """Memory stays the same at four times the length, with and without blanks."""
    numbers, pieces = list(map(str, range(50_000))), {i: t.encode() for i, t in own.tokens.items()}

    def peak(chunk, times):
        digests = Digests(numbers, pieces)
        tracemalloc.start()
        for _, part in own.stream([chunk] * times for _ in range(1)):
            digests.push(ids_of(part))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, digests.n

    for chunk, times in (("some words, and more of them. " * 700, 30), ("xy" * 100, 5)):
        peak(chunk, 30)
        (little, n), (much, more) = peak(chunk, 2 * times), peak(chunk, 8 * times)
        assert 3.9 * n < more < 4.1 * n and much < 1.5 * little + (1 << 20)


def naive(symbols, ranks):
    while True:
        best = min(((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(10**9, 0))
        if best[0] == 10**9:
            return symbols
        i = best[1]
        symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]


def test_look_ahead_suffices_for_random_merge_lists():
    letters = byte_alphabet()
    for seed in range(25):
        rng = random.Random(seed)
        tokens = ["a", "b", "c"]
        merges = []
        while len(merges) < 14:
            pair = (rng.choice(tokens), rng.choice(tokens))
            if pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 9:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        vocab = {t: i for i, t in enumerate([*letters, *[t for t in tokens if len(t) > 1]])}
        m = Merges(vocab, merges)
        transducer = Transducer(m, window=1)
        ranks = {p: i for i, p in enumerate(merges)}
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 400))) for _ in range(20)]
        found = transducer.encode([t.encode() for t in texts])
        assert [[m.tokens[i] for i in ids_of(f)] for f in found] == [naive(list(t), ranks) for t in texts]


def test_decoder_holds_back_unfinished_characters():
    data = "aé中😀b".encode()
    for size in range(1, 6):
        decoder = Decoder()
        out = [decoder.push(data[i : i + size]) for i in range(0, len(data), size)]
        assert "".join(out) + decoder.push(b"", end=True) == "aé中😀b"
    decoder = Decoder()
    assert decoder.push(b"\xff\xe4\xb8") + decoder.push(b"x") + decoder.push(b"\xf0\x9f", end=True) == "��x�"


def test_documents(awkward, awkward_rows, library):
    encoded = encode_documents(awkward, vocabulary())
    want = sorted(((d, library.encode(t or "", add_special_tokens=False).ids) for d, t in awkward_rows), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr) == want
    decoded = decode_documents(encoded, vocabulary())
    texts = sorted(((d, library.decode(i, skip_special_tokens=False)) for d, i in want), key=repr)
    assert sorted(((r.doc_id, r.text) for r in decoded.collect()), key=repr) == texts


def test_round_trip(awkward, awkward_rows, library):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc, text in awkward_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = round_trip(awkward, vocabulary())
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table_and_null_ids(spark, no_documents):
    assert round_trip(no_documents, vocabulary()).collect() == []
    assert encode_documents(no_documents, vocabulary()).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, decode_documents(rows, vocabulary()).collect())) == [(1, ""), (2, "")]


def test_full_cache_starts_again(library):
    own = Tokenizer(vocabulary(), words=3)
    for text in ("one two three four five", "one two", "six one", "one, two. six's", "two"):
        assert ids_of(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids
    assert len(own._recent) <= 3 and len(own._older) <= 3
