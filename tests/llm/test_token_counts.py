"""Token counts against the library, and the heap against plain rescans."""

import random

import pytest
from bindery.llm.encoding import vocabulary
from bindery.llm.token_counts import Counter, MergeList, count_tokens

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_rows(spark, awkward, awkward_rows, library):
    rows = count_tokens(awkward, PATH, limit=40).collect()
    texts = [t or "" for _, t in awkward_rows]
    wanted = [(i, len(t.encode()), n, n > 40) for (i, _), t, n in zip(awkward_rows, texts, expected(library, texts))]
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)


def test_no_rows(no_documents):
    found = count_tokens(no_documents, PATH, limit=512)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert found.count() == 0


def test_random_texts(library):
    rng = random.Random(11)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "'ll", "é", "\x85", "\x1c", "　", "<|endoftext|>", "<|end", "1", "٣", "😀", "ll", "中", "Σ", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(4000)]
    assert Counter(PATH).count(texts) == expected(library, texts)


def test_long_texts(library, monkeypatch):
    rng = random.Random(12)
    text = " ".join("".join(rng.choices("aeinorst ", k=9)) for _ in range(3000)) + "ab" * 50_000 + "<|endoftext|>" + "é " * 999
    wanted = expected(library, [text])
    assert Counter(PATH).count([text]) == wanted
    monkeypatch.setattr("bindery.llm.token_counts.LONG_CHARS", 100)
    monkeypatch.setattr("bindery.llm.token_counts.PIECES_AT_ONCE", 7)
    assert Counter(PATH).count([text, "", text]) == [wanted[0], 0, wanted[0]]


def test_a_small_cache_changes_nothing(library):
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(50)]
    small = Counter(PATH, pieces=20)
    assert [small.count([t])[0] for t in texts] == expected(library, texts)


def test_heap_against_rescans():
    merges = [("a", "b"), ("b", "c"), ("ab", "ab"), ("a", "bc"), ("c", "a"), ("abab", "c"), ("a", "a"), ("aa", "a"), ("bc", "ab")]
    rank = {pair: n for n, pair in enumerate(merges)}

    def rescan(text):
        symbols = list(text)
        while known := [(rank[p], at) for at, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
            at = min(known)[1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return len(symbols)

    rng, counts = random.Random(14), MergeList(merges)
    for _ in range(2000):
        text = "".join(rng.choices("abcd", k=rng.randint(0, 30)))
        assert counts.count(text.encode()) == rescan(text), text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        Counter(vocabulary())
