import random

import numpy as np
import tokenizers
from bindery.llm.encoding import vocabulary
from bindery.llm.idfile import pack_codes, read_ids, read_segment, unpack_codes, write_ids, write_segment


def test_codes_of_all_lengths():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 1000):
        codes = np.array([rng.randrange(1 << rng.choice([1, 8, 9, 16, 17, 24, 25, 32])) for _ in range(n)], np.uint32)
        control, data = pack_codes(codes)
        assert len(control) == -(-n // 4)
        assert len(data) == sum(max(1, (int(c).bit_length() + 7) // 8) for c in codes)
        assert np.array_equal(unpack_codes(control, data, n), codes)


def test_segments():
    counts, codes = np.array([0, 3, 1, 70_000]), np.arange(70_004, dtype=np.uint32)
    found = read_segment(write_segment(counts, codes))
    assert np.array_equal(found[0], counts) and np.array_equal(found[1], codes)


def test_documents(spark, awkward, awkward_rows, tmp_path, monkeypatch):
    monkeypatch.setattr("bindery.llm.idfile.SEGMENT_IDS", 700)
    library = tokenizers.Tokenizer.from_file(vocabulary())
    write_ids(awkward, vocabulary(), str(tmp_path / "ids"))
    rows = sorted(read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    at = 0
    for row in rows:
        assert row.start == at and len(row.ids) == 4 * row.n_tokens
        at += row.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys)
    want = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in awkward_rows]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, no_documents, tmp_path):
    write_ids(no_documents, vocabulary(), str(tmp_path / "ids"))
    assert read_ids(spark, str(tmp_path / "ids")).collect() == []
