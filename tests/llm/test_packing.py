import random
import zlib

import numpy as np
import pytest
import tokenizers
from bindery.llm.encoding import vocabulary
from bindery.llm.packing import Packer, pack_documents


def ids(n, start=0):
    return np.arange(start, start + n, dtype="<u4").tobytes()


@pytest.mark.parametrize("max_open", [3, 1000])
def test_every_id_once_and_no_padding(max_open):
    rng = random.Random(max_open)
    packer, sizes, done = Packer(64, max_open), [rng.choice([1, 2, 31, 33, 64, 65, 200, rng.randint(1, 90)]) for _ in range(500)], []
    for n, size in enumerate(sizes):
        done += packer.place((n, 0, ids(size), size))
        assert packer.n_open <= max_open + 1
        assert packer.count.sum() == packer.n_open == sum(map(len, packer.levels))
    done += packer.close()
    assert packer.n_open == 0
    found = {}
    for pieces in done:
        length = sum(len(p[2]) // 4 for p in pieces)
        assert length <= 64 and length & (length - 1) == 0  # full or a power of two: never padded
        for doc, start, data, total in pieces:
            assert total == sizes[doc] and len(data)
            found.setdefault(doc, []).append((start, data))
    for n, size in enumerate(sizes):
        assert b"".join(data for _, data in sorted(found[n])) == ids(size)
        at = 0
        for start, data in sorted(found[n]):
            assert start == at
            at += len(data) // 4


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(2)
    for _ in range(300):
        packer = Packer(16)
        packer.count[1:16] = [rng.choice([0, 0, 1, 2, 5]) for _ in range(15)]
        size = rng.randint(1, 15)

        def cost(level):
            count = packer.count.copy()
            if level:
                count[level] -= 1
            if level + size < 16:
                count[level + size] += 1
            return int((count[1:16] ** 2).sum())

        allowed = [0] + [h for h in range(1, 17 - size) if packer.count[h]]
        assert cost(packer.level_for(size)) == min(map(cost, allowed))


def test_documents(awkward, awkward_rows):
    library = tokenizers.Tokenizer.from_file(vocabulary())
    rows = pack_documents(awkward, vocabulary()).collect()
    want = sorted([np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for _, t in awkward_rows])
    # Rows that repeat an id are told apart by their lengths and texts here.
    joined = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) >= 0
        joined.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    whole = []
    for (_, total), pieces in joined.items():
        copies = sum(p.length for p in pieces) // total
        assert sum(p.length for p in pieces) == copies * total
        if copies == 1:
            whole.append(b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start)))
        else:
            whole += [p.ids for p in pieces if p.length == total]
    assert sorted(whole) == want
    fills = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert all(f == 2048 or f & (f - 1) == 0 for f in fills.values())


def test_empty_table(no_documents):
    assert pack_documents(no_documents, vocabulary()).collect() == []
