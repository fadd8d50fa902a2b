"""The pipeline's stages against brute force, each on what the stage before it kept."""

import os

import numpy as np
import pytest
import tokenizers
from test_exact_dedup import folded
from test_simhash import plain_fingerprint, roots
from test_substring_dedup import brute_force

import corpus_pipeline
from bindery.llm.encoding import vocabulary
from bindery.llm.toxicity import fit, score_toxicity

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF_DIR).write.parquet(str(folder / str(number)))
        tables.append(spark.read.parquet(str(folder / str(number))))
    return tables


def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_stages_are_those_of_the_plan(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for table in kept[1:5]:
        assert table.schema == kept[0].schema


def test_toxicity(spark, kept):
    model = fit(kept[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    clean = {r.doc_id for r in score_toxicity(kept[0], model).where("predicted = 0").collect()}
    assert set(texts(kept[1])) == clean
    assert len(clean) > 0.8 * kept[0].count()


def test_exact_copies(kept):
    given = texts(kept[1])
    last = {}
    for doc, text in given.items():
        last[folded(text)] = max(doc, last.get(folded(text), doc))
    assert texts(kept[2]) == {d: given[d] for d in last.values()}


def test_near_copies(kept):
    given = texts(kept[2])
    codes = {d: plain_fingerprint(t) for d, t in given.items()}
    root = roots(set(codes.values()), 4)
    first = {}
    for doc, code in codes.items():
        first[root[code]] = min(doc, first.get(root[code], doc))
    assert texts(kept[3]) == {d: given[d] for d in first.values()}


def test_repeated_passages(kept):
    given = texts(kept[3])
    want = {d: given[d] if not gone else text for d, text, _, gone in brute_force(list(given.items()))}
    assert texts(kept[4]) == want
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())


def test_packing(kept):
    library = tokenizers.Tokenizer.from_file(vocabulary())
    pieces = {}
    for r in kept[5].collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    found = {d: b"".join(i for _, i in sorted(p)) for d, p in pieces.items()}
    want = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for d, t in texts(kept[4]).items()}
    assert found == want


def test_run_gives_the_last_stage(spark, kept):
    found = corpus_pipeline.run(spark, SF_DIR)
    assert found.columns == kept[5].columns and found.count() == kept[5].count()
