"""Chunks of documents against the documents themselves."""

import random

import pytest
from bindery import document_chunks, join_blocks, pack
from bindery.operators.chunks import block_offsets

BLOCKS = "workspace string, position string, text string"


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(3)
    rows = []
    for workspace in ("", "a", "b", "hot"):
        for n in range(300 if workspace == "hot" else 12):
            rows.append((workspace, f"{n // 2:04d}", "".join(rng.choices("ab\né😀中", k=rng.choice([0, 1, 5, 40])))))
    rows += [("same", "0", "tie "), ("same", "0", "tie "), ("same", "0", "a"), ("long", "0", "start "), ("long", "1", "é😀x\n" * 5000), ("long", "2", " end"), ("none", "0", "")]
    return spark.createDataFrame(rows, BLOCKS).repartition(7)


@pytest.mark.parametrize("chars", [1, 7, 64, 1 << 16])
def test_chunks_are_the_document(blocks, chars):
    whole = {r.workspace: r.text for r in join_blocks(blocks).collect() if r.text}
    cut = document_chunks(blocks if chars > 1 else blocks.where("workspace != 'long'"), chars)
    assert cut.columns == ["workspace", "position", "offset", "text"]
    wanted = [(w, n, n * chars, t[n * chars : (n + 1) * chars]) for w, t in whole.items() if chars > 1 or w != "long" for n in range(-(-len(t) // chars))]
    assert sorted(map(tuple, cut.collect())) == sorted(wanted)


def test_offsets(blocks):
    found = {}
    for r in block_offsets(blocks).collect():
        found.setdefault(r.workspace, []).append((r.offset, r.position, r.text))
    for rows in found.values():
        at = 0
        for offset, _, text in sorted(rows, key=lambda r: (r[1], r[2])):
            assert offset == at
            at += len(text)


def test_no_blocks(spark):
    assert document_chunks(spark.createDataFrame([], BLOCKS)).count() == 0


def test_masked_tasks(spark):
    files = spark.createDataFrame([("w", 1, "a.md", "x", 1), ("off", 1, "a.md", "x", 1)], "workspace string, ordinal bigint, path string, content string, size_bytes bigint")
    secret = 'use password = "hunter2" at Projects/app'
    settings = '{"outputLanguage":"en","secretGuard.extraPatterns":["Projects/(app)"]%s}'
    spaces = spark.createDataFrame([("w", secret, settings % ""), ("off", secret, settings % ',"secretGuard.enabled":false')], "workspace string, task string, settings_json string")
    heads = {}
    for masked in (False, True):
        tables = pack(files, spaces, guard_task=masked)
        heads[masked] = {r.workspace: r.text for r in join_blocks(tables.documents).collect()}
        tables.close()
    assert all(secret in t for t in heads[False].values()) and secret in heads[True]["off"]
    assert "hunter2" not in heads[True]["w"] and "Projects/<REDACTED:custom-1>" in heads[True]["w"]
