"""Delivery in two phases: what is told of broken writes, and what readers see."""

import os

import pytest
from bindery import deliver_documents, delivery_report, read_tree, written_outcomes
from bindery.targets import committed, delivered_files, delivered_lines, delivered_roots, target_class, workspace_folder

ROWS = [(w, f"{n}.md", f"{w} {n} — é\n") for w in ("a", "b", "c d/e", "..", "") for n in range(4)]


def chunks(spark, rows=ROWS):
    return spark.createDataFrame(rows, "workspace string, name string, content string").repartition(4)


def held_files(spark, path):
    found = read_tree(delivered_roots(delivery_report(spark, path), path))
    return sorted((r.workspace, r.path, bytes(r.raw).decode()) for r in found.collect())


def test_two_targets_hold_the_same(spark, tmp_path):
    for target in ("files", "jsonl"):
        report = deliver_documents(chunks(spark), str(tmp_path / target), target=target)
        assert {r.workspace: r.sum for r in report.groupBy("workspace").sum("parts").withColumnRenamed("sum(parts)", "sum").collect()} == dict.fromkeys({w for w, _, _ in ROWS}, 4)
    assert held_files(spark, str(tmp_path / "files")) == sorted(ROWS)
    assert sorted(map(tuple, delivered_files(spark, str(tmp_path / "files")).collect())) == sorted(ROWS)
    assert sorted(map(tuple, delivered_lines(spark, str(tmp_path / "jsonl")).collect())) == sorted(ROWS)


def test_a_workspace_that_cannot_be_written_fails_alone(spark, tmp_path):
    long = "x" * 400
    rows = [*ROWS, (long, "0.md", "never"), ("climbs", "../up.md", "never"), ("climbs", "ok.md", "partly")]
    outcomes = spark.createDataFrame([(w, "delivered", "d") for w in ("a", long, "climbs", "gone")] + [("b", "cancelled", None)], "workspace string, outcome string, detail string")
    report = deliver_documents(chunks(spark, rows), str(tmp_path / "out"))
    got = {r.workspace: (r.outcome, r.detail) for r in written_outcomes(outcomes, report).collect()}
    assert got["a"] == ("delivered", "d") and got["b"] == ("cancelled", None)
    assert got["gone"] == ("failed", "nothing was written")
    assert got[long][0] == "failed" and "too long" in got[long][1]
    assert got["climbs"][0] == "failed" and "no name" in got["climbs"][1]
    assert [r for r in held_files(spark, str(tmp_path / "out")) if r[0] != "climbs"] == sorted(ROWS)


def test_a_task_that_fails_delivers_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    deliver_documents(chunks(spark, [("before", "1.md", "stays")]), path)
    with pytest.raises(Exception, match="the store is gone"):
        deliver_documents(chunks(spark), path, target="tests.broken_target:Broken")
    assert len(committed(path)) == 1
    assert held_files(spark, path) == [("before", "1.md", "stays")]
    assert len([n for n in os.listdir(path) if n.startswith("run-")]) == 1


def test_no_rows(spark, tmp_path):
    report = deliver_documents(chunks(spark).limit(0), str(tmp_path / "out"))
    assert report.count() == 0
    assert delivered_lines(spark, str(tmp_path / "out")).count() == 0


def test_targets_by_name():
    with pytest.raises(ValueError, match="files, jsonl"):
        target_class("tape")
    assert workspace_folder("a b/%=") == "w=a=20b=2F=25=3D"
    assert len({workspace_folder(w) for w in ("a=20b", "a b", "..", "")}) == 4
