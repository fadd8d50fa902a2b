"""The tree source: what it lists, what it never lists or opens, and how it plans."""

import itertools
import os
import random

import pytest
from bindery import list_tree, literal_settings, read_tree, scan_tree
from bindery.operators.ignore import parse_rules
from bindery.operators.settings import compiled_rules
from bindery.sources import tree_source
from bindery.sources.folders import LocalFolders
from bindery.sources.tree_source import TreeReader, _closes, _says, rules_text
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

FILES = {
    "a.md": 3, "src/a.py": 10, "src/deep/er/b.py": 20, "src/big.py": 5000, "src/.hidden/c.py": 5, ".gitignore": 9,
    "node_modules/p/x.js": 7, "src/Dist/y.js": 7, "logs/one.log": 4, "logs/keep/two.log": 4, "logs/keep/deep/three.log": 4, "tmp one/a b.py": 6,
}
IGNORE = "logs/*\n!logs/keep/\n*.pyc\n/src/deep\n"


@pytest.fixture
def tree(tmp_path):
    for name, size in FILES.items():
        target = tmp_path / "t" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * size)
    os.symlink(tmp_path / "t" / "a.md", tmp_path / "t" / "link.md")
    os.mkdir(tmp_path / "t" / "empty")
    return str(tmp_path / "t")


@pytest.fixture
def rules(spark):
    settings = literal_settings(include_extensions=[], ignore_patterns=["node_modules", "d*t"], max_file_size_kb=2)
    one = spark.range(1).select(F.lit("w").alias("workspace"), settings.alias("s"), parse_rules(F.lit(IGNORE)).alias("r"))
    return one.select("workspace", compiled_rules(F.col("s"), F.col("r")).alias("rules"))


class Watched(LocalFolders):
    """Notes what is listed and opened."""

    listed: list[str] = []
    opened: list[str] = []

    def entries(self, path):
        self.listed.append(path)
        return super().entries(path)

    def read(self, path):
        self.opened.append(path)
        if path == "src/big.py":
            raise OSError("this file cannot be read")
        return super().read(path)


@pytest.fixture
def watched(monkeypatch):
    monkeypatch.setattr(tree_source, "folders", Watched)
    monkeypatch.setattr(Watched, "listed", [])
    monkeypatch.setattr(Watched, "opened", [])
    return Watched


def walk(tree, filters=(), content=False, wanted=3, starts=None):
    reader = TreeReader(starts or [("w", tree, "")], content, wanted)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


def test_every_regular_file_once(tree, watched):
    rows = walk(tree)
    assert {r["path"]: r["size_bytes"] for r in rows} == FILES and len(rows) == len(FILES)
    assert {r["folder"] for r in rows if r["path"] in ("a.md", "src/deep/er/b.py")} == {"/", "/src/deep/er/"}
    assert sorted(watched.listed) == sorted(set(watched.listed))


def test_ignored_folders_are_never_listed(spark, tree, rules, watched):
    rows = walk(tree, [EqualTo(("rules",), rules_text(rules))])
    assert sorted(watched.listed) == ["", "empty", "logs", "src", "src/.hidden", "tmp one"]
    assert {r["path"] for r in rows} == {p for p in FILES if not p.startswith(("node_modules/", "src/Dist/", "src/deep/", "logs/keep/"))}


def test_large_files_are_never_opened(tree, rules, watched):
    rows = walk(tree, [EqualTo(("rules",), rules_text(rules))], content=True)
    assert next(r for r in rows if r["path"] == "src/big.py")["content"] is None
    assert "src/big.py" not in watched.opened and "src/a.py" in watched.opened
    watched.opened.clear()
    rows = walk(tree, [LessThanOrEqual(("size_bytes",), 10), GreaterThan(("size_bytes",), 5)], content=True)
    assert sorted(watched.opened) == sorted(r["path"] for r in rows) == sorted(p for p, n in FILES.items() if 5 < n <= 10)
    with pytest.raises(OSError, match="cannot be read"):
        walk(tree, content=True)


def test_filters_on_folders_prune(tree, watched):
    rows = walk(tree, [Not(StringContains(("folder",), "/node_modules/")), Not(StringStartsWith(("path",), "logs/"))])
    assert not [d for d in watched.listed if d.startswith(("node_modules", "logs"))]
    assert {r["path"] for r in rows} == {p for p in FILES if not p.startswith(("node_modules/", "logs/"))}
    watched.listed.clear()
    assert {r["path"] for r in walk(tree, [StringStartsWith(("folder",), "/src/deep/")])} == {"src/deep/er/b.py"}
    assert sorted(watched.listed) == ["", "src", "src/deep", "src/deep/er"]
    watched.listed.clear()
    assert not walk(tree, [EqualTo(("workspace",), "other")]) and not watched.listed


def test_planning_is_bounded(tree, watched, monkeypatch):
    for most, wanted in ((0, 2), (3, 2), (20_000, 50)):
        monkeypatch.setattr(tree_source, "PLAN_ENTRIES", most)
        rows = walk(tree, wanted=wanted)
        assert sorted(r["path"] for r in rows) == sorted(FILES)
    # The root is too large to plan with: every task goes on with its part of it.
    monkeypatch.setattr(tree_source, "PLAN_ENTRIES", 3)
    reader = TreeReader([("w", tree, "")], False, 4)
    read = [sum(b.num_rows for b in reader.read(part)) for part in reader.partitions()]
    assert sum(read) == len(FILES) and sum(n > 0 for n in read) > 1


def test_a_filter_never_closes_a_folder_with_a_match():
    rng = random.Random(5)
    names = ["a", "b", "ab", "a b"]
    texts = ["/", "a", "/a", "a/", "/a/", "/a/b/", "b/a", "ab", "/ab", "x"]
    for _ in range(4000):
        folder = "/".join(rng.choices(names, k=rng.randint(1, 3)))
        below = "/".join(rng.choices(names, k=rng.randint(0, 2)))
        inner = f"{folder}/{below}" if below else folder
        values = {"folder": f"/{inner}/", "path": f"{inner}/{rng.choice(names)}"}
        column, text = rng.choice(["folder", "path"]), rng.choice(texts)
        kind = rng.choice([StringStartsWith, StringContains, StringEndsWith, EqualTo])
        f = In((column,), tuple(rng.choices([*texts, *values.values()], k=2))) if rng.random() < 0.2 else kind((column,), rng.choice([text, values[column]]))
        for test in (f, Not(f)):
            if _says(test, values[column]):
                assert not _closes(test, column, f"/{folder}/"), (test, folder, values)


def test_scan_under_spark(spark, tree):
    found = scan_tree(spark, [("w", f"file://{tree}", "")], content=True)
    rows = found.where(~F.col("folder").contains("/node_modules/") & (F.col("size_bytes") < 100)).collect()
    wanted = {p for p, n in FILES.items() if n < 100 and not p.startswith("node_modules/")}
    assert {r.path for r in rows} == wanted and all(len(r.content) == r.size_bytes for r in rows)


def test_planned_and_level_walks_agree(spark, tree, rules):
    roots = spark.createDataFrame([("w", tree), ("other", tree + "/src")], "workspace string, root string")
    picks = spark.createDataFrame([("w", "src"), ("w", "./src/deep/"), ("w", "logs/keep"), ("w", "logs/keep/two.log"), ("w", "a.md"), ("other", "deep")], "workspace string, prefix string")
    for given, selection in itertools.product((None, rules), (None, picks)):
        # Without rules of its own a workspace is dropped by neither way.
        ways = [sorted(map(tuple, list_tree(roots, given, selection, plan_bytes=n).collect())) for n in (1 << 20, 0)]
        assert ways[0] == ways[1] and ways[0]
    read = [sorted((r.path, r.size_bytes, None if r.raw is None else len(r.raw)) for r in read_tree(roots, rules, plan_bytes=n).collect()) for n in (1 << 20, 0)]
    assert read[0] == read[1] and ("src/big.py", 5000, None) in read[0]
