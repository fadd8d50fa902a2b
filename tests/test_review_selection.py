import os

import pytest
from pyspark.sql import functions as F

from bindery import list_tree, merge_selection, read_contents, read_ignore_texts, select_files, selection_fallback, with_ordinals
from bindery.operators.ignore import parse_rules
from bindery.operators.joins import join_dimension
from bindery.operators.review import has_warning, review_reasons, review_required, run_summary
from bindery.operators.settings import compiled_rules, literal_settings
from bindery.sources.tree import split_by_size

BIG = "about 200,000 tokens, over your 100,000 warning threshold"


@pytest.mark.parametrize(
    "policy,tokens,threshold,masked,skipped,required,reasons",
    [
        ("onWarning", 1000, 100000, 0, 0, False, []),
        ("onWarning", 1000, 100000, 2, 0, True, ["2 value(s) were masked"]),
        ("onWarning", 1000, 100000, 0, 1, True, ["1 file(s) were left out"]),
        ("onWarning", 100001, 100000, 0, 0, True, ["about 100,001 tokens, over your 100,000 warning threshold"]),
        ("onWarning", 100000, 100000, 0, 0, False, []),
        ("onWarning", 9999999, 0, 0, 0, False, []),
        ("onWarning", 200000, 100000, 1, 3, True, [BIG, "1 value(s) were masked", "3 file(s) were left out"]),
        ("always", 1000, 100000, 0, 0, True, []),
        ("never", 1000, 100000, 5, 2, False, ["5 value(s) were masked", "2 file(s) were left out"]),
    ],
)
def test_review(spark, policy, tokens, threshold, masked, skipped, required, reasons):
    why = review_reasons(F.lit(tokens), F.lit(float(threshold)), F.lit(masked), F.lit(skipped))
    row = spark.range(1).select(why.alias("why"), review_required(F.lit(policy), why).alias("must")).first()
    assert (row.must, row.why) == (required, reasons)


def test_summary(spark):
    cols = [run_summary(*map(F.lit, n)) for n in ((3, 12400, 0, 0), (1, 5, 2, 1))]
    flags = [has_warning(F.lit(a), F.lit(b)) for a, b in ((0, 0), (1, 0), (0, 1))]
    assert tuple(spark.range(1).select(*cols, *flags).first()) == (
        "3 file(s) · ~12,400 tokens", "1 file(s) · ~5 tokens · 2 redacted · 1 skipped", False, True, True)


def paths(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_selection_by_folder_and_file(spark, limit):
    names = ["src/a.ts", "src\\core\\b.ts", "src2/c.ts", "docs/d.md", "e.md", "docs/deep/er/f.md"]
    files = spark.createDataFrame([("w", n) for n in names] + [("v", "src/a.ts")], "workspace string, path string")
    picked = spark.createDataFrame(
        [("w", "e.md", 0), ("w", "src/", 1), ("w", "src/core/b.ts", 2), ("w", "docs\\deep", 3), ("w", "src", 7)],
        "workspace string, prefix string, ordinal int")
    got = select_files(files, picked, broadcast_bytes=limit).select("workspace", "path", "selection_rank")
    assert paths(got) == [("w", "docs/deep/er/f.md", 3), ("w", "e.md", 0), ("w", "src/a.ts", 1), ("w", "src\\core\\b.ts", 1)]
    everything = spark.createDataFrame([("w", "")], "workspace string, prefix string")
    assert select_files(files, everything, broadcast_bytes=limit).count() == 6


def test_merge_and_fallback(spark):
    listed = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "a")], "workspace string, path string")
    default = spark.createDataFrame([("w", "b"), ("v", "z"), ("u", "y")], "workspace string, path string")
    assert paths(merge_selection(listed, default)) == [
        ("u", "y", True), ("v", "a", False), ("v", "z", True), ("w", "a", False), ("w", "b", False)]
    kinds = spark.createDataFrame(
        [("w", "a", 0), ("w", "b", 0), ("w", "c", 1), ("v", "d", 2), ("v", "e", 1)], "workspace string, path string, priority int")
    assert paths(selection_fallback(kinds).select("workspace", "path")) == [("v", "e"), ("w", "a"), ("w", "b")]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_join_agrees_with_the_plain_one(spark, how):
    facts = spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id % 700 END AS k", "'p' || id AS path", "id % 5 AS size")
    dim = spark.range(600).selectExpr("CASE WHEN id = 0 THEN 'hot' ELSE 'k' || id END AS k", "id AS v")
    plain = facts.join(dim, "k", how)
    split = join_dimension(facts, dim, ["k"], spread_by=["path"], weight=F.col("size"), how=how, broadcast_bytes=0)
    assert split.columns == plain.columns
    assert paths(split) == paths(plain)


def test_split_join_spreads_a_hot_key(spark):
    facts = spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id) AS k", "'p' || id AS path")
    dim = facts.select("k").distinct().withColumn("v", F.lit(1))
    split = join_dimension(facts, dim, ["k"], spread_by=["path"], broadcast_bytes=0, how="inner")
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "_share" in plan and split.count() == 4000


@pytest.mark.parametrize("extra", [(), ("",), ("a/" * 40 + "deep",)])
def test_many_picks(spark, extra):
    """More entries than a map is searched for: looked up by depth, or by equality where paths are too deep."""
    paths = [f"a/b{n % 7}/c{n}" for n in range(300)] + ["top", "a\\b1\\x", "./a/b2/y"]
    prefixes = [f"a/b1/c{n}" for n in range(90)] + ["./a/b2/", "a\\b1", "top", "a/b3/c3", "none", *extra]
    files = spark.createDataFrame([(w, p) for w in ("v", "w") for p in paths], "workspace string, path string")
    picked = spark.createDataFrame([("w", p, n) for n, p in enumerate(prefixes)], "workspace string, prefix string, ordinal int")
    clean = {p: p.replace("\\", "/").removeprefix("./").rstrip("/") for p in [*paths, *prefixes]}
    wanted = {}
    for p in paths:
        ranks = [n for n, q in enumerate(prefixes) if not clean[q] or clean[p] == clean[q] or clean[p].startswith(clean[q] + "/")]
        wanted |= {p: min(ranks)} if ranks else {}
    found = select_files(files, picked)
    assert {r.path: r.selection_rank for r in found.collect()} == wanted and {r.workspace for r in found.collect()} == {"w"}
    if extra != ("a/" * 40 + "deep",):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(workspace" not in plan.split("BroadcastExchange")[0]


def test_positions(spark):
    listing = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', 'w' || id % 4) AS workspace", "'f' || id AS path")
    got = with_ordinals(listing).groupBy("workspace").agg(
        F.sort_array(F.collect_list(F.struct("path", "ordinal"))).alias("all")).collect()
    for row in got:
        assert [x.ordinal for x in row["all"]] == list(range(1, len(row["all"]) + 1))


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "ws"
    contents = {
        "src/a.ts": b"export const a = 1;\n", "src/deep/er/b.ts": b"\xef\xbb\xbfb", "src/notes.txt": b"n", ".env": b"X=1",
        "src/bin.ts": b"\xff\xfe", "node_modules/pkg/i.ts": b"dep", "hidden/h.ts": b"h", ".gitignore": b"hidden/\n_gen\n",
        "_keep/k.ts": b"k", "_gen/g.ts": b"g", "empty.ts": b"", "big.ts": b"x" * 3000,
    }
    for name, data in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    os.symlink(root / "src", root / "linked")
    os.symlink(root / "src" / "a.ts", root / "src" / "link.ts")
    bare = tmp_path / "bare"
    bare.mkdir()
    return str(root), str(bare), contents


def test_tree_scan(spark, tree):
    root, bare, contents = tree
    roots = spark.createDataFrame([("w", root), ("v", bare)], "workspace string, root string")
    everything = list_tree(roots)
    assert {r.path: r.size_bytes for r in everything.collect()} == {p: len(d) for p, d in contents.items()}

    texts = read_ignore_texts(roots)
    assert {r.workspace: r.ignore_text for r in texts.collect()} == {"w": "hidden/\n_gen\n", "v": ""}
    rules = texts.select("workspace", compiled_rules(literal_settings(), parse_rules(F.col("ignore_text"))).alias("rules"))
    pruned = list_tree(roots, rules)
    assert {r.path for r in pruned.collect()} == {"src/a.ts", "src/deep/er/b.ts", "src/bin.ts", "_keep/k.ts", "empty.ts", "big.ts"}

    readable, large = split_by_size(pruned, F.lit(2.0))
    assert [r.path for r in large.collect()] == ["big.ts"]
    read = {r.path: (r.content, r.size_bytes) for r in read_contents(readable).collect()}
    assert read == {"src/a.ts": ("export const a = 1;\n", 20), "src/deep/er/b.ts": ("b", 4), "src/bin.ts": ("��", 2),
                    "_keep/k.ts": ("k", 1), "empty.ts": ("", 0)}


def test_tree_scan_of_a_selection(spark, tree):
    root, _, _ = tree
    roots = spark.createDataFrame([("w", root)], "workspace string, root string")
    picked = spark.createDataFrame(
        [("w", "src"), ("w", "src/a.ts"), ("w", "src/deep"), ("w", ".env"), ("w", "linked")], "workspace string, prefix string")
    assert sorted(r.path for r in list_tree(roots, selection=picked).collect()) == [
        ".env", "src/a.ts", "src/bin.ts", "src/deep/er/b.ts", "src/notes.txt"]
