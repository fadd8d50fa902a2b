import pytest
from helpers import evaluate
from pyspark.sql import functions as F

from bindery.operators.filters import collect_files, exceeds_size_limit, path_skip_reason
from bindery.operators.ignore import has_negation, is_ignored, parse_rules, rules_regex
from bindery.operators.settings import compiled_rules, literal_settings

BASE = dict(include_extensions=["ts", "js", "md"], ignore_patterns=["node_modules", "dist", ".git"], max_file_size_kb=200)


def reasons(spark, paths, gitignore=None, **overrides):
    rules = None if gitignore is None else parse_rules(F.lit(gitignore))
    compiled = compiled_rules(literal_settings(**{**BASE, **overrides}), rules)
    return evaluate(spark, [{"path": p} for p in paths], path_skip_reason(F.col("path"), compiled))


def test_ignore_globs_match_any_segment(spark):
    paths = ["node_modules/pkg/a.js", "packages/app/node_modules/a.js", "src/a.ts", "src/dist-helper/a.ts",
             "node_modules\\pkg\\a.js", "NODE_MODULES/a.js", "dist"]
    assert reasons(spark, paths) == ["ignored", "ignored", None, None, "ignored", "ignored", "ignored"]


def test_ignore_globs(spark):
    globs = ["*.min.js", "build-*", "tmp/", "a?c", "x+y", "", "/", "in/side", "b\\d"]
    paths = ["vendor/jquery.min.js", "build-output/a.js", "src/a.js", "tmp/a.ts", "abc/x.ts", "ac/x.ts", "x+y/a.ts",
             "xxy/a.ts", "in/side/a.ts", "a//b.ts", "b/d.ts", "É/a.ts"]
    got = reasons(spark, paths, ignore_patterns=globs)
    assert got == ["ignored", "ignored", None, "ignored", "ignored", None, "ignored", None, None, None, None, None]


def test_ignore_glob_of_stars_needs_a_segment(spark):
    assert reasons(spark, ["a.ts", "", "//"], ignore_patterns=["*"], include_extensions=[]) == ["ignored", None, None]
    assert reasons(spark, ["É/a.ts"], ignore_patterns=["é"]) == ["ignored"]


def test_extension_filter(spark):
    assert reasons(spark, ["src/a.ts", "src/a.png", "Makefile", ".gitignore"]) == [
        None, "extension-filter", "extension-filter", "extension-filter"]
    assert reasons(spark, ["src/A.Ts"], include_extensions=[".TS"]) == [None]
    assert reasons(spark, ["src/a.png", "Makefile"], include_extensions=[]) == [None, None]
    assert reasons(spark, ["Makefile"], include_extensions=["."]) == [None]


def test_ignore_file_joins_the_verdict(spark):
    assert reasons(spark, ["out/a.js", "README.md", "src/a.ts"], "out/\n*.md\n") == ["ignored", "ignored", None]
    assert reasons(spark, ["out/a.js"], ignore_patterns=[]) == [None]
    assert reasons(spark, ["out/a.js"], "out/", respect_gitignore=False) == [None]


def ignored(spark, text, *paths):
    rules = parse_rules(F.lit(text))
    verdict = is_ignored(F.col("path"), rules, rules_regex(rules), has_negation(rules))
    return evaluate(spark, [{"path": p} for p in paths], verdict)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("dist   \n", {"dist/a.js": True}),
        ("node_modules", {"node_modules/a.js": True, "packages/app/node_modules/a.js": True}),
        ("/dist", {"dist/a.js": True, "packages/app/dist/a.js": False}),
        ("build/", {"build/a.js": True, "build": False}),
        ("*.log", {"debug.log": True, "logs/debug.log": True}),
        ("logs/*.log", {"logs/nested/debug.log": False, "logs/a.log": True}),
        ("logs/**/debug.log", {"logs/a/b/debug.log": True, "logs/debug.log": True}),
        ("file?.ts", {"file1.ts": True, "file12.ts": False}),
        ("dist", {"dist\\a.js": True, "./dist/a": True, "DIST/a": False}),
        ("*.log\n!keep.log", {"keep.log": False, "other.log": True, "a/keep.log": False}),
        ("*.log\n!keep.log\nkeep.log", {"keep.log": True}),
        ("dist/\n!dist/keep.js", {"dist/keep.js": True}),
        ("a/**", {"a": False, "a/b": True, "a/b/c": True}),
        ("***/x", {"q/x": True, "qq/rr/x": True}),
        ("[ab].ts", {"a.ts": False, "[ab].ts": True}),
        ("\\#x\n\\!y", {"#x": True, "!y": True}),
        ("a\\ ", {"a\\ ": False}),
        ("docs/\r\nx.md\r\n", {"docs/a": True, "x.md": True}),
        ("# note\n\n   \n", {"# note": False, "a": False}),
        ("/", {"a": False}),
        ("!a", {"a": False}),
        ("a.b", {"a.b": True, "axb": False}),
        ("é", {"é/x": True}),
    ],
)
def test_ignore_file(spark, text, expected):
    assert ignored(spark, text, *expected) == list(expected.values())


def test_ignore_file_of_a_python_project(spark):
    text = "__pycache__/\n*.py[co]\n/wheels\n\n# notebooks\n.ipynb_checkpoints\nreports/*.html\n!reports/index.html\n/data/**/raw\n"
    expected = {
        "pkg/__pycache__/a.pyc": True, "pkg/a.py": False, "a.pyc": False, "wheels/x.whl": True, "sub/wheels/x.whl": False,
        "nb/.ipynb_checkpoints/n.json": True, "reports/may.html": True, "reports/index.html": False,
        "reports/old/may.html": False, "data/raw": True, "data/2024/q1/raw/f.csv": True, "other/data/raw/f.csv": False,
    }
    assert ignored(spark, text, *expected) == list(expected.values())


def test_rules_keep_their_order_and_flags(spark):
    rules = spark.range(1).select(parse_rules(F.lit("# c\na/\n!b\n\n/c/d")).alias("r")).first()["r"]
    assert [(r.ordinal, r.negated, r.dir_only) for r in rules] == [(2, False, True), (3, True, False), (5, False, False)]


def test_size_limit(spark):
    got = spark.range(1).select(
        exceeds_size_limit(F.lit(200 * 1024), F.lit(200.0)),
        exceeds_size_limit(F.lit(200 * 1024 + 1), F.lit(200.0)),
        exceeds_size_limit(F.lit(10**12), F.lit(0.0)),
        exceeds_size_limit(F.lit(513), F.lit(0.5)),
    ).first()
    assert tuple(got) == (False, True, False, True)


def test_collect_files_gives_one_reason_each(spark):
    rows = [
        ("lib/cart.ts", "x", 1), ("vendor/dist/z.js", "x", 1), ("art/cover.webp", "a\0", 2), ("guide/intro.md", "x", 1),
        ("lib/seed.ts", "x", 512 * 1024), ("lib/blob.ts", "a\0", 2), ("dist/seed.ts", "x", 512 * 1024),
    ]
    files = spark.createDataFrame(rows, "path string, content string, size_bytes bigint")
    kept, skipped = collect_files(files, compiled_rules(literal_settings(**BASE)))
    assert sorted(r.path for r in kept.collect()) == ["guide/intro.md", "lib/cart.ts"]
    assert {r.path: (r.reason, r.detail) for r in skipped.collect()} == {
        "vendor/dist/z.js": ("ignored", None),
        "art/cover.webp": ("extension-filter", None),
        "lib/seed.ts": ("too-large", "512 KB"),
        "lib/blob.ts": ("binary", None),
        "dist/seed.ts": ("ignored", None),
    }
