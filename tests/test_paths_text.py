import pytest
from helpers import apply
from pyspark.sql import functions as F

from bindery.functions import text as X
from bindery.functions.languages import language_tag
from bindery.functions.paths import ancestors, base_name, extension, normalise, posix_path, segments


def test_paths_in_parts(spark):
    cases = {
        "lib\\ui/menu.vue": (["lib", "ui", "menu.vue"], "menu.vue", "vue"),
        "\\\\share\\x\\": (["share", "x"], "x", ""),
        "//": ([], "//", ""),
        "": ([], "", ""),
        "backup.2024.SQL": (["backup.2024.SQL"], "backup.2024.SQL", "sql"),
        "v1.2/LICENSE": (["v1.2", "LICENSE"], "LICENSE", ""),
        "etc/.bashrc": (["etc", ".bashrc"], ".bashrc", ""),
        "etc/.conf.D": (["etc", ".conf.D"], ".conf.D", "d"),
        "odd.": (["odd."], "odd.", ""),
        "..odd": (["..odd"], "..odd", "odd"),
    }
    for at, function in enumerate((segments, base_name, extension)):
        assert apply(spark, function, *cases) == [parts[at] for parts in cases.values()]


def test_posix_and_normalise(spark):
    assert apply(spark, posix_path, "lib\\ui\\m.vue", "lib/ui", "a\\\\b") == ["lib/ui/m.vue", "lib/ui", "a//b"]
    assert apply(spark, normalise, ".\\a\\b", "./a", "//a/b", "././a", "/./a") == ["a/b", "a", "a/b", "./a", "./a"]


def test_ancestors(spark):
    assert apply(spark, ancestors, "a/b/c.ts", "c.ts", "", "a//b") == [["a", "a/b"], [], [], ["a", "a/"]]


def test_language_tags(spark):
    paths = ["a.vue", "b.cs", "c.sql", "README.MD", "x/Dockerfile", "a.weird", "constructor", ".npmrc", "Rakefile",
             ".gitignore", ".editorconfig", "main.tfvars", "a.kts", "Procfile", ".env", "a.env"]
    assert apply(spark, language_tag, *paths) == [
        "vue", "csharp", "sql", "md", "dockerfile", "", "", "ini", "ruby", "gitignore", "ini", "hcl", "kotlin", "bash", "", "ini",
    ]


def test_token_estimate(spark):
    texts = ["", "let x", "x" * 12, "x" * 13, "\n", "ขอบคุณ", "😀😀", "😀😀😀"]
    assert apply(spark, X.estimate_tokens, *texts) == [0, 2, 3, 4, 1, 2, 1, 2]
    assert apply(spark, X.utf16_length, "x😀", "é", "") == [3, 1, 0]


def test_counts_and_sizes(spark):
    row = spark.range(1).select(
        *[X.format_count(F.lit(n)) for n in (0, 8050, 2500.25, 71, 9876543)],
        *[X.size_label(F.lit(n)) for n in (1536, 0, 511, 512, 999 * 1024)],
    ).first()
    assert tuple(row) == ("0", "8,050", "2,500.25", "71", "9,876,543", "2 KB", "0 KB", "0 KB", "1 KB", "999 KB")


@pytest.mark.parametrize(
    "content,ticks",
    [
        ("no fence", 3),
        ("Run:\n```\nmake\n```", 4),
        ("````\nx\n````", 5),
        ("  ```\n  x\n  ```\n", 4),
        ("text ``` in a line", 3),
        ("a\n\n \t`````", 6),
        ("a\r```", 4),
        ("a  ﻿````", 5),
        ("", 3),
    ],
)
def test_fence(spark, content, ticks):
    assert apply(spark, X.fence_for, content) == ["`" * ticks]


def test_blank_runs_and_trim(spark):
    assert apply(spark, X.collapse_blank_runs, "a\n\n\n\nb\n\nc", "a\n\nb") == ["a\n\nb\n\nc", "a\n\nb"]
    assert apply(spark, X.trim_blanks, " \n a b ﻿\n", "   \n  ") == ["a b", ""]


def test_binary(spark):
    bad = "�"
    cases = {
        "GIF89a\0": True,
        "q" + bad * 3: True,
        "SELECT 1;\n": False,
        "ขอบคุณ\n": False,
        bad + "q" * 40: False,
        "": False,
        bad + "a" * 9: False,  # exactly a tenth
        bad * 2 + "a" * 9: True,
        "a" * 8000 + "\0": False,  # outside the sample
        "a" * 7999 + "\0": True,
        "😀" * 4000 + "\0": False,  # 8,000 units of pairs come first
        "😀" * 3999 + "a\0": True,
        "a" + "😀" * 3999 + "a\0": False,
        bad * 801 + "😀" * 3600: True,
        bad * 800 + "😀" * 3600: False,
        "a" + bad * 800 + "😀" * 4000: False,  # a split pair at the edge
    }
    assert apply(spark, X.looks_binary, *cases) == list(cases.values())


def test_decode(spark):
    raw = [b"\xef\xbb\xbfabc", b"\xff\xfe\xf0\x9f\x98", "é".encode(), b""]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, raw binary")
    got = [r[0] for r in df.orderBy("i").select(X.decode_text(F.col("raw"))).collect()]
    assert got == ["abc", "���", "é", ""]
